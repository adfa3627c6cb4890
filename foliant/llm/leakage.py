"""Evaluation texts leaking into a corpus: CGK embedding of word windows, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.skew import union_all

_WORD = re.compile(r"[^\W_]+")
#: Different item windows in one broadcast block, and blocks that are searched in one pass over the documents; more take further passes.
BLOCK, BLOCKS_A_PASS = 50_000, 8
#: Words of a text that are searched at a time, and candidates that are verified at a time. They bound memory, not results.
_WORDS, _CANDIDATES = 250_000, 1_000_000


def words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


@dataclass
class _Block:
    """Different windows of a block of items, who has them, and the random choices that embed and sample them."""

    vocabulary: dict[str, int]
    tokens: np.ndarray  # one row for each window
    owners: np.ndarray  # items, those of one window together
    times: np.ndarray  # how often the item has the window
    first: np.ndarray  # where each window's owners begin
    grams: list[np.ndarray]  # numbers of the windows' runs of 2, 3, ... words, up to those of which one survives all edits
    steps: np.ndarray  # bit r: whether repetition r moves on at this step over this word
    sampled: np.ndarray
    mix: np.ndarray
    keys: list[np.ndarray]
    order: list[np.ndarray]


def _gram(x: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` words of ``x``; 0 for one with an unknown word."""
    n = max(0, len(x) - size + 1)
    out, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for i in range(size):
        out = (out ^ x[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        known &= x[i : i + n] > 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


def _padded(matrix: np.ndarray, pad: int) -> np.ndarray:
    """Windows with room behind for a pointer that has run off their end."""
    n, width = matrix.shape
    out = np.full((n, 3 * width), pad, dtype=np.int32)
    out[:, :width] = matrix
    return out


def _embedded_key(padded: np.ndarray, steps: np.ndarray, repeat: int, sampled: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """The bucket of each window: its CGK random walk, sampled at a few of its positions.

    The walk writes the token under its pointer and then moves the pointer on by a random bit that depends on the
    step and the token alone, so that equal remainders fall into step again after an edit.
    """
    flat, at = padded.reshape(-1), np.arange(len(padded), dtype=np.int64) * padded.shape[1]
    key = np.zeros(len(padded), dtype=np.uint64)
    token = np.empty(len(padded), dtype=np.int32)
    move = np.empty(len(padded), dtype=np.int64)
    wanted = set(sampled.tolist())
    for step in range(int(sampled.max()) + 1):
        np.take(flat, at, out=token, mode="clip")
        if step in wanted:
            key ^= (token.astype(np.uint64) + np.uint64(1)) * mix[step]
            key *= np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        moves = ((steps[step] >> np.uint64(repeat)) & np.uint64(1)).astype(np.int64)
        at += np.take(moves, token, out=move, mode="clip")
    return key


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the least number of words to insert, delete or replace."""
    n, w = a.shape
    row = np.tile(np.arange(w + 1, dtype=np.int16), (n, 1))
    for i in range(w):
        last, row = row, np.empty_like(row)
        row[:, 0] = i + 1
        for j in range(w):
            row[:, j + 1] = np.minimum(np.minimum(row[:, j], last[:, j + 1]) + 1, last[:, j] + (a[:, i] != b[:, j]))
    return row[:, w]


def _block(windows: dict[tuple[str, ...], Counter[int]], width: int, edits: int, repeats: int, samples: int, seed: int) -> _Block:
    vocabulary: dict[str, int] = {}
    matrix = np.array([[vocabulary.setdefault(w, len(vocabulary) + 1) for w in window] for window in windows], dtype=np.int32).reshape(-1, width)
    owners = [(item, n) for c in windows.values() for item, n in c.items()]
    first = np.cumsum([0, *(len(c) for c in windows.values())])
    rng = np.random.default_rng(seed)
    steps = rng.integers(0, 2**64, size=(2 * width, len(vocabulary) + 2), dtype=np.uint64)
    # one position of each of ``samples`` equal parts: sampled at will, a repetition may see little but the walk's end
    edges = np.linspace(0, 2 * width, samples + 1).astype(int)
    sampled = np.stack([rng.integers(edges[:-1], edges[1:]) for _ in range(repeats)])
    mix = rng.integers(1, 2**63, size=2 * width, dtype=np.uint64) | np.uint64(1)
    padded = _padded(matrix, len(vocabulary) + 1)
    runs = lambda g: np.concatenate([_gram(np.ascontiguousarray(matrix[:, i : i + g]).reshape(-1), g)[::g] for i in range(width - g + 1)])
    grams = [np.unique(runs(g)) for g in range(2, width // (edits + 1) + 1)]
    keys, order = [], []
    for r in range(repeats):
        k = _embedded_key(padded, steps, r, sampled[r], mix)
        order.append(np.argsort(k, kind="stable").astype(np.int32))
        keys.append(k[order[-1]])
    return _Block(vocabulary, matrix, np.array([i for i, _ in owners], dtype=np.int64), np.array([n for _, n in owners], dtype=np.int64), first, grams, steps, sampled, mix, keys, order)


def _candidates(block: _Block, x: np.ndarray, starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Pairs that share a bucket in some repetition, as start * number of windows + window, each once, in parts of about ``_CANDIDATES``."""
    low, n = [], []
    padded = _padded(x[starts[:, None] + np.arange(width)], len(block.vocabulary) + 1)
    for r in range(len(block.keys)):
        k = _embedded_key(padded, block.steps, r, block.sampled[r], block.mix)
        low.append(np.searchsorted(block.keys[r], k))
        hit = np.flatnonzero(block.keys[r][np.minimum(low[-1], len(block.tokens) - 1)] == k)
        n.append(np.zeros(len(starts), dtype=np.int64))
        n[-1][hit] = np.searchsorted(block.keys[r], k[hit], "right") - low[-1][hit]
    upto = np.cumsum(np.sum(n, axis=0))
    part = upto // _CANDIDATES
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        codes = []
        for r in range(len(block.keys)):
            m = n[r][rows]
            at = np.repeat(starts[rows], m)
            w = block.order[r][np.repeat(low[r][rows], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            codes.append(at * len(block.tokens) + w)
        code = np.sort(np.concatenate(codes))
        code = code[np.append(True, code[1:] != code[:-1])] if len(code) else code
        yield code


def _search(block: _Block, docs: list[int], texts: list[list[str]], width: int, edits: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(document, item) → (least edit distance of the item's windows to any window of the text, pairs of windows at that distance)."""
    get = block.vocabulary.get
    tokens = [np.array([get(w, 0) for w in t], dtype=np.int32) for t in texts]
    size = np.array([len(t) for t in tokens])
    x = np.concatenate([*tokens, np.zeros(width, dtype=np.int32)])
    known = np.concatenate(([0], np.cumsum(x > 0)))
    # a window within so many edits of an item's has at least width - g + 1 - g * edits of its runs of g words in common with it
    near = known[width:] - known[:-width] >= width - edits
    last = len(x) - width
    for g, grams in enumerate(block.grams, 2):
        numbers = _gram(x, g)
        place = np.minimum(np.searchsorted(grams, numbers), len(grams) - 1)
        upto = np.concatenate(([0], np.cumsum(grams[place] == numbers)))
        near[:last] &= upto[width - g + 1 :][:last] - upto[:last] >= width - g + 1 - g * edits
    ends = np.cumsum(size)
    for end, n in zip(ends.tolist(), size.tolist(), strict=True):  # nor may a window run into the next text
        near[max(end - width + 1, end - n) : end] = False
    near = near[: len(x) - width]
    starts, n = np.flatnonzero(near), len(block.tokens)

    def verified(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (as start * n + window) that are within the edits, and their distances."""
        kept, distances = [code[:0]], [np.zeros(0, dtype=np.int16)]
        for i in range(0, len(code), 50_000):
            part = code[i : i + 50_000]
            found, wanted = x[(part // n)[:, None] + np.arange(width)], block.tokens[part % n]
            shared = (found[:, :, None] == wanted[:, None, :]).any(axis=2).sum(axis=1) >= width - edits
            d = edit_distance(found[shared], wanted[shared])
            kept.append(part[shared][d <= edits])
            distances.append(d[d <= edits])
        return np.concatenate(kept), np.concatenate(distances)

    codes, distances = [], []
    for chunk in np.array_split(starts, len(starts) // 50_000 + 1):
        for code in _candidates(block, x, chunk, width) if len(chunk) else ():
            code, d = verified(code)
            codes.append(code)
            distances.append(d)
    if not sum(map(len, codes)):
        return {}
    # a passage has more than one pair of windows, as a rule: those beside a found one are verified too, whatever their buckets
    new = np.unique(np.concatenate(codes))
    seen = new
    while len(new):
        at, w = new // n, new % n
        beside = [(at + i) * n + w + j for i, j in ((1, 1), (-1, -1), (1, 0), (-1, 0), (0, 1), (0, -1))]
        ok = [(at + i >= 0) & (at + i < len(near)) & (w + j >= 0) & (w + j < n) for i, j in ((1, 1), (-1, -1), (1, 0), (-1, 0), (0, 1), (0, -1))]
        tried = np.setdiff1d(np.concatenate([c[k] for c, k in zip(beside, ok, strict=True)]), seen)
        new, d = verified(tried[near[tried // n]])
        seen = np.union1d(seen, tried)
        codes.append(new)
        distances.append(d)
    code, dist = np.concatenate(codes), np.concatenate(distances)
    w = code % n
    many = block.first[w + 1] - block.first[w]
    owner = np.repeat(block.first[w], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row, dist = np.repeat(np.searchsorted(ends, code // n, "right"), many), np.repeat(dist, many)
    item, times = block.owners[owner], block.times[owner]
    order = np.lexsort((dist, item, row))
    row, item, dist, times = row[order], item[order], dist[order], times[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
    least = np.repeat(dist[first], np.diff(np.append(first, len(row))))
    total = np.add.reduceat(np.where(dist == least, times, 0), first)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for r, i, d, t in zip(row[first].tolist(), item[first].tolist(), dist[first].tolist(), total.tolist(), strict=True):
        _better(best, (docs[r], i), d, t)
    return best


def _better(best: dict[tuple[int, int], tuple[int, int]], key: tuple[int, int], distance: int, pairs: int) -> None:
    """Keep the least distance of a key, and the sum of the pairs at it."""
    old = best.get(key)
    if old is None or distance < old[0]:
        best[key] = (distance, pairs)
    elif distance == old[0]:
        best[key] = (distance, old[1] + pairs)


def _batches(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Row numbers and words of a batch's rows in groups of about ``_WORDS``, so that memory is bounded however long texts are.

    A longer text comes in pieces that overlap by a window less one word: each of its windows lies in one piece.
    """
    docs, texts, size = [], [], 0
    for d, t in enumerate(batch.column(1).to_pylist()):
        every = words(t)
        for at in range(0, max(1, len(every) - width + 1), _WORDS):
            docs.append(d)
            texts.append(every[at : at + _WORDS + width - 1] if len(every) > _WORDS else every)
            size += len(texts[-1])
            if size >= _WORDS:
                yield docs, texts
                docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, width: int = 12, edits: int = 2, repeats: int = 48, samples: int = 6, seed: int = 6) -> DataFrame:
    """(doc_id, item_id, distance, windows): documents that hold a run of ``width`` words of an item with at most ``edits`` edits.

    distance is the least edit distance over words between a window of the text and one of the item, windows the number of such pairs.
    Words are maximal runs of letters and digits in any case. An unedited run is always found: equal windows
    have equal embeddings and so share every bucket. A run with words replaced, inserted or left out is found with the
    probability that one of ``repeats`` (at most 64) samples of ``samples`` of the first 2·width embedded positions (a walk
    is over by then, as a rule) meets no difference;
    every candidate, and every pair of windows beside a found one, is verified by its exact edit distance. Windows that cannot be within ``edits`` of an item, because
    too few of their words, or of their runs of two and more words, are an item's, are not embedded. Items shorter than
    ``width`` words leak nowhere; null texts and ids have no words; a document or item given twice counts once; no items or no
    documents give no rows. Documents are only scanned: nothing of them is shuffled but the found pairs. The
    items are the query set: their different windows go to the executors in blocks of at most ``BLOCK``, ``BLOCKS_A_PASS`` for each scan.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).dropna()
    schema = "doc_id bigint, item_id bigint, distance int, windows bigint"

    def searched(blocks: list[Broadcast]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # pieces of one text follow each other, so sums over a batch are sums over whole texts
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for ids, texts in _batches(batch, width):
                    for b in blocks:
                        for key, (dist, n) in _search(b.value, ids, texts, width, edits).items():
                            _better(best, key, dist, n)
                name = batch.column(0).to_pylist()
                rows = [(name[row], item, dist, n) for (row, item), (dist, n) in best.items()]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "windows"])

        return base.mapInArrow(run, schema)

    parts: list[DataFrame] = []
    blocks: list[Broadcast] = []
    now: dict[tuple[str, ...], Counter[int]] = {}

    def flush(last: bool = False) -> None:
        nonlocal now, blocks
        if now:
            blocks.append(spark.sparkContext.broadcast(_block(now, width, edits, repeats, samples, seed)))
            now = {}
        if blocks and (last or len(blocks) >= BLOCKS_A_PASS):
            parts.append(searched(blocks).withColumn("part", F.lit(len(parts))))
            blocks = []

    queries = items.select(F.col(f"`{item}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).dropna().distinct().orderBy("i")
    for row in queries.toLocalIterator():
        text_words = words(row.t)
        for at in range(len(text_words) - width + 1):
            now.setdefault(tuple(text_words[at : at + width]), Counter())[row.i] += 1
        if len(now) >= BLOCK:
            flush()
    flush(last=True)
    if not parts:
        return spark.createDataFrame([], schema)
    best = lambda d, *by: d.groupBy(*by).agg(F.min(F.struct("distance", (-F.col("windows")).alias("w"))).alias("b")).select(*by, "b.distance", (-F.col("b.w")).alias("windows"))
    found = best(union_all(parts), "part", "doc_id", "item_id")
    if len(parts) > 1:  # passes search for different windows, so their pairs add up
        found = found.groupBy("doc_id", "item_id", "distance").agg(F.sum("windows").alias("windows"))
        found = best(found, "doc_id", "item_id")
    return found.select("doc_id", "item_id", "distance", "windows")

"""Nearest vectors by cosine: exact search in blocks of queries, and an inverted-file index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.lexical import top_k
from foliant.plans.skew import union_all

#: Queries that are sent to the executors at a time.
BLOCK = 2048


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the rows of that length as unit vectors, and which rows they are; null, empty and zero vectors are left out."""
    lists = column.to_pylist()
    places: dict[int, list[int]] = {}
    for i, v in enumerate(lists):
        if v and None not in v:
            places.setdefault(len(v), []).append(i)
    out = {}
    for size, at in places.items():
        m = np.array([lists[i] for i in at], dtype=float)
        length = np.linalg.norm(m, axis=1)
        if (ok := length > 0).any():
            out[size] = m[ok] / length[ok, None], np.array(at)[ok]
    return out


def _best(items: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each item once, with the highest of its scores; ``s`` has a column for each of ``items``."""
    order = np.argsort(items, kind="stable")
    once, starts = np.unique(items[order], return_index=True)
    return (items, s) if len(once) == len(items) else (once, np.maximum.reduceat(s[:, order], starts, axis=1))


def _top_items(found: DataFrame, k: int) -> DataFrame:
    """top_k with each item once, at its highest score."""
    return top_k(found.groupBy("query_id", "item").agg(F.max("score").alias("score")), k)


def nearest(vectors: DataFrame, item: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int = 8) -> DataFrame:
    """(query_id, item, score, rank): each query's k items of highest cosine, rounded to 6 digits, ties by id. Exact.

    Vectors are scanned once for each block of queries of one length: a task multiplies its batch with the block and keeps k items of
    each query, so only these are shuffled. A filter on ``vectors`` acts before the ranking. Null, empty and zero vectors,
    and those of another length than the query's, are near nothing; an item given more than once counts once, at its highest score.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(f"`{item}`").cast("bigint").alias("item"), F.col(f"`{vector}`").alias("v")).dropna()
    schema = "query_id bigint, item bigint, score double"

    def passes(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            for b in batches:
                same = _matrices(b.column(1)).get(q.shape[1])
                if same is None:
                    continue
                m, rows = same
                items, s = _best(b.column(0).to_numpy()[rows], np.round(q @ m.T, 6) + 0.0)
                order = np.stack([np.lexsort((items, -line))[:k] for line in s])
                yield pa.record_batch([pa.array(np.repeat(q_ids, order.shape[1])), pa.array(items[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["query_id", "item", "score"])

        return base.mapInArrow(run, schema)

    parts: list[DataFrame] = []
    blocks: dict[int, tuple[list[int], list[list[float]]]] = {}

    def flush(size: int) -> None:
        ids, lines = blocks.pop(size)
        for m, rows in _matrices(pa.array(lines)).values():
            parts.append(passes(np.array(ids, dtype=np.int64)[rows], m))

    for r in queries.select(F.col(f"`{query}`").cast("bigint").alias("q"), F.col(f"`{query_vector}`").alias("v")).dropna().dropDuplicates(["q"]).orderBy("q").toLocalIterator():
        ids, lines = blocks.setdefault(len(r.v), ([], []))
        ids.append(r.q)
        lines.append(r.v)
        if len(ids) >= BLOCK:
            flush(len(r.v))
    for size in list(blocks):
        flush(size)
    return _top_items(union_all(parts), k) if parts else top_k(spark.createDataFrame([], schema), k)


def _probes_for(m: np.ndarray, centres: np.ndarray, recall: float, k: int = 8, tried: int = 1000) -> int:
    """The least number of lists that hold ``recall`` of the k nearest others of the first ``tried`` rows of ``m``, copies left out."""
    m = m[np.sort(np.unique(m, axis=0, return_index=True)[1])]
    home = (m @ centres.T).argmax(1)
    needed = []
    for at in range(0, min(tried, len(m)), 100):
        q = m[at : min(at + 100, tried)]
        s = q @ m.T
        s[np.arange(len(q)), at + np.arange(len(q))] = -np.inf
        near = np.argsort(-s, axis=1)[:, : min(k, len(m) - 1)]
        place = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)
        needed.append(np.take_along_axis(place, home[near], 1).ravel())
    places = np.sort(np.concatenate(needed))
    return int(places[int(np.ceil(recall * len(places))) - 1]) + 1 if len(places) else 1


class InvertedFile:
    """Approximate search: every vector is listed under its nearest of ``lists`` centres; a query looks into ``probes`` of them.

    Vectors of each length have centres and lists of their own. Centres are fitted by k-means on at most ``sample`` vectors chosen
    by a hash of the id; every row is listed. No list has a cap: a list is scanned by as many tasks as its rows are spread over.
    How many lists hold ``recall`` of the true neighbours is measured on the same vectors; a search looks into at least that many.
    """

    def __init__(self, vectors: DataFrame, item: str, vector: str, lists: int = 64, sample: int = 20_000, seed: int = 5, recall: float = 0.95):
        self.vectors = vectors.select(F.col(f"`{item}`").cast("bigint").alias("item"), F.col(f"`{vector}`").alias("v")).dropna()
        self.centres: dict[int, np.ndarray] = {}
        self.least_probes: dict[int, int] = {}
        self.firsts: dict[int, int] = {}  # the number of the first list of each length
        sizes = sorted(r.n for r in self.vectors.select(F.size("v").alias("n")).filter("n > 0").distinct().collect())
        # null and zero vectors are left out before the sample is drawn, so that they can't fill it
        usable = self.vectors.filter(F.forall("v", lambda x: x.isNotNull()) & F.exists("v", lambda x: x != 0))
        for size in sizes:
            rows = usable.filter(F.size("v") == size).orderBy(F.xxhash64("item"), "item").limit(sample).collect()
            for m, _ in _matrices(pa.array([r.v for r in rows], pa.list_(pa.float64()))).values():
                self.firsts[size] = len(self.firsts) * lists
                self.centres[size] = centres = self._fit(m, lists, np.random.default_rng(seed))
                self.least_probes[size] = _probes_for(m, centres, recall)

    @staticmethod
    def _fit(m: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
        centres = m[rng.choice(len(m), min(lists, len(m)), replace=False)]
        for _ in range(15):
            near = (m @ centres.T).argmax(1)
            centres = np.stack([m[near == i].sum(0) if (near == i).any() else c for i, c in enumerate(centres)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        return centres

    def listed(self) -> DataFrame:
        """(list, item, v): the index table; partition it by ``list`` when it is written."""
        shared = self.vectors.sparkSession.sparkContext.broadcast((self.centres, self.firsts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, firsts = shared.value
            for b in batches:
                for size, (m, rows) in _matrices(b.column(1)).items():
                    if size in centres:
                        near = firsts[size] + (m @ centres[size].T).argmax(1)
                        yield pa.record_batch([pa.array(near.astype(np.int32)), b.column(0).take(pa.array(rows)), pa.array(list(m), pa.list_(pa.float64()))], names=["list", "item", "v"])

        return self.vectors.mapInArrow(run, "list int, item bigint, v array<double>")

    def search(self, queries: DataFrame, query: str, query_vector: str, k: int = 8, probes: int = 16) -> DataFrame:
        """(query_id, item, score, rank) from the lists of each query's nearest centres: ``probes``, or more where recall needs it.

        An item given more than once counts once, at its highest score.
        """
        spark = self.vectors.sparkSession
        shared = spark.sparkContext.broadcast((self.centres, self.firsts, self.least_probes))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, firsts, least = shared.value
            for b in batches:
                for size, (m, rows) in _matrices(b.column(1)).items():
                    if size in centres:
                        near = np.argsort(-(m @ centres[size].T), axis=1)[:, : max(probes, least[size])]
                        lists = (firsts[size] + near).ravel().astype(np.int32)
                        yield pa.record_batch([pa.array(lists), b.column(0).take(pa.array(np.repeat(rows, near.shape[1]))), pa.array([m[i] for i in np.repeat(np.arange(len(m)), near.shape[1])], pa.list_(pa.float64()))], names=["list", "query_id", "q"])

        q = queries.select(F.col(f"`{query}`").cast("bigint").alias("query_id"), F.col(f"`{query_vector}`").alias("v")).dropna().dropDuplicates(["query_id"]).mapInArrow(probe, "list int, query_id bigint, q array<double>")
        dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        return _top_items(self.listed().join(q, "list").select("query_id", "item", F.round(dot, 6).alias("score")), k)

"""Lines and multi-line blocks repeated across one source's documents, found in the suffix order and removed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.lineage import cut
from foliant.plans.skew import attach, union_all

#: Lines of a suffix that are compared in the one sort; longer common prefixes are found by doubling from there.
DEPTH = 4
_HEAD = ["x", "y", *[f"h{d}" for d in range(1, DEPTH)]]
_ORDER = [*_HEAD, "item", "k", "at"]
_FOUND = "kind byte, item bigint, k int, at int, no int, length byte, maybe byte, " + ", ".join(f"{c} bigint" for c in _HEAD)


def normal_line(c: Column) -> Column:
    """A line without regard to case, to blanks at the ends, their amount and kind inside, and to the digits of numbers."""
    blank = F.regexp_replace(c, r"[\s\p{Z}]+", " ")
    return F.upper(F.lower(F.trim(F.regexp_replace(blank, r"\p{Nd}+", "0"))))


def common_prefixes(head: list[np.ndarray]) -> np.ndarray:
    """For each row but the first, how many leading lines its suffix has in common with the row before; a missing line (0) equals none."""
    same = (head[0][1:] == head[0][:-1]) & (head[1][1:] == head[1][:-1])
    lcp = same.astype(np.int8)
    for h in head[2:]:
        same = same & (h[1:] == h[:-1]) & (h[1:] != 0)
        lcp += same
    return lcp


def _spanned(runs: np.ndarray, items: np.ndarray, least: int) -> np.ndarray:
    """How many different items each run has (a run of fewer rows than ``least`` goes uncounted, as 0)."""
    n = int(runs[-1]) + 1
    rows = np.flatnonzero(np.bincount(runs, minlength=n)[runs] >= least)
    r, i = runs[rows], items[rows]
    order = np.lexsort((i, r))
    r, i = r[order], i[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
    return np.bincount(r[new], minlength=n)


def _intervals(t: dict[str, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The stretches with a common prefix in one sorted part of the suffix order.

    Returns each row's longest prefix whose stretch spans ``least`` documents, the longest one that may do so together with the
    neighbouring parts, and up to ``least`` documents of each stretch at either end: (first row, depth, item).
    """
    lcp = common_prefixes([t[c] for c in _HEAD])
    n = len(t["x"])
    length, maybe = np.zeros(n, dtype=np.int8), np.zeros(n, dtype=np.int8)
    ends: list[tuple[int, int, int]] = []
    for d in range(1, DEPTH + 1):
        runs = np.concatenate(([0], np.cumsum(lcp < d)))
        there = t[_HEAD[d]] != 0 if d > 1 else np.ones(n, dtype=bool)  # the suffix has so many lines
        ok = (_spanned(runs, t["item"], least) >= least)[runs] & there
        length[ok] = d
        for run in {0, int(runs[-1])}:
            rows = np.flatnonzero(runs == run)
            if there[rows[0]]:
                maybe[rows] = d
                ends += [(int(rows[0]), d, int(i)) for i in np.unique(t["item"][rows])[:least]]
    return length, maybe, ends


class RepeatedLines:
    """Blocks of lines that stand in at least ``least`` different documents of one source.

    ``docs`` needs a document id (bigint), a source and a text column. Lines are the text split at line feeds, numbered
    from 1; blank lines count in the numbering, never stand in a block and don't interrupt one. Rows with a null id, source or
    text have no lines; a document delivered again counts once, as does a block that a document repeats; texts of one id are one document.

    The suffix array of each source's concatenated line identifiers is built as one distributed sort: every line begins a suffix (up to
    its document's end), identifiers hold the source, and suffixes are partitioned by range and sorted over their first ``DEPTH``
    lines and then by document, so that neither a hot source nor a hot line fills a partition. Common prefixes of neighbours delimit
    the stretches (the nodes of the array's interval tree); a stretch that spans ``least`` documents is a repeated block.
    Stretches that may run over the edge of a partition are settled by up to ``least`` documents that each part names for each depth,
    which decides as surely as all of them would. Common prefixes longer than ``DEPTH`` are ranked by prefix doubling.
    """

    def __init__(self, docs: DataFrame, item: str, source: str, text: str, least: int = 8):
        self.least = least
        self.all = docs.select(F.col(f"`{item}`").alias("item"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")).filter("item IS NOT NULL").withColumn("k", F.hash("text"))

    @cached_property
    def suffixes(self) -> DataFrame:
        """(item, k, at, no, length, x, y, h1, ...): in suffix order, the suffixes that begin with a repeated block, and its length up to ``DEPTH``."""
        numbered = F.filter(F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("no"), normal_line(t).alias("t"))), lambda r: r["t"] != "")
        rows = self.all.dropna().select("item", "k", "source", numbered.alias("l"))
        # line identifiers hold their source: two lines of different sources are never equal
        ids = lambda seed: F.transform("l.t", lambda t: F.xxhash64(F.lit(seed), "source", t))
        arrays = cut(rows.select("item", "k", F.col("l.no").alias("nos"), ids(1).alias("xs"), ids(2).alias("ys")))
        behind = [F.coalesce(F.get("xs", F.col("at") + d), F.lit(0)).alias(f"h{d}") for d in range(1, DEPTH)]
        every = arrays.select("*", F.posexplode("nos").alias("at", "no")).select("item", "k", "at", "no", F.get("xs", "at").alias("x"), F.get("ys", "at").alias("y"), *behind)
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = list(batches)
            if not sum(map(len, parts)):
                return
            t = {c: np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for b in parts]) for c in [*_ORDER, "no"]}
            new = np.ones(len(t["x"]), dtype=bool)
            new[1:] = np.logical_or.reduce([t[c][1:] != t[c][:-1] for c in _ORDER])
            t = {c: v[new] for c, v in t.items()}  # documents delivered again
            length, maybe, ends = _intervals(t, least)
            keep = (length > 0) | (maybe > 0)
            cols = [pa.array(np.zeros(keep.sum(), np.int8)), *[pa.array(t[c][keep]) for c in ("item", "k", "at", "no")], pa.array(length[keep]), pa.array(maybe[keep]), *[pa.array(t[c][keep]) for c in _HEAD]]
            names = ["kind", "item", "k", "at", "no", "length", "maybe", *_HEAD]
            yield pa.record_batch([c.cast(s) for c, s in zip(cols, types, strict=True)], names=names)
            if ends:
                first, depth, items = (np.array(v) for v in zip(*ends, strict=True))
                gap = [np.where(depth > d - 1, t[c][first], 0) for d, c in enumerate(_HEAD)]
                gap[1] = t["y"][first]
                cols = [pa.array(np.ones(len(ends), np.int8)), pa.array(items), *[pa.array(np.zeros(len(ends), np.int32))] * 3, pa.array(depth), pa.array(depth), *map(pa.array, gap)]
                yield pa.record_batch([c.cast(s) for c, s in zip(cols, types, strict=True)], names=names)

        types = [pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int8(), pa.int8(), *[pa.int64()] * len(_HEAD)]
        ordered = every.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
        found = cut(ordered.mapInArrow(run, _FOUND))
        # at most two such stretches for each depth and partition
        settled = found.filter("kind = 1").groupBy("length", *_HEAD).agg(F.countDistinct("item").alias("n")).filter(F.col("n") >= self.least).select(F.col("length").alias("d"), F.xxhash64("length", *_HEAD).alias("edge"))
        rows = found.filter("kind = 0").drop("kind")
        sure = rows.filter("maybe <= length").drop("maybe")
        prefix = lambda d: F.xxhash64(d.cast("byte"), "x", "y", *[F.when(d > i, F.col(f"h{i}")).otherwise(F.lit(0)) for i in range(1, DEPTH)])
        open_ = rows.filter("maybe > length").withColumn("d", F.explode(F.sequence(F.col("length").cast("int"), F.col("maybe").cast("int")))).withColumn("edge", prefix(F.col("d")))
        best = open_.join(F.broadcast(settled.select("edge").distinct().withColumn("hit", F.lit(True))), "edge", "left").filter("hit OR (d = length AND d > 0)")
        best = best.groupBy("item", "k", "at", "no", *_HEAD).agg(F.max("d").cast("byte").alias("length")).select(sure.columns)
        return sure.unionByName(best).filter("length > 0")

    def occurrences(self) -> DataFrame:
        """(item, line_no): every line of a repeated block. What is left of a block from any of its lines on is a repeated block too,
        so these are the lines at which one begins."""
        return self.suffixes.select("item", F.col("no").cast("bigint").alias("line_no")).distinct()

    def _counted(self, suffixes: DataFrame) -> DataFrame:
        """Suffixes whose rank spans enough documents, with their number."""
        counts = suffixes.select("rank", "item").distinct().groupBy("rank").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= self.least)
        return cut(attach(suffixes, counts, ["rank"], "documents"))

    def _extend(self, suffixes: DataFrame, heads: DataFrame, by: int) -> DataFrame:
        """Suffixes whose block still spans enough documents when ``heads``' ranks are put behind it; length grows by ``by``."""
        behind = heads.select("item", "k", F.col("at").alias("__at"), F.col("rank").alias("__behind"))
        longer = suffixes.withColumn("__at", F.col("at") + F.col("size")).join(behind, ["item", "k", "__at"])
        return self._counted(cut(longer.select("item", "k", "no", "at", (F.col("size") + by).alias("size"), _pair(F.col("rank"), F.col("__behind")).alias("rank"), "real")))

    def blocks(self) -> DataFrame:
        """(item, line_no, lines, documents): for each suffix in a repeated block, its longest block that spans enough documents,
        given once where no longer one of the same document runs over it from an earlier line.

        The suffix order gives the prefixes of 1, 2 and 4 lines. Ranks are doubled from there as long as any common prefix spans enough
        documents; then the longest length of each suffix is summed up of powers of two, the largest first. A suffix that has gone on to a
        longer prefix still counts for the shorter one (as one that isn't "real" there) as long as another suffix stays at it.
        """
        found = cut(self.suffixes)
        levels = []
        for k in range(DEPTH.bit_length()):
            head = _HEAD[: 2**k + 1]
            rank = F.struct(F.xxhash64(F.lit(k), *head).alias("x"), F.xxhash64(*reversed(head), F.lit(k)).alias("y"))
            levels.append(self._counted(found.filter(F.col("length") >= 2**k).select("item", "k", "no", "at", F.lit(2**k).alias("size"), rank.alias("rank"), F.lit(True).alias("real"))))
        while not levels[-1].isEmpty():
            levels.append(self._extend(levels[-1], levels[-1], 2 ** (len(levels) - 1)))
        while len(levels) > 1 and levels[-1].isEmpty():
            levels.pop()
        columns, key = ["item", "k", "no", "at", "size", "rank", "real", "documents"], ["item", "k", "at"]
        states = levels[-1]
        for k in range(len(levels) - 2, -1, -1):
            grown = self._extend(states, levels[k], 2**k)
            went = grown.select(*key, (F.col("size") - 2**k).alias("size"))
            stayed = states.join(went, [*key, "size"], "left_anti").unionByName(states.join(went, [*key, "size"], "left_semi").withColumn("real", F.lit(False)))
            longer = states.filter("real").select(*key, F.lit(True).alias("longer"))
            first = levels[k].join(longer, key, "left").withColumn("real", F.col("longer").isNull())
            states = cut(union_all([x.select(*columns) for x in (grown, stayed, first)]))
            needed = states.filter("real").select("rank").distinct()
            states = cut(states.join(needed, "rank", "left_semi"))
        before = Window.partitionBy("item", "k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        ends = states.filter("real").withColumn("covered", F.max(F.col("at") + F.col("size")).over(before))
        kept = ends.filter(F.col("covered").isNull() | (F.col("covered") < F.col("at") + F.col("size")))
        return kept.select("item", F.col("no").cast("bigint").alias("line_no"), F.col("size").alias("lines"), "documents").distinct()

    def cleaned(self) -> DataFrame:
        """(item, text, removed): every document with the lines of repeated blocks taken out, and how many were (a null text stays null)."""
        gone = self.suffixes.groupBy("item", "k").agg(F.collect_set("no").alias("gone"))
        d = self.all.join(gone, ["item", "k"], "left")
        left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i + 1))
        text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
        return d.select("item", "k", text.alias("text"), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("bigint").alias("removed")).distinct().drop("k")


def _pair(a: Column, b: Column) -> Column:
    return F.struct(F.xxhash64(a["x"], a["y"], b["x"], b["y"]).alias("x"), F.xxhash64(F.lit(11), a["y"], b["x"], b["y"], a["x"]).alias("y"))

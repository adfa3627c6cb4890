"""Near-duplicate pictures: hash minima with banding, signature verification, star-contracted components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.components import components
from foliant.plans.lineage import cut
from foliant.plans.skew import attach, member_pairs, pairs_within, union_all

BITS = 64


def miss_rate(distance: int, rows: int, bands: int) -> float:
    """Chance that banding misses a pair whose 64-bit hashes differ in ``distance`` bits.

    A hash is the set of its 64 (position, bit) elements, so such a pair has Jaccard (64-d)/(64+d).
    """
    j = (BITS - distance) / (BITS + distance)
    return (1 - j**rows) ** bands


def hash_bits(c: Column) -> Column:
    """A hash of exactly 16 hex digits as a 64-bit integer; null for anything else."""
    half = lambda at: F.conv(F.substring(c, at, 8), 16, 10).cast("bigint")
    return F.when(c.rlike("^[0-9a-fA-F]{16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def bands_for(distance: int, rows: int, target: float) -> int:
    """The least number of bands at which a pair at ``distance`` is missed with at most probability ``target``."""
    j = (BITS - distance) / (BITS + distance)
    return math.ceil(math.log(target) / math.log(1 - j**rows))


def rows_for(n: int) -> int:
    """Minima a band at which a value shares a band's bucket with about one of ``n`` values unrelated to it (whose similarity is a third)."""
    return max(8, math.ceil(math.log(max(n, 2), 3)))


def _band_keys(rows: int, bands: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Band keys of a batch of 64-bit hashes: each band combines ``rows`` minima over the 64 (position, bit) elements of a value.

    A hash function is a table of random numbers for the 128 possible elements; a value's minimum is that of its eight bytes' minima,
    which are tabulated too.
    """
    rng = np.random.default_rng(seed)
    of_element = rng.integers(0, 2**32, size=(rows * bands, 8, 8, 2), dtype=np.uint32)  # function, byte, place, bit
    byte = np.arange(256)
    of_byte = np.full((rows * bands, 8, 256), 2**32 - 1, dtype=np.uint32)
    for place in range(8):
        np.minimum(of_byte, of_element[:, :, place, :][:, :, (byte >> place) & 1], out=of_byte)
    mix = rng.integers(1, 2**63, size=rows, dtype=np.uint64) | np.uint64(1)

    def keys(values: np.ndarray) -> np.ndarray:
        parts = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
        out = np.zeros((bands, len(values)), dtype=np.uint64)
        for f in range(rows * bands):
            least = of_byte[f, 0][parts[0]]
            for k in range(1, 8):
                np.minimum(least, of_byte[f, k][parts[k]], out=least)
            band = out[f // rows]
            if f % rows == 0:
                band += np.uint64(f // rows + 1)
            band *= np.uint64(0x9E3779B97F4A7C15)
            band ^= (least.astype(np.uint64) + np.uint64(1)) * mix[f % rows]
            band ^= band >> np.uint64(29)
        return (out >> np.uint64(13)).astype(np.uint32).view(np.int32)

    return keys


def banded(values: DataFrame, rows: int, bands: int, seed: int) -> DataFrame:
    """(bucket, value): the bucket of each row of ``values(value bigint)`` in every band. Buckets of different bands share no number but by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = None
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(v), 2048):
                keys = keys or _band_keys(rows, bands, seed)
                part = v[at : at + 2048]
                yield pa.record_batch([pa.array(keys(part).reshape(-1)), pa.array(np.tile(part, bands))], names=["bucket", "value"])

    return values.mapInArrow(run, "bucket int, value bigint")


#: Values of one bucket that are compared under one key; a bucket expected to hold more is split into pairs of blocks.
BLOCK = 1024
#: At most so many values, chosen by a hash, are banded to tell which buckets those are. This decides how work is split, not what is found.
SAMPLE = 20_000


def _compare(group: np.ndarray, v: np.ndarray, own: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs within each group of rows; ``group`` is sorted. In the group of two blocks only pairs across them count (own differs)."""

    bits = np.ascontiguousarray(v).view(np.uint64)  # of a signed number, numpy counts the bits of its size

    def close(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (np.bitwise_count(bits[i] ^ bits[j]) <= distance) & (v[i] != v[j]) & ((own[i] < 0) | (own[i] != own[j]))
        a, b = v[i[ok]], v[j[ok]]
        return np.minimum(a, b), np.maximum(a, b)

    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, len(group)))
    in_small = np.repeat(size <= 64, size)
    i, step = np.flatnonzero(in_small), 1
    while len(i):
        i = i[i + step < len(group)]
        i = i[group[i + step] == group[i]]
        yield close(i, i + step)
        step += 1
    for s, n in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        for x in range(s, s + n, BLOCK):
            for y in range(x, s + n, BLOCK):
                p, q = bits[x : min(x + BLOCK, s + n)], bits[y : min(y + BLOCK, s + n)]
                i, j = np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= distance)
                keep = (x + i) < (y + j)
                yield close(x + i[keep], y + j[keep])


def near_values(values: DataFrame, distance: int, rows: int, bands: int, seed: int) -> DataFrame:
    """(a, b), a < b: distinct values that share a bucket and, verified on the whole hash, differ in at most ``distance`` bits.

    A bucket is sorted into one place and compared there, in blocks; one that is expected to hold many values is split beforehand, and
    each pair of its blocks is a place of its own.
    """
    n = values.count()
    sample = values.orderBy(F.xxhash64("value"), "value").limit(SAMPLE)
    scale = max(1.0, n / SAMPLE)
    counts = banded(sample, rows, bands, seed).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # of at most SAMPLE times bands keys; a count below 4 tells little
    hot = cut(counts.filter((F.col("n") * scale > BLOCK) & ((F.col("n") >= 4) | F.lit(scale == 1.0))).select("bucket", F.ceil(F.col("n") * scale / BLOCK).cast("int").alias("blocks"))) if n > BLOCK else None
    keyed = banded(values, rows, bands, seed)
    if hot is not None and not hot.isEmpty():
        keyed = keyed.join(F.broadcast(hot), "bucket", "left")
        own = F.pmod(F.xxhash64("value"), F.col("blocks")).cast("int")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keyed = keyed.select("bucket", "value", "blocks", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
        place = F.coalesce(F.least("own", "other").cast("bigint") * F.col("blocks") + F.greatest("own", "other"), F.lit(0))
        # under the place of a block with itself there is that block alone; under that of two blocks, both
        keyed = keyed.select("bucket", place.alias("place"), F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("own"), "value")
    else:
        keyed = keyed.select("bucket", F.lit(0).cast("bigint").alias("place"), F.lit(-1).alias("own"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            bucket, place, own, v = t
            new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (place[1:] != place[:-1])))
            for a, b in _compare(np.cumsum(new), v, own, distance):
                if len(a):
                    yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        rest: list[list[np.ndarray]] = []
        for batch in batches:
            t = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(t[0]):
                continue
            # the last group may go on in the next batch
            last = int(np.flatnonzero(np.concatenate(([True], (t[0][1:] != t[0][:-1]) | (t[1][1:] != t[1][:-1]))))[-1])
            goes_on = rest and last == 0 and rest[-1][0][-1] == t[0][0] and rest[-1][1][-1] == t[1][0]
            if not goes_on:
                whole = [np.concatenate(c) for c in zip(*rest, [c[:last] for c in t], strict=True)]
                if len(whole[0]):
                    yield from pairs(whole)
                rest = []
            rest.append([c[last:] if not goes_on else c for c in t])
        if rest:
            yield from pairs([np.concatenate(c) for c in zip(*rest, strict=True)])

    placed = keyed.repartition("bucket", "place").sortWithinPartitions("bucket", "place")
    return placed.mapInArrow(run, "a bigint, b bigint").distinct()


class NearDuplicates:
    """Rows linked by an equal digest, or by 64-bit hashes within ``distance`` bits.

    ``records`` needs an id, a hex digest and a hex hash column. Digits count in either case. A null or empty
    digest equals none; a hash that is not exactly 16 hex digits is close to none; rows with a null id are
    left out and a row delivered again counts once. Equal hashes are one class: only class representatives are
    banded and compared, members follow by joins, and links are not closed transitively. There are as many minima a band as the number
    of distinct hashes asks for (``rows_for``) and as many bands as bring the chance of missing a pair at the full distance down to ``miss``
    (``bands_for``), by default a tenth of a pair in a thousand million. There is no cap on buckets, partners or candidates.
    """

    def __init__(self, records: DataFrame, item: str, digest: str, phash: str, distance: int = 3, miss: float = 1e-10, seed: int = 20):
        sha = F.lower(F.col(f"`{digest}`"))
        self.members = cut(
            records.select(F.col(f"`{item}`").alias("item"), F.when(sha != "", sha).alias("sha"), hash_bits(F.col(f"`{phash}`")).alias("value")).filter("item IS NOT NULL").distinct()
        )
        self.values = cut(self.members.filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("head")))
        self.rows = rows_for(self.values.count())
        self.bands = bands_for(distance, self.rows, miss)
        self.near = cut(near_values(self.values.select("value"), distance, self.rows, self.bands, seed))

    def pairs(self) -> DataFrame:
        """(a, b), a < b: every linked pair of different ids, for results defined as pairs."""
        m = self.members
        return union_all([pairs_within(m, ["sha"], "item"), pairs_within(m, ["value"], "item"), member_pairs(self.near, m, "value", "item")]).distinct()

    def groups(self) -> DataFrame:
        """(item, group_id, links): the least id of the component and the number of directly linked ids.

        Counted over (digest, hash) classes, so no class is expanded into pairs.
        """
        bare = "sha IS NULL AND value IS NULL"  # linked to nothing, so no class
        m = self.members.filter(f"NOT ({bare})")
        classes = cut(m.groupBy("sha", "value").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("head")))
        by_sha = classes.filter("sha IS NOT NULL").groupBy("sha").agg(F.sum("n").alias("in_sha"), F.min("head").alias("sha_head"), F.count(F.lit(1)).alias("k"))
        by_value = self.values.select("value", F.col("n").alias("in_value"), F.col("head").alias("value_head"))
        sides = self.near.unionByName(self.near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = sides.join(by_value.withColumnRenamed("value", "b"), "b").groupBy(F.col("a").alias("value")).agg(F.sum("in_value").alias("in_near"))
        c = classes.join(by_sha, "sha", "left").join(by_value, "value", "left").join(around, "value", "left")
        # classes of one digest with different hashes that are close: counted by both, so taken off once
        several = attach(classes.filter("value IS NOT NULL"), by_sha.filter("k > 1").select("sha", "k"), ["sha"], "k")
        pair = several.select("sha", F.col("value").alias("a")).join(sides, "a").join(several.select("sha", F.col("value").alias("b"), "n"), ["sha", "b"])
        both = pair.groupBy("sha", F.col("a").alias("value")).agg(F.sum("n").alias("in_both"))
        c = c.join(both, ["sha", "value"], "left")
        z = lambda x: F.coalesce(F.col(x), F.lit(0))
        same = F.when(F.col("sha").isNotNull() & F.col("value").isNotNull(), F.col("n")).otherwise(0)
        c = cut(c.select("sha", "value", "head", "n", "sha_head", "value_head", (F.greatest(F.lit(0), z("in_sha") + z("in_value") + z("in_near") - same - z("in_both") - 1)).alias("links")))
        heads = self.near.join(by_value.select(F.col("value").alias("a"), F.col("value_head").alias("u")), "a").join(by_value.select(F.col("value").alias("b"), F.col("value_head").alias("v")), "b").select("u", "v")
        stars = [c.select(F.col("head").alias("u"), F.col(x).alias("v")) for x in ("sha_head", "value_head")]
        found = components(c.select(F.col("head").alias("vertex")), union_all([heads, *stars]))
        c = c.join(found, F.col("head") == F.col("vertex")).select("sha", "value", "n", "component", "links")
        keyed = lambda d: d.withColumn("k", F.md5(F.concat_ws("|", F.coalesce("sha", F.lit("-")), F.coalesce(F.col("value").cast("string"), F.lit("-")))))
        out = attach(keyed(m).select("item", "k"), keyed(c).select("k", "n", "component", "links"), ["k"], "n")
        alone = self.members.filter(bare).select("item", F.lit(None).cast("string").alias("k"), F.lit(1).cast("bigint").alias("n"), F.col("item").alias("component"), F.lit(0).cast("bigint").alias("links"))
        return out.unionByName(alone).groupBy("item").agg(F.min("component").alias("group_id"), F.max("links").alias("links"))


"""Joins and pair expansion that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.lineage import cut

#: Keys whose rows are joined by broadcast. At most this many rows are ever broadcast; any other key
#: then holds less than 1/HOT_KEYS of all rows, which one task can take.
HOT_KEYS = 512


def attach(left: DataFrame, right: DataFrame, keys: list[str], weight: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``left`` with ``right``, which is unique on ``keys``.

    ``weight`` is a column of ``right`` that counts (about) the key's rows in ``left``. The ``hot_keys``
    heaviest keys are broadcast, so their rows never meet in one task; the rest is left to an ordinary
    join. Null keys match nothing. An empty side gives an empty result.
    """
    right = cut(right)
    hot = right.orderBy(F.desc(weight), *keys).limit(hot_keys)
    mark = hot.select(*keys)
    heavy = left.join(F.broadcast(hot), keys)
    light = left.join(F.broadcast(mark), keys, "left_anti").join(right, keys)
    return heavy.unionByName(light)


def pairs_within(members: DataFrame, keys: list[str], item: str, block: int = 1024) -> DataFrame:
    """Every pair (a, b), a < b, of distinct items that share all ``keys``: columns ``a`` and ``b``.

    For results that are defined as pairs. A class of n items is split into ceil(n / block) blocks, and
    each pair of blocks is a join key of its own, so that a hot class spreads over many tasks. Items with a
    null key pair with nothing; a repeated (keys, item) row counts once.
    """
    members = cut(members.select(*keys, F.col(item).alias("__item")).dropna(subset=keys).distinct())
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    blocks = (
        attach(members, sizes, keys, "__n")
        .withColumn("__blocks", F.ceil(F.col("__n") / block).cast("long"))
        .withColumn("__own", F.pmod(F.xxhash64("__item"), F.col("__blocks")))
        .withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
        .select(*keys, "__item", "__own", F.least("__own", "__other").alias("__i"), F.greatest("__own", "__other").alias("__j"))
    )
    on = [*keys, "__i", "__j"]
    a = blocks.select(*on, F.col("__item").alias("a"), F.col("__own").alias("__own_a"))
    b = blocks.select(*on, F.col("__item").alias("b"), F.col("__own").alias("__own_b"))
    once = (F.col("__i") == F.col("__j")) | (F.col("__own_a") != F.col("__own_b"))
    return a.join(b, on).filter((F.col("a") < F.col("b")) & once).select("a", "b")


#: Classes of more than one block of members are broadcast up to this many, counted beforehand; beyond it they are joined by a shuffle.
BROADCAST_CLASSES = 200_000


def member_pairs(pairs: DataFrame, members: DataFrame, key: str, item: str, block: int = 1024) -> DataFrame:
    """Every pair (a, b), a < b, of different items whose classes are paired in ``pairs(a, b)``; ``members`` has each class's ``key`` and ``item``.

    For results that are defined as pairs. A class of n members is split into ceil(n / block) blocks, and each block of the one class meets
    each of the other under a join key of its own, so that two large classes spread over many tasks. Null keys and items pair with
    nothing; repeated rows count once.
    """
    members = cut(members.select(F.col(key).alias("key"), F.col(item).alias("item")).dropna().distinct())
    large = cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    many = large.count()
    own, spread = members.withColumn("block", F.lit(0)), pairs.select("a", "b", F.lit(0).alias("i"), F.lit(0).alias("j"))
    if many:
        by = F.broadcast(large) if many <= BROADCAST_CLASSES else large
        blocks = F.coalesce("blocks", F.lit(1))
        own = members.join(by, "key", "left").select("key", "item", F.pmod(F.xxhash64("item"), blocks).cast("int").alias("block"))
        spread = pairs.select("a", "b")
        for side, name in (("a", "i"), ("b", "j")):
            spread = spread.join(by.withColumnRenamed("key", side), side, "left").withColumn(name, F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    a = own.select(F.col("key").alias("a"), F.col("block").alias("i"), F.col("item").alias("x"))
    b = own.select(F.col("key").alias("b"), F.col("block").alias("j"), F.col("item").alias("y"))
    both = spread.join(a, ["a", "i"]).join(b, ["b", "j"]).filter("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

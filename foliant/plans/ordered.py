"""Running numbers and carried values over ordered rows, in blocks, so that no long partition is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in one block of an ordered partition.
BLOCK = 65_536


def numbered(df: DataFrame, keys: list[str], order: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``out``: each row's number from 0 among the rows with its keys, by the whole-number column ``order``.

    Rows are numbered within (keys, block of positions); blocks' counts, a small table, are summed over earlier blocks. Null keys
    form a key; rows of equal position are numbered in any order.
    """
    df = df.withColumn("__block", F.floor(F.col(order) / block))
    sizes = df.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).filter("__before > 0").drop("__n")
    local = df.withColumn("__local", F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order)) - 1)
    s = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__kb"), "__before")
    on = F.col("__block") == F.col("__kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = local.join(s, on, "left")
    return joined.withColumn(out, (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("bigint")).select(*[c for c in df.columns if c != "__block"], out)


def carried(df: DataFrame, key: str, order: str, sums: dict[str, Column], lasts: dict[str, Column], nexts: dict[str, Column], block: int = 4096) -> DataFrame:
    """``df`` with running values along ``order`` within ``key``.

    ``sums``: total of the expression up to and with the row. ``lasts``: its last value that isn't null, up to and with the row.
    ``nexts``: its first value that isn't null after the row. Each is found within blocks of positions, and carried across
    blocks over a table of one row a block.
    """
    df = df.withColumn("__block", F.floor(F.col(order) / block)).withColumns({f"__e_{n}": e for n, e in (sums | lasts | nexts).items()})
    at = F.col(order)
    given = lambda n: F.when(F.col(f"__e_{n}").isNotNull(), at)
    ends = df.groupBy(key, "__block").agg(
        *[F.sum(f"__e_{n}").alias(f"__b_{n}") for n in sums],
        *[F.max_by(f"__e_{n}", given(n)).alias(f"__b_{n}") for n in lasts],
        *[F.min_by(f"__e_{n}", given(n)).alias(f"__b_{n}") for n in nexts],
    )
    by_block = Window.partitionBy(key).orderBy("__block")
    before, after = by_block.rowsBetween(Window.unboundedPreceding, -1), by_block.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(
        F.col(key).alias("__key"),
        F.col("__block").alias("__kb"),
        *[F.coalesce(F.sum(f"__b_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums],
        *[F.last(f"__b_{n}", True).over(before).alias(f"__c_{n}") for n in lasts],
        *[F.first(f"__b_{n}", True).over(after).alias(f"__c_{n}") for n in nexts],
    )
    w = Window.partitionBy(key, "__block").orderBy(order)
    upto, rest = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    local = df.select(
        "*",
        *[F.sum(f"__e_{n}").over(upto).alias(f"__l_{n}") for n in sums],
        *[F.last(f"__e_{n}", True).over(upto).alias(f"__l_{n}") for n in lasts],
        *[F.first(f"__e_{n}", True).over(rest).alias(f"__l_{n}") for n in nexts],
    )
    joined = local.join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__kb")))
    kept = [c for c in df.columns if c != "__block" and not c.startswith("__e_")]
    return joined.select(
        *kept,
        *[(F.coalesce(f"__l_{n}", F.lit(0)) + F.col(f"__c_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"__l_{n}", f"__c_{n}").alias(n) for n in (lasts | nexts)],
    )

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.plans import skew
from foliant.plans.components import components
from foliant.plans.lineage import cut, shared_dir
from foliant.plans.ordered import carried, numbered
from foliant.plans.skew import attach, pairs_within
from tests.conftest import rows


def test_cut_keeps_rows_in_the_shared_folder(spark):
    df = cut(spark.range(5).withColumn("s", F.lit(None).cast("string")))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    assert df.count() == 5 and any(p.name.startswith("cut-") for p in folder.iterdir())


class _Cluster:
    """A session on a cluster that names no shared folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815


def test_a_cluster_must_name_the_folder():
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(_Cluster)
    named = type("Named", (_Cluster,), {"conf": type("conf", (), {"get": staticmethod(lambda key, default=None: "hdfs:///x/")})})
    assert shared_dir(named) == "hdfs:///x"


def test_attach_hot_key(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [("a", 1), ("b", 2), (None, 3)], "k string, x int")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    for hot in (1, 2, 100):
        assert rows(attach(left, right, ["k"], "n", hot), "k", "x", "n") == sorted([("hot", i, 300) for i in range(300)] + [("a", 1, 1), ("b", 2, 1)], key=repr)
    assert attach(left.limit(0), right, ["k"], "n").count() == 0


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_pairs_within(spark, block):
    data = [("x", i) for i in range(11)] + [("y", 1), ("z", None), (None, 4), ("x", 3), ("w", 7), ("w", 8)]
    got = rows(pairs_within(spark.createDataFrame(data, "k string, i int"), ["k"], "i", block))
    assert got == sorted([(a, b) for a in range(11) for b in range(a + 1, 11)] + [(7, 8)], key=repr)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)] + [(500, i) for i in range(501, 560)] + [(None, 3), (7, 7)]
    n = list(range(600))
    parent = list(n)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = rows(components(spark.createDataFrame([(i,) for i in n], "vertex int"), spark.createDataFrame(edges, "u int, v int")))
    assert got == sorted([(i, find(i)) for i in n], key=repr)


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "u int, v int")
    assert rows(components(spark.createDataFrame([(4,)], "vertex int"), none)) == [(4, 4)]
    assert components(none.select(F.col("u").alias("vertex")), none).count() == 0


def test_numbered_across_blocks(spark):
    data = [("a", i) for i in range(0, 100, 3)] + [(None, i) for i in range(5)]
    df = spark.createDataFrame(data, "k string, o int")
    assert rows(numbered(df, ["k"], "o", "n", 10)) == sorted([("a", 3 * i, i) for i in range(34)] + [(None, i, i) for i in range(5)], key=repr)


@pytest.mark.parametrize("block", [1, 3, 100])
def test_carried(spark, block):
    data = [(1, i, i % 4 == 0, "h%d" % i if i % 5 == 0 else None) for i in range(20)] + [(2, 0, False, None)]
    df = spark.createDataFrame(data, "k int, o int, f boolean, h string")
    got = rows(carried(df, "k", "o", {"n": F.col("f").cast("int")}, {"last": F.col("h")}, {"next": F.when(F.col("f"), F.col("o"))}, block), "k", "o", "n", "last", "next")
    want = [(1, i, i // 4 + 1, f"h{i // 5 * 5}", i // 4 * 4 + 4 if i < 16 else None) for i in range(20)] + [(2, 0, 0, None, None)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("most", [0, 1000])
@pytest.mark.parametrize("block", [1, 7, 1024])
def test_member_pairs(spark, monkeypatch, block, most):
    monkeypatch.setattr(skew, "BROADCAST_CLASSES", most)
    members = [("a", i) for i in range(20)] + [("b", i) for i in range(15, 30)] + [("c", 50), ("d", 60), ("a", 3), (None, 9), ("a", None)]
    pairs = [("a", "b"), ("b", "c"), ("c", "x"), (None, "d")]
    at = {}
    for k, i in members:
        if k and i is not None:
            at.setdefault(k, set()).add(i)
    want = {(min(x, y), max(x, y)) for a, b in pairs if a in at and b in at for x in at[a] for y in at[b] if x != y}
    got = skew.member_pairs(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(members, "k string, i int"), "k", "i", block)
    assert rows(got) == sorted(want, key=repr)

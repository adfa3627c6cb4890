import pytest
from pyspark.sql import functions as F

from foliant.llm.records import collapse, normal_text
from tests.conftest import rows

SCHEMA = "id int, doc string, name string, n int, parts array<struct<a:string,b:string>>, alts string"
HOW = {"columns": ["doc", "name", "n", "parts", "alts"], "exact": {"doc"}, "delimited": {"alts": "[/|;,]"}}


def groups(spark, *data, schema=SCHEMA, **how):
    return rows(collapse(spark.createDataFrame(list(data), schema), "id", **(how or HOW)))


def test_spelling_order_and_nulls(spark):
    base = ("d", "Reg_A", 8, [("x", "1"), ("y", None)], "A1/B2")
    got = groups(
        spark,
        (5, *base),
        (2, "d", " reg-a. ", 8, [("Y", None), ("X!", "1"), ("x", "(1)")], "b_2 ; a1,"),  # a copy
        (3, "D", *base[1:]),  # another document
        (4, "d", "Reg_A", 9, *base[3:]),  # another number
        (6, "d", "Reg_A", 8, [("x", "1"), ("y", "")], "A1/B2"),  # empty is not null
        (7, "d", "Reg_A", 8, None, "A1/B2"),
        (8, "d", "Reg_A", 8, [], "A1/B2"),
        (9, "d", "Reg_A", 8, [("x", None), ("y", "1")], "A1/B2"),  # members swapped
        (5, *base),  # delivered again
        (None, *base),
    )
    assert got == [(2, 2, 2), (3, 3, 1), (4, 4, 1), (5, 2, 2), (6, 6, 1), (7, 7, 1), (8, 8, 1), (9, 9, 1)]


def test_null_equals_null(spark):
    assert groups(spark, (1, *[None] * 5), (2, *[None] * 5), (3, None, "", None, None, None), (4, None, "--", None, None, None)) == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2)]


def test_empty(spark):
    assert groups(spark) == []


@pytest.mark.parametrize(("a", "b", "same"), [("MicroSecond µ", "MICROSECOND Μ", True), ("straße", "STRASSE", True), ("K", "k", True), ("a1", "a 1", True), ("a1", "al", False), ("é", "e", False), ("x²", "x", False)])
def test_case(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(normal_text(F.col("a")), normal_text(F.col("b"))).first()
    assert (r[0] == r[1]) is same


def test_hot_group_and_clashing_names(spark):
    df = spark.range(2000).select(F.col("id").cast("int"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("name"), F.lit(1).alias("digest"), F.lit(2).alias("shape"), F.lit(3).alias("record_id"), F.lit(4).alias("__row"))
    got = collapse(df, "id", ["name"])
    assert got.filter("first_id = 0").count() == 667 and got.count() == 2000 and got.filter("copies = 667").count() == 667


def test_maps_and_ordered_arrays(spark):
    schema = "id int, m map<string,int>, xs array<string>"
    data = [(1, {"A": 1, "b": 2}, ["p", "q"]), (2, {"B": 2, "a": 1}, ["P", "q!"]), (3, {"a": 1, "b": 2}, ["q", "p"])]
    assert groups(spark, *data, schema=schema, columns=["m", "xs"], ordered={"xs"}) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
    assert groups(spark, *data, schema=schema, columns=["m", "xs"]) == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]


def test_long_text(spark):
    long = "word " * 200_000
    assert groups(spark, (1, long), (2, long.upper()), (3, long + "x"), schema="id int, t string", columns=["t"]) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]


@pytest.mark.parametrize("most", [0, 1000])
def test_digest_collision(spark, monkeypatch, most):
    """Two structures with one digest stay apart, whether groups are broadcast to their members or not."""
    from foliant.llm import records

    monkeypatch.setattr(records, "BROADCAST_GROUPS", most)
    real = records.digested
    monkeypatch.setattr(records, "digested", lambda *a, **k: real(*a, **k).withColumns({"x": F.lit(1).cast("bigint"), "y": F.lit(2).cast("bigint")}))
    assert groups(spark, (1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, "C!"), schema="id int, t string", columns=["t"]) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (5, 4, 2)]

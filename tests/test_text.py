from pyspark.sql import functions as F

from foliant.functions import text as T
from tests.conftest import rows


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0]


def test_whole_term(spark):
    cases = [("CAN", "CAN-FD bus", True), ("CAN", "SCAN mode", False), ("CAN", "can_1", False), ("P20.3", "pin P20.3, out", True), ("P20.3", "P2013", False), ("scu", "éscu", False), ("", "x", False), (" can ", "a CAN", True), (r"a\E.", r"x a\E. y", True)]
    for term, said, want in cases:
        assert one(spark, said, lambda c: T.whole_term(c, term)) is want, (term, said)
    assert one(spark, None, lambda c: T.whole_term(c, "a")) is False


def test_words_and_norm(spark):
    said = "  A b,\n\tC d  "
    assert one(spark, said, T.tokens) == said.lower().split() and one(spark, None, T.tokens) == []
    assert one(spark, said, T.norm) == said.strip().lower() and one(spark, None, T.norm) == ""
    assert one(spark, "", T.word_count) == 0


def test_safe_int(spark):
    assert [one(spark, x, T.safe_int) for x in ("12", " 7 ", "12.0", "x", None, "-3")] == [12, 7, None, None, None, -3]


def test_hamming(spark):
    df = spark.createDataFrame([("00", "07"), ("00", "0f"), ("zz", "00"), (None, "00"), ("ffffffffffffffff", "0000000000000000"), ("FFFFFFFFFFFFFFFF", "fffffffffffffffe")], "a string, b string")
    assert [r[0] for r in df.select(T.hamming_hex("a", "b")).collect()] == [3, 4, 64, 64, 64, 1]


def test_json_object(spark):
    assert [one(spark, x, T.json_object) for x in ('```json\n{"a":1}\n```', 'note {"a":1} end', "[1]", "{a", None, "")] == ['{"a":1}', '{"a":1}', None, None, None, None]


def test_html_escape(spark):
    assert one(spark, "<a b=\"c\">&'", T.html_escape) == "&lt;a b=&quot;c&quot;&gt;&amp;&#39;"


def test_first_text(spark):
    df = spark.createDataFrame([("", None, "c"), (None, "b", "c"), (None, None, None)], "a string, b string, c string")
    assert rows(df.select(T.first_text("a", "b", "c").alias("x"))) == sorted([("c",), ("b",), (None,)], key=repr)

import pytest

from foliant.llm import lookalike as L
from tests.conftest import rows

SAME = [("ｆｕｌｌ １", "full 1"), ("é", "é"), ("ﬁle", "file"), ("5 µs", "5 μs"), ("kΩ", "kΩ"), ("СAN", "CAN"), ("ΑB", "AB"), ("a\xa0b", "a b"), ("a　b", "a b"), ("a\tb", "a b"), ("a​b﻿", "ab"), ("a\xadb", "ab"), ("Å", "Å"), ("pау", "pay"), ("ї", "ï"), ("Ａ́", "Á")]
DIFFERENT = [("A", "a"), ("e", "é"), ("x²", "x2"), ("O", "0"), ("l", "I"), ("a.", "a"), ("a\nb", "a b"), ("a  b", "a b"), ("“a”", '"a"'), ("–", "-"), ("½", "1/2"), ("…", "..."), ("ß", "ss"), ("ø", "o"), ("①", "1"), ("ª", "a"), ("в", "B")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert L.skeleton(a) == L.skeleton(b) and L.consistent_text(a) == L.consistent_text(b) and a != b


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert L.skeleton(a) != L.skeleton(b) and L.consistent_text(a) != L.consistent_text(b)


def test_skeleton_is_stable():
    for a, b in SAME:
        for t in (a, b, L.consistent_text(a)):
            assert L.skeleton(L.skeleton(t)) == L.skeleton(t)
            assert L.skeleton(L.consistent_text(t)) == L.skeleton(t)


def test_readable_form():
    assert L.consistent_text("требует счётчик") == "требует счётчик"
    assert L.consistent_text("СAN é ｘ") == "CAN é x"
    assert len(L.LOOK_ALIKES.split()) < 200


SCHEMA = "id bigint, t string"


def test_pairs(spark):
    data = [(1, "CAN"), (2, "СAN"), (3, "CAN"), (4, "C​AN"), (5, "can"), (6, None), (None, "CAN"), (2, "СAN"), (7, ""), (8, "​"), (9, ""), (10, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(L.look_alike_pairs(df, "id", "t")) == sorted([(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8), (8, 9)], key=repr)
    form = dict(rows(L.consistent(df, "id", "t")))
    assert form[2] == form[4] == "CAN" and form[6] is None and form[8] == ""


def test_empty_hot_and_long(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert L.look_alike_pairs(df, "id", "t").count() == 0 and L.consistent(df, "id", "t").count() == 0
    hot = spark.createDataFrame([(i, "same") for i in range(1500)] + [(5000, "sаme"), (5001, "é" * 300_000), (5002, "é" * 300_000)], SCHEMA)
    got = L.look_alike_pairs(hot.selectExpr("*", "1 AS item", "2 AS look", "3 AS exact"), "id", "t")
    assert got.count() == 1501


@pytest.mark.parametrize(("a", "b"), [("ı", "i"), ("ɑ", "a"), ("ɡ", "g"), ("ⅰ", "i"), ("Ⅳ", "IV"), ("ᴏ", "o")])
def test_more_latin_letters(a, b):
    assert L.skeleton(a) == L.skeleton(b)


def test_members_of_two_hot_texts(spark):
    """Copies of two texts that look the same: every cross pair, and none of equal texts."""
    df = spark.range(60).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'aеb' ELSE 'aeb' END AS t", "1 AS look", "2 AS exact")
    assert L.look_alike_pairs(df, "id", "t").count() == 20 * 40

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import boilerplate
from foliant.llm.boilerplate import RepeatedLines
from tests.conftest import rows

SCHEMA = "seq bigint, doc_id string, text string"


def lines(spark, data, least=3):
    return RepeatedLines(spark.createDataFrame(data, SCHEMA), "seq", "doc_id", "text", least)


def brute(data, least):
    """Line classes, and each position's longest block, by trying every block length."""
    docs = {s: (d, [(i, " ".join(x.split()).upper()) for i, x in enumerate(t.split("\n"), 1) if x.strip()]) for s, d, t in data if None not in (s, d, t)}
    spans = defaultdict(set)
    for s, (d, ls) in docs.items():
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                spans[d, tuple(x for _, x in ls[a:b])].add(s)
    found, blocks = [], []
    for s, (d, ls) in docs.items():
        end = 0
        for a in range(len(ls)):
            good = [b for b in range(a + 1, len(ls) + 1) if len(spans[d, tuple(x for _, x in ls[a:b])]) >= least]
            if good:
                found.append((s, ls[a][0]))
                b = max(good)
                if b > end:
                    blocks.append((s, ls[a][0], b - a, len(spans[d, tuple(x for _, x in ls[a:b])])))
                end = max(end, b)
    return sorted(found, key=repr), sorted(blocks, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    notice = [f"notice {chr(97 + i)}" for i in range(7)]
    data = []
    for s in range(40):
        a = rng.randrange(7)
        data.append((s, rng.choice("xy"), "\n".join([f"own {chr(97 + s % 26)} {s // 26 * 'z'}", *notice[a : a + rng.randrange(8)], "", *rng.sample(notice, 2)])))
    found, blocks = brute(data, 3)
    r = lines(spark, data)
    assert rows(r.occurrences(), "item", "line_no") == found
    assert rows(r.blocks(), "item", "line_no", "lines", "documents") == blocks


@pytest.mark.parametrize("seed", [4, 5])
def test_stretches_over_partition_edges(spark, seed):
    """Many small partitions, so that most stretches run over an edge."""
    rng = random.Random(seed)
    notice = [f"notice {chr(97 + i)}" for i in range(5)]
    data = [(s, "x" if rng.random() < 0.8 else "y", "\n".join([*notice[rng.randrange(3) :], f"own {s * 'z'}", *rng.sample(notice, 2)])) for s in range(50)]
    found, blocks = brute(data, 8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        r = lines(spark, data, 8)
        assert rows(r.occurrences(), "item", "line_no") == found
        assert rows(r.blocks(), "item", "line_no", "lines", "documents") == blocks
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_come_from_the_intervals(spark, monkeypatch):
    """Without the stretches of the suffix order nothing is found."""
    data = [(i, "d", "same line") for i in range(9)]
    assert lines(spark, data).occurrences().count() == 9
    none = lambda t, least: (np.zeros(len(t["x"]), np.int8), np.zeros(len(t["x"]), np.int8), [])
    monkeypatch.setattr(boilerplate, "_intervals", none)
    assert lines(spark, data).occurrences().count() == 0


def test_common_prefixes():
    head = [np.array(v) for v in ([1, 1, 1, 2, 2], [5, 5, 5, 5, 5], [3, 3, 4, 0, 0], [6, 7, 7, 0, 0], [8, 8, 8, 0, 0])]
    assert boilerplate.common_prefixes(head).tolist() == [2, 1, 0, 1]


def test_one_id_with_two_texts(spark):
    data = [(i, "d", "n\nown" + "z" * i) for i in range(4)] + [(0, "d", "other\nn")]
    r = lines(spark, data, 4)
    assert rows(r.occurrences(), "item", "line_no") == [(0, 1), (0, 2), (1, 1), (2, 1), (3, 1)]
    assert rows(r.cleaned(), "item", "text") == [(0, "other"), (0, "own"), (1, "ownz"), (2, "ownzz"), (3, "ownzzz")]


def test_what_makes_lines_equal(spark):
    same = ["Page 1 of 20", "  page\t12   OF 3 ", "PAGE 999 of 0", "page\xa07 of 1"]
    data = [(i, "d", f"x{chr(97 + i)}\n\n{t}") for i, t in enumerate(same)] + [(9, "e", "Page 1 of 2"), (10, "d", "Page one of 2"), (11, "d", "Pa ge 1 of 2")]
    assert rows(lines(spark, data, 4).occurrences(), "item", "line_no") == [(i, 3) for i in range(4)]


def test_counts_documents_not_lines(spark):
    data = [(1, "d", "n\nn\nn"), (2, "d", "n"), (2, "d", "n"), (None, "d", "n"), (3, None, "n"), (4, "d", None), (5, "d", ""), (6, "d", "\n \n")]
    assert lines(spark, data).occurrences().count() == 0
    r = lines(spark, [*data, (7, "d", "a\nN \nb")])
    assert rows(r.occurrences(), "item", "line_no") == [(1, 1), (1, 2), (1, 3), (2, 1), (7, 2)]
    clean = dict(rows(r.cleaned(), "item", "text"))
    assert clean == {1: "", 2: "", 3: "n", 4: None, 5: "", 6: "\n \n", 7: "a\nb"}


def test_empty_and_hot(spark):
    r = lines(spark, [])
    assert r.occurrences().count() == 0 and r.blocks().count() == 0 and r.cleaned().count() == 0
    hot = spark.range(3000).select(F.col("id").alias("seq"), F.lit("d").alias("doc_id"), F.concat(F.lit("top\nmiddle\n"), F.sha1(F.col("id").cast("string"))).alias("text"), F.lit(1).alias("rank"), F.lit(2).alias("item"))
    assert RepeatedLines(hot, "seq", "doc_id", "text").occurrences().count() == 6000

import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from foliant.operators import dense, fusion
from foliant.operators.lexical import LexicalIndex
from foliant.queries import retrieval
from tests.conftest import rows

TINY = [(1, "a b"), (2, "a c"), (3, "a")]


def search(spark, docs, queries, **k):
    index = LexicalIndex(spark.createDataFrame(docs, "id int, t string"), "id", "t")
    return index, rows(index.search(spark.createDataFrame(queries, "q int, t string"), "q", "t", **k))


def test_tiny_collection(spark):
    index, got = search(spark, TINY, [(1, "b"), (2, "a b"), (3, "b b"), (4, "a"), (5, ""), (6, None)])
    assert [g[:2] for g in got] == [(1, 1), (2, 1), (3, 1)]
    assert {g[0]: g[2] for g in got} == {1: 0.468647, 2: 0.397985, 3: 0.937295}
    assert {r.term: round(r.idf, 6) for r in index.term_stats.collect()} == {"a": -0.077022, "b": 0.510826, "c": 0.510826}
    assert not [g for g in got if g[0] in (4, 5, 6)]


def brute(docs, query):
    words = {i: (t or "").lower().split() for i, t in docs}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    score = {i: round(sum(idf.get(w, 0) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w in (query or "").lower().split()), 6) for i, ws in words.items()}
    return [(i, s) for i, s in sorted(score.items(), key=lambda x: (-x[1], x[0])) if s > 0][:8]


def test_against_brute_force(spark, folder):
    docs = duckdb.sql(f"SELECT DISTINCT seq, text FROM '{folder}/chunks.parquet'").fetchall()
    queries = duckdb.sql(f"SELECT item_id, text FROM '{folder}/eval_items.parquet'").fetchall()[:12]
    _, got = search(spark, docs, queries)
    want = [(q, i, s, k) for q, t in queries for k, (i, s) in enumerate(brute(docs, t), 1)]
    assert [g[:2] + g[3:] for g in got] == sorted([w[:2] + w[3:] for w in want], key=repr)


def test_empty_and_null(spark):
    index, got = search(spark, [], [(1, "a")])
    assert got == [] and index.n == 0
    docs = [(1, None), (2, "x y"), (2, "x y"), (None, "x"), (3, "z"), (4, "")]
    index, got = search(spark, docs, [(1, "x"), (None, "x")])
    assert index.n == 4 and [g[:2] for g in got] == [(1, 2)] and got[0][2] == brute([d for d in docs if d[0]], "x")[0][1]


def ranking(spark, *lists):
    return spark.createDataFrame([(1, ord(x), 1.0 / k, k) for k, x in enumerate(lists[0], 1)], "query_id int, item int, score double, rank int")


def fuse(spark, a, b):
    return [(chr(r.item), round(r.fused_score, 6)) for r in fusion.reciprocal_rank_fusion(ranking(spark, a), ranking(spark, b)).orderBy("rank").collect()]


def test_fusion(spark):
    assert fuse(spark, "abc", "bd") == [("b", 0.016261), ("a", 0.008197), ("d", 0.008065), ("c", 0.007937)]
    assert fuse(spark, "a", "b") == [("a", 0.008197), ("b", 0.008197)]
    assert fuse(spark, "", "b") == [("b", 0.008197)]


@pytest.mark.parametrize(("k", "n"), [(0, 6), (None, 6), (3, 3)])
def test_final(spark, k, n):
    assert fusion.final(ranking(spark, "abcdefgh"), k).count() == n


def vectors(spark, m):
    return spark.createDataFrame([(i, v) for i, v in enumerate(m)], "id bigint, v array<float>")


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 16)).astype(np.float32)
    df = vectors(spark, [list(map(float, v)) for v in m])
    got = rows(dense.nearest(df, "id", "v", df.filter("id % 100 = 0"), "id", "v"), "query_id", "item", "rank")
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    want = [(q, int(i), k) for q in (0, 100, 200) for k, i in enumerate(np.lexsort((np.arange(300), -np.round(unit @ unit[q], 6)))[:8], 1)]
    assert got == sorted(want, key=repr)


def test_nearest_edge_cases(spark):
    df = vectors(spark, [[1.0, 0.0], [1.0, 0.0], None, [], [0.0, 0.0], [0.0, 1.0]]).unionByName(vectors(spark, [[1.0, 0.0]]))
    got = rows(dense.nearest(df, "id", "v", df, "id", "v", k=2), "query_id", "item", "score", "rank")
    assert got == [(0, 0, 1.0, 1), (0, 1, 1.0, 2), (1, 0, 1.0, 1), (1, 1, 1.0, 2), (5, 0, 0.0, 2), (5, 5, 1.0, 1)]
    assert dense.nearest(df.limit(0), "id", "v", df, "id", "v").count() == 0
    assert dense.nearest(df, "id", "v", df.limit(0), "id", "v").count() == 0


def test_index_recall(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    q = e.filter("vec_id % 10 = 0")
    exact = {r[:2] for r in rows(dense.nearest(e, "vec_id", "embedding", q, "vec_id", "embedding"), "query_id", "item")}
    index = dense.InvertedFile(e, "vec_id", "embedding", lists=32)
    assert index.listed().count() == e.count()
    found = {r[:2] for r in rows(index.search(q, "vec_id", "embedding", probes=16), "query_id", "item")}
    assert len(exact & found) / len(exact) >= 0.9


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_index_recall_as_queried(spark, folder, size):
    data = f"{Path(folder).parent}/{size}"
    got = {r[:2] for r in rows(retrieval.dense_ann_topk(spark, data), "query_id", "vec_id")}
    exact = {r[:2] for r in rows(retrieval.dense_topk(spark, data), "query_id", "vec_id")}
    assert len(exact & got) / len(exact) >= 0.92


def test_index_recall_of_any_start(spark, folder):
    e = spark.read.parquet(f"{Path(folder).parent}/sf0.1/embeddings.parquet").cache()
    q = e.filter("vec_id % 20 = 0")
    exact = {r[:2] for r in rows(dense.nearest(e, "vec_id", "embedding", q, "vec_id", "embedding"), "query_id", "item")}
    for seed in (1, 2, 3):
        got = {r[:2] for r in rows(dense.InvertedFile(e, "vec_id", "embedding", seed=seed).search(q, "vec_id", "embedding"), "query_id", "item")}
        assert len(exact & got) / len(exact) >= 0.92
    e.unpersist()


def test_other_lengths_cost_nothing(spark):
    df = vectors(spark, [[1.0, 0.0], [0.6, 0.8], [1.0, 0.0, 0.0], [0.0, 1.0]]).coalesce(1)
    want = [(0, 0, 1), (0, 1, 2), (0, 3, 3), (1, 0, 3), (1, 1, 1), (1, 3, 2), (2, 2, 1), (3, 0, 3), (3, 1, 2), (3, 3, 1)]
    assert rows(dense.nearest(df, "id", "v", df, "id", "v"), "query_id", "item", "rank") == want
    assert rows(dense.InvertedFile(df, "id", "v", lists=2).search(df, "id", "v"), "query_id", "item", "rank") == want


def test_copies_push_nothing_out(spark):
    m = [[1.0, i / 10] for i in range(6)]
    df = spark.createDataFrame([(0, m[0])] * 30 + list(enumerate(m)), "id bigint, v array<float>").coalesce(1)
    want = [(0, i, i + 1) for i in range(4)]
    q = df.filter("id = 0")
    assert rows(dense.nearest(df, "id", "v", q, "id", "v", k=4), "query_id", "item", "rank") == want
    assert rows(dense.InvertedFile(df, "id", "v", lists=2).search(q, "id", "v", k=4), "query_id", "item", "rank") == want

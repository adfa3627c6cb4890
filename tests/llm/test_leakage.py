import inspect
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import leakage as L
from tests.conftest import rows


def leaks(spark, docs, items, **how):
    return L.leaks(spark.createDataFrame(docs, "id bigint, t string"), "id", "t", spark.createDataFrame(items, "item bigint, t string"), "item", "t", **how)


WORDS = [f"w{i}" for i in range(60)]


def test_exact_runs(spark):
    item = " ".join(WORDS[:20])
    docs = [
        (1, "before " + " ".join(WORDS[3:15]).upper() + " after"),
        (2, " ".join(WORDS[3:14])),  # eleven words
        (3, ", ".join(WORDS[8:20]) + "."),
        (4, "\n".join(WORDS[0:12])),
        (5, " ".join(WORDS[0:6] + ["x", "y", "z"] + WORDS[6:12])),
        (6, None), (None, item), (7, ""), (8, "_".join(WORDS[:12])), (4, "\n".join(WORDS[0:12])),
    ]
    items = [(10, item), (11, " ".join(WORDS[:11])), (12, None), (13, ""), (14, " ".join(reversed(WORDS[:20]))), (10, item)]
    got = rows(leaks(spark, docs, items).filter("distance = 0"), "doc_id", "item_id", "windows")
    assert got == [(1, 10, 1), (3, 10, 1), (4, 10, 1), (8, 10, 1)]


def test_every_exact_window_is_found(spark):
    """Against brute force, over random texts that quote the items."""
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 40)))) for i in range(30)]
    docs = []
    for d in range(150):
        quoted = rng.choice(items)[1].split()
        at, n = rng.randrange(len(quoted)), rng.randrange(5, 25)
        docs.append((d, " ".join([rng.choice(WORDS) for _ in range(10)] + quoted[at : at + n] + [rng.choice(WORDS) for _ in range(10)])))
    grams = lambda t: {tuple(t.split()[k : k + 12]) for k in range(len(t.split()) - 11)}
    want = sorted([(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)], key=repr)
    assert rows(leaks(spark, docs, items).filter("distance = 0"), "doc_id", "item_id") == want and want


def test_recall_of_edited_passages(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(14))) for i in range(200)]
    docs = []
    for i, t in items:
        w = t.split()
        k = 1 + rng.randrange(len(w) - 2)
        docs.append((i, " ".join(w[:k] + [["new"], [], ["new", w[k]]][i % 3] + w[k + 1 :])))
    got = {r[0] for r in rows(leaks(spark, docs, items).filter("doc_id = item_id"))}
    assert len(got) / len(items) >= 0.9


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 5)
    monkeypatch.setattr(L, "BLOCKS_A_PASS", 2)
    items = [(i, " ".join(f"a{i}b{k}" for k in range(14))) for i in range(7)]
    docs = [(i, t) for i, t in items]
    assert rows(leaks(spark, docs, items)) == [(i, i, 0, 3) for i in range(7)]
    shared = " ".join(f"a3b{k}" for k in range(12))  # another item's first window, in another pass
    assert rows(leaks(spark, docs, [*items, (9, shared + " x " + shared)]).filter("item_id = 9")) == [(3, 9, 0, 2)]
    assert leaks(spark, [], items).count() == 0 and leaks(spark, docs, []).count() == 0 and leaks(spark, docs, [(1, "too short")]).count() == 0


def test_long_text_and_clashing_names(spark):
    item = " ".join(WORDS[:15])
    docs = spark.createDataFrame([(1, "filler " * 400_000 + item)], "id bigint, t string").selectExpr("*", "1 AS doc_id", "2 AS item_id", "3 AS text")
    got = L.leaks(docs, "id", "t", spark.createDataFrame([(5, item)], "item bigint, t string"), "item", "t")
    assert rows(got) == [(1, 5, 0, 4)]


@pytest.mark.parametrize("seed", range(3))
def test_edit_distance(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 4, (50, 6)), rng.integers(0, 4, (50, 6))

    def slow(x, y):
        d = [[i + j if i * j == 0 else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
        return d[-1][-1]

    assert L.edit_distance(a, b).tolist() == [slow(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_recall_at_the_bound():
    """Two words replaced in items of exactly twelve, with the operator's own repeats and samples."""
    given = {k: p.default for k, p in inspect.signature(L.leaks).parameters.items()}
    for seed in (given["seed"], 1, 2, 3, 4, 5):
        rng = random.Random(seed + 100)
        items = [(i, [f"w{rng.randrange(400)}" for _ in range(12)]) for i in range(400)]
        docs = []
        for _, w in items:
            a, b = rng.sample(range(1, 11), 2)
            docs.append(" ".join(["left"] * 6 + ["new" if k in (a, b) else x for k, x in enumerate(w)] + ["right"] * 6))
        block = L._block({tuple(w): Counter({i: 1}) for i, w in items}, 12, 2, given["repeats"], given["samples"], seed)
        found = {d for d, i in L._search(block, list(range(400)), [t.split() for t in docs], 12, 2) if d == i}
        assert len(found) / len(items) >= 0.99


def brute(docs, items, width=12, edits=2):
    def distance(x, y):
        d = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            d, last = [i], d
            for j, b in enumerate(y, 1):
                d.append(min(d[-1] + 1, last[j] + 1, last[j - 1] + (a != b)))
        return d[-1]

    out = []
    for d, t in docs:
        x = L.words(t)
        for i, u in items:
            y = L.words(u)
            found = Counter(distance(x[a : a + width], y[b : b + width]) for a in range(len(x) - width + 1) for b in range(len(y) - width + 1) if len(set(x[a : a + width]) & set(y[b : b + width])) > width // 3)
            if found and min(found) <= edits:
                out.append((d, i, min(found), found[min(found)]))
    return sorted(out, key=repr)


def test_edited_passages_against_brute_force(spark):
    """Every edited passage with its distance and its pairs of windows."""
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12, 20)))) for i in range(12)]
    docs = []
    for d in range(40):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = ["new"] * rng.randrange(2)
        docs.append((d, " ".join(["left"] * rng.randrange(4) + w + ["right"] * rng.randrange(4))))
    want = brute(docs, items)
    assert len({r[2] for r in want}) == 3
    assert rows(leaks(spark, docs, items)) == want


def test_pieces_of_a_long_text(spark, monkeypatch):
    """Windows at the seams of a text that is searched in pieces count once."""
    item = " ".join(WORDS[:15])
    text = " ".join([*WORDS[20:50], item, *WORDS[20:31], item])
    b = pa.record_batch([pa.array([7]), pa.array([text])], names=["d", "t"])
    block = L._block({tuple(WORDS[k : k + 12]): Counter({5: 1}) for k in range(4)}, 12, 0, 64, 6, 6)
    for most in (5, 13, 40, 1000):
        monkeypatch.setattr(L, "_WORDS", most)
        total = Counter()
        for rows_, texts in L._batches(b, 12):
            for key, (dist, n) in L._search(block, rows_, texts, 12, 0).items():
                assert dist == 0
                total[key] += n
        assert total == {(0, 5): 8}

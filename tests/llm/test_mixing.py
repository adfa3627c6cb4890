import numpy as np
import pytest

from foliant.llm import mixing
from foliant.llm.mixing import OTHER, DomainClassifier, Mixture, tokenizer
from tests.conftest import rows

DOCS = "doc_id bigint, text string, source string"
TARGETS = "source string, weight double, max_repeats int"


def mixture(spark, docs, targets, **how):
    return Mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), **how)


def corpus(sizes, seed=1):
    rng = np.random.default_rng(seed)
    out, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            out.append((i, " ".join(f"{source}{rng.integers(50)}" for _ in range(rng.integers(5, 60))), source))
            i += 1
    return out


def test_shares_caps_and_total(spark):
    docs = corpus({"big": 600, "mid": 200, "small": 40, "unlisted": 300}) + [(9000, None, "big"), (9001, "", "small"), (None, "x y", "big"), (0, corpus({"big": 1})[0][1], "big")]
    m = mixture(spark, docs, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), (None, 0.5, 1)])
    s = {r.source: r for r in m.shares().collect()}
    for name, w, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)):
        assert abs(s[name].share - w) < 0.02 and s[name].most_uses <= cap and s[name].shortfall < 1e-6
    sel = m.selection()
    assert sel.filter("uses < 1").count() == 0 and sel.select("doc_id").distinct().count() == sel.count() and set(r.source for r in sel.select("source").distinct().collect()) == {"big", "mid", "small"}
    used = sum(r.uses * r.tokens for r in sel.collect())
    feasible = min(c * s[n].tokens_available / w for n, w, c in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)))
    assert abs(used - feasible) / feasible < 0.02  # the total is the largest that the caps allow
    assert abs(sum(r.share for r in s.values()) - 1) < 1e-9


def test_tokens_are_those_of_the_tokenizer(spark):
    m = mixture(spark, [(1, "Hello wörld, 你好!", "a"), (2, "two", "a")], [("a", 1.0, 1)])
    enc = tokenizer(m.ranks)
    assert dict(rows(m.members, "doc_id", "tokens")) == {1: len(enc.encode_ordinary("Hello wörld, 你好!")), 2: len(enc.encode_ordinary("two"))}
    assert rows(m.selection(), "doc_id", "uses") == [(1, 1), (2, 1)]


def test_missing_source_and_large_total(spark):
    docs = corpus({"a": 50, "b": 50})
    m = mixture(spark, docs, [("a", 0.4, 1), ("b", 0.4, 2), ("none", 0.2, 5)])
    s = {r.source: r for r in m.shares().collect()}
    assert s["none"].tokens_used == 0 and s["none"].share == 0 and s["none"].shortfall > 0 and abs(s["a"].share - 0.5) < 0.03
    big = mixture(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], total=1e9)
    assert {r.source: (r.most_uses, r.documents_used) for r in big.shares().collect()} == {"a": (1, 50), "b": (2, 50)}


def test_unlabelled_documents(spark):
    """A document without a source that reads like a listed one may be used; one that reads like another is not."""
    docs = corpus({"a": 120, "b": 120, "zzz": 120})
    more = [(5000 + i, t, None) for i, (_, t, s) in enumerate(corpus({"a": 6}, 7))] + [(6000 + i, t, None) for i, (_, t, s) in enumerate(corpus({"zzz": 6}, 8))]
    m = mixture(spark, docs + more, [("a", 0.5, 2), ("b", 0.5, 2)])
    rates = {r.doc_id: r.rate for r in m.rates().filter("source IS NULL").collect()}
    assert min(rates[i] for i in rates if i < 6000) > 1 and max(rates[i] for i in rates if i >= 6000) < 0.1
    used = {r.doc_id for r in m.selection().filter("source IS NULL").collect()}
    assert used and max(used) < 6000


def test_classifier_held_out():
    rng = np.random.default_rng(2)
    sample = [(d, list(rng.integers(0, 40, 30) + 25 * d)) for d in rng.integers(0, 3, 400)]
    model = DomainClassifier.fit(sample[:300], np.ones(3) / 3, 200)
    right = [int(model.posterior(ids).argmax()) == d for d, ids in sample[300:]]
    assert np.mean(right) > 0.9 and OTHER not in ("a", "b")


@pytest.mark.parametrize(("docs", "targets"), [([], [("a", 1.0, 1)]), ([(1, "x", "a")], []), ([(1, None, None)], [("a", 1.0, 1)]), ([(1, "x", "b")], [("a", 1.0, 1), ("c", 0.0, 2)])])
def test_nothing_to_mix(spark, docs, targets):
    m = mixture(spark, docs, targets)
    assert m.selection().count() == 0 and m.shares().filter("tokens_used > 0").count() == 0


def test_every_run_chooses_the_same(spark):
    docs, targets = corpus({"a": 80, "b": 20}), [("a", 0.7, 1), ("b", 0.3, 2)]
    assert rows(mixture(spark, docs, targets).selection()) == rows(mixture(spark, docs[::-1], targets).selection())


def test_a_nearly_empty_source_does_not_bind():
    totals, weight = np.array([100.0, 5e5, 9e5, 2e6]), np.array([0.1, 0.3, 0.3, 0.3])
    assert mixing.largest_total(totals, weight, 0.05) == 5e5
    assert mixing.largest_total(totals, weight, 0.0) == 100.0
    assert mixing.largest_total(np.array([7.0]), np.array([1.0]), 0.05) == 7.0

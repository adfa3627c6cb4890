import json

import pytest
from pyspark.sql import functions as F

from foliant import catalogue, cli
from foliant.functions.text import whole_term
from foliant.operators import audit as A
from foliant.sources.sinks import report_lines
from tests.conftest import rows


def graph_query(spark, folder, name):
    return catalogue.queries()[name](spark, folder)


CHUNK = "seq int, chunk_id string, doc_id string, chunk_type string, text string, page_start int, page_end int, section_path string"


def chunks(spark, *data):
    return spark.createDataFrame([(i, f"c{i}", *d) for i, d in enumerate(data)], CHUNK)


@pytest.mark.parametrize(("pages", "bad"), [((0, 0), False), ((3, 2), True), (("x", 1), True), ((-1, 2), True), ((None, 1), True)])
def test_pages(spark, pages, bad):
    df = spark.createDataFrame([tuple(None if p is None else str(p) for p in pages)], "page_start string, page_end string")
    assert df.select(A.invalid_pages()).first()[0] is bad


@pytest.mark.parametrize(("n", "bad"), [(459, False), (460, True)])
def test_oversized(spark, n, bad):
    assert chunks(spark, ("d", "structural", "w " * n, 1, 1, "s")).select(A.oversized()).first()[0] is bad
    assert chunks(spark, ("d", None, "w " * n, 1, 1, "s")).select(A.oversized()).first()[0] is False


def test_issues(spark):
    c = chunks(spark, ("d", "structural", "Same", 1, 1, "s"), ("d", "structural", " same ", 1, 1, "s"), (None, "odd", None, 3, 2, None), ("d", None, "x", 1, 1, "s"))
    got = dict(rows(A.issues(c), "check", "n"))
    assert got == {"missing_metadata": 2, "empty_text": 1, "invalid_pages": 1, "unknown_type": 2, "no_tables": 1, "duplicate_text": 1}
    assert rows(A.severities(A.issues(c))) == [(4, 2, True)]
    assert json.loads(A.report(A.issues(c)))["failed"] is True and report_lines(A.issues(c))[0].startswith("ERROR")
    assert rows(A.issues(c.limit(0)), "check", "n") == [("no_chunks", 1)]
    assert rows(A.duplicate_texts(A.chunks_once(c.unionByName(c))), "copies", "examples") == [(2, ("c0", "c1"))]


def test_differences(spark):
    c = chunks(spark, ("d", "structural", "a", 1, 1, "s"), ("d", "image_analysis", "b", 1, 1, "s"), ("e", "structural", "c", 1, 1, "s"))
    fresh = spark.createDataFrame([("d", "c0"), ("d", "new"), ("d", "c2")], "doc_id string, chunk_id string")
    assert rows(A.differences(c, fresh)) == [("d", 3, 1, 0)]
    assert rows(A.differences(c, fresh, True)) == [("d", 3, 1, 1)]


def test_alignment_equals_patterns(spark, folder):
    c = A.chunks_once(spark.read.parquet(f"{folder}/chunks.parquet"))
    terms = ["watchdog", "CTRL", "P20.3", "naïve", "clock divider", "SKU0_CFG4", "a", "no such"]
    want = [(t, r.seq) for t in terms for r in c.filter(whole_term("text", t)).select("seq").collect()]
    assert rows(A.alignments(c, terms), "term", "seq") == sorted(want, key=repr) and want
    assert dict(rows(A.aligned_terms(c, terms), "term", "matches"))["no such"] == 0


def test_terms_in_order():
    assert A.ordered_terms(["B", "a"], ["b ", "c", " ", "A"]) == ["B", "a", "c"]


def test_counts_take_null(spark):
    assert rows(A.counts(spark.createDataFrame([(None,), ("x",), (None,)], "t string"), "t")) == sorted([(None, 2), ("x", 1)], key=repr)
    assert F is not None


def test_graph_terms_are_aligned(spark, folder):
    c = chunks(spark, ("d", "structural", "the Watchdog and ADC_2", 1, 1, "s"))
    nodes = spark.createDataFrame([("n1", "ADC_2"), ("n2", "WATCHDOG"), ("n3", "GTM"), ("n4", None)], "node_id string, name string")
    terms = A.terms_with_graph(["watchdog"], nodes)
    assert terms == ["watchdog", "ADC_2", "GTM"]
    assert rows(A.aligned_terms(c, terms), "term", "matches") == [("ADC_2", 1), ("GTM", 0), ("watchdog", 1)]
    named = {r.term.lower() for r in graph_query(spark, folder, "graph_terms").collect()}
    assert named and named <= {r.term.lower() for r in graph_query(spark, folder, "audit_graph_term_alignment").collect()}


def test_graph_issues(spark):
    c = chunks(spark, ("d", "structural", "the watchdog", 1, 1, "s"))
    nodes = spark.createDataFrame([(i, n, None, None, None) for i, n in (("a", "watchdog"), ("b", "timer"), ("z", "lonely"))], "node_id string, name string, label string, class string, title string")
    edges = spark.createDataFrame([("a", "b", "x")], "src string, dst string, label string")
    found = lambda n, e, terms=("watchdog", "lonely", "none"): dict(rows(A.graph_issues(c, n, e, list(terms)), "check", "n"))
    assert found(nodes, edges) == {"isolated_nodes": 1, "term_absent": 1, "term_only_isolated": 1, "terms_not_in_chunks": 3}
    assert found(nodes, edges.limit(0))["no_edges"] == 1 and found(nodes, edges.limit(0), [])["isolated_nodes"] == 3
    assert found(nodes.limit(0), edges.limit(0)) == {"no_nodes": 1, "term_absent": 3, "terms_not_in_chunks": 2}
    assert rows(A.graph_issues(c, None, None, []), "severity", "check") == [("ERROR", "graph_missing")]


def test_search_issues(spark):
    hit = lambda q: q.filter("t = 'a'").selectExpr("q AS query_id")
    assert rows(A.search_issues(spark, ["a", "b"], hit), "check", "n") == [("search_empty", 1)]
    assert A.search_issues(spark, ["a"], hit).count() == 0
    assert rows(A.search_issues(spark, ["a"], lambda q: q.select("nothing")), "check", "n") == [("search_failed", 1)]


def test_command_line_checks_graph_and_fresh(spark, folder, tmp_path):
    spark.createDataFrame([("no such", "new")], "doc_id string, chunk_id string").write.parquet(f"{tmp_path}/fresh")
    assert cli.main(["audit", folder, "--live-search", "--fresh", f"{tmp_path}/fresh", "--json", f"{tmp_path}/r.json"]) == 1
    found = {i["check"] for i in json.loads((tmp_path / "r.json").read_text())["issues"]}
    assert {"terms_not_in_chunks", "stale_or_missing", "term_absent"} <= found

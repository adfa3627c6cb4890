from pyspark.sql import functions as F

from foliant.operators import graph as G
from foliant.operators.ontology import clean_items, fused
from tests.conftest import rows

NODE = "node_id string, name string, label string, class string, title string"


def graph(spark):
    nodes = spark.createDataFrame([("n1", None, "L", "C", None), ("CAN_0", None, None, None, None), ("n2", " Can two ", "", "C", None), ("n3", None, None, None, " T "), ("n4", "x" * 90, "L", "", None)], NODE)
    edges = spark.createDataFrame([("n1", "n2", "a"), ("n2", "n2", None), ("n1", "CAN_0", "")], "src string, dst string, label string")
    return nodes, edges


def test_lookup_names(spark):
    n, _ = graph(spark)
    assert rows(G.lookup(n, "can"), "node_id") == [("CAN_0",), ("n2",)]
    assert rows(G.lookup(n, "none", F.col("node_id") == "n1"), "node_id") == [("n1",)]
    assert G.lookup(n, "").count() == 5


def test_precedence_differs(spark):
    n, e = graph(spark)
    assert rows(G.label_counts(n)) == [("C", 1), ("L", 2), ("unknown", 2)]
    assert rows(G.group_counts(n)) == [("C", 2), ("L", 1), ("Unknown", 2)]
    assert rows(G.edge_label_counts(e)) == [("a", 1), ("edge", 2)]


def test_degree_and_isolates(spark):
    n, e = graph(spark)
    d = dict(rows(G.degrees(n, e)))
    assert d == {"n1": 2, "n2": 3, "CAN_0": 1, "n3": 0, "n4": 0} and sum(d.values()) == 2 * e.count()
    assert rows(G.isolates(n, e)) == [("n3", "n3"), ("n4", "x" * 90)]
    assert rows(G.component_sizes(n, e)) == [("CAN_0", 3), ("n3", 1), ("n4", 1)]


def test_neighbours_and_adjacency(spark):
    n, e = graph(spark)
    one = n.filter("node_id = 'n2'")
    assert rows(G.neighbours(n, e, one, directed=True), "node_id") == [("n2",)]
    assert rows(G.neighbours(n, e, one, directed=False), "node_id") == [("n1",), ("n2",), ("n2",)]
    assert [r[0] for r in rows(G.adjacency(e, 1), "src")] == ["CAN_0", "n1", "n2"]
    assert G.adjacency(e).filter("src = 'n2'").count() == 3


def test_display_terms_and_filter(spark):
    n, e = graph(spark)
    assert rows(n.select(G.display_name())) == sorted([("L",), ("CAN_0",), ("Can two",), ("T",), ("x" * 90,)], key=repr)
    assert rows(G.graph_terms(n)) == [("Can two", "n2")]
    assert rows(G.term_hits(n, e, ["can", "zzz"])) == [("can", 2, 3), ("zzz", 0, 0)]
    assert rows(G.viewer_filter(n, e, "CAN", "", 2), "node_id") == [("n2",)]


def test_pages(spark):
    df = spark.createDataFrame([(["3", "1", "1", "x", None],), (None,)], "p array<string>")
    assert [r[0] for r in df.select(G.pages(F.col("p"))).collect()] == [[1, 3], None]


def test_grid(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 1), ("c", 1), ("d", 2), ("e", 1)], "component string, size int")
    got = G.grid(sizes).collect()
    assert {(r.size, r.x, r.y) for r in got if r.size > 1} == {(5, 0.0, 0.0), (2, 2.8, 0.0)} and len({(r.x, r.y) for r in got}) == 5


def test_empty_graph(spark):
    n, e = (x.limit(0) for x in graph(spark))
    for df in (G.label_counts(n), G.degrees(n, e), G.isolates(n, e), G.component_sizes(n, e), G.adjacency(e), G.payload(n, e), G.graph_terms(n)):
        assert df.count() == 0


def test_clean_items(spark):
    df = spark.createDataFrame([(1, [(None, None, None), (" ", None, None), ("", 0, None), ("R", None, None), ("", None, [" "]), (None, None, ["x"])]), (2, None), (3, [])], "id int, items array<struct<name:string,width:int,tags:array<string>>>")
    got = df.select("id", clean_items(df, "items").alias("c")).orderBy("id").collect()
    assert [[tuple(x) for x in r.c] for r in got] == [[("", 0, None), ("R", None, None), (None, None, ["x"])], [], []]


def test_fused(spark):
    n, e = graph(spark)
    other = spark.createDataFrame([("n1", "named", None, "C", None), ("z", None, None, None, None)], NODE)
    nodes, edges = fused([(n, e), (other, e)])
    assert nodes.count() == 6 and edges.count() == 3 and rows(nodes.filter("node_id = 'n1'"), "name", "label") == [("named", "L")]
    assert fused([(n, e)])[0] is n
    try:
        fused([])
        raise AssertionError
    except ValueError:
        pass


def test_hit(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 30.0, 0.0)], "node_id string, x double, y double")
    assert rows(G.hit_test(p, 1.0, 1.0)) == [("a",)] and rows(G.hit_test(p, 15.9, 0.0)) == [("c",)] and rows(G.hit_test(p, 15.0, 50.0)) == [] and rows(G.hit_test(p, 10.0, 0.0, 4.0)) == []

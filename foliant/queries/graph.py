"""Queries over the graph of extracted entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import BLANK
from foliant.operators import graph as G
from foliant.operators.ontology import EntityGraph, clean_items, fused
from foliant.sources.tables import table

NEEDLE = "ctrl"


def entities(spark: SparkSession, folder: str) -> EntityGraph:
    return EntityGraph(*[table(spark, folder, t) for t in ("registry", "registers", "pins", "timing_parameters")])


def _of(make):  # noqa: ANN001, ANN202 - a query from a function of nodes and edges
    def query(spark: SparkSession, folder: str) -> DataFrame:
        g = entities(spark, folder)
        return make(g.nodes, g.edges)

    return query


def _cleaned(spark: SparkSession, folder: str) -> DataFrame:
    reg = table(spark, folder, "registers")
    kept = clean_items(reg, "fields")
    return reg.select("reg_id", F.coalesce(F.size("fields"), F.lit(0)).alias("given"), F.size(kept).alias("kept")).select("reg_id", F.greatest("given", F.lit(0)).alias("given"), "kept").distinct()


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    """The graph of the registers and that of the pins, fused."""
    reg, pins, timing, docs = (table(spark, folder, t) for t in ("registers", "pins", "timing_parameters", "registry"))
    none = lambda x: x.limit(0)
    a = EntityGraph(docs, reg, none(pins), none(timing))
    b = EntityGraph(none(docs), none(reg), pins, none(timing))
    nodes, edges = fused([(a.nodes, a.edges), (b.nodes, b.edges)])
    return nodes.groupBy("class").agg(F.count(F.lit(1)).alias("nodes")).withColumnRenamed("class", "part").unionByName(edges.groupBy(F.col("label").alias("part")).agg(F.count(F.lit(1)).alias("nodes")))


QUERIES = {
    "ontology_flatten": _of(lambda n, e: n.select("node_id", "name", "label", "class", "title")),
    "ontology_edges": _of(lambda n, e: e),
    "ontology_clean": _cleaned,
    "graph_fuse": _fused,
    "graph_label_counts": _of(lambda n, e: G.label_counts(n)),
    "graph_node_groups": _of(lambda n, e: G.group_counts(n)),
    "graph_edge_label_counts": _of(lambda n, e: G.edge_label_counts(e)),
    "graph_degree": _of(G.degrees),
    "graph_isolates": _of(G.isolates),
    "graph_lookup": _of(lambda n, e: G.lookup(n, NEEDLE).select("node_id", "name", "class")),
    "graph_neighbors": _of(lambda n, e: G.neighbours(n, e, G.lookup(n, NEEDLE))),
    "graph_neighbors_undirected": _of(lambda n, e: G.neighbours(n, e, G.lookup(n, NEEDLE), directed=False).select("src", "node_id", "edge")),
    "graph_adjacency_undirected": _of(lambda n, e: G.adjacency(e)),
    "graph_components": _of(G.component_sizes),
    "graph_layout": _of(lambda n, e: G.grid(G.component_sizes(n, e)).select("size", "x", "y")),
    "graph_top_degree": _of(G.top_degree),
    "graph_payload": _of(G.payload),
    "graph_terms": _of(lambda n, e: G.graph_terms(n)),
    "viewer_filter": _of(lambda n, e: G.viewer_filter(n, e, NEEDLE, "Register", 2)),
}

GRAPH_SQL = f"""
    d AS (SELECT doc_id FROM registry UNION SELECT doc_id FROM registers UNION SELECT doc_id FROM pins UNION SELECT doc_id FROM timing_parameters),
    fr AS (SELECT DISTINCT reg_id, list_filter(coalesce(fields, []), lambda f: coalesce(regexp_replace(concat_ws('', f.name, f.bit_range, f.access, f.reset_value, f.description), '{BLANK}', '', 'g'), '') <> '') AS fields FROM registers),
    f AS (SELECT reg_id, unnest(range(0, len(fields))) AS pos, unnest(fields) AS f FROM fr),
    n AS (SELECT 'doc:' || doc_id AS node_id, CAST(NULL AS VARCHAR) AS name, 'Document' AS label, 'DatasheetDocument' AS class, doc_id AS title FROM d WHERE doc_id IS NOT NULL
        UNION SELECT 'reg:' || reg_id, name, 'Register', 'Register', address FROM registers
        UNION SELECT 'field:' || reg_id || ':' || pos, f.name, '', 'BitField', f.bit_range FROM f
        UNION SELECT 'pin:' || pin_id, NULL, 'Pin', 'PinSignal', pin_name FROM pins
        UNION SELECT 'time:' || param_id, name, '', 'TimingParameter', symbol FROM timing_parameters),
    e AS (SELECT 'doc:' || doc_id AS src, 'reg:' || reg_id AS dst, 'HAS_REGISTER' AS label FROM registers WHERE doc_id IS NOT NULL
        UNION SELECT 'reg:' || reg_id, 'field:' || reg_id || ':' || pos, 'HAS_FIELD' FROM f
        UNION SELECT 'doc:' || doc_id, 'pin:' || pin_id, 'HAS_PIN' FROM pins WHERE doc_id IS NOT NULL
        UNION SELECT 'doc:' || doc_id, 'time:' || param_id, '' FROM timing_parameters WHERE doc_id IS NOT NULL),
    g AS (SELECT n.node_id, count(x.id) AS degree FROM n LEFT JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) x ON x.id = n.node_id GROUP BY n.node_id),
    b AS (SELECT src, dst, label FROM e UNION ALL SELECT dst, src, label FROM e)"""



def _strip(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g'), '')"


_SHOWN = f"coalesce({_strip('name')}, {_strip('label')}, {_strip('title')}, node_id)"
_GROUP = "coalesce(nullif(class, ''), nullif(label, ''), 'Unknown')"
_NAMED = f"contains(lower(coalesce(name, node_id)), '{NEEDLE}')"
_ATTRS = "'{' || concat_ws(',', " + ", ".join(f"""'"{c}":' || to_json({c})""" for c in ("class", "label", "name", "title")) + ") || '}'"
_TERMS = f"t AS (SELECT lower({_strip('name')}) AS key, min((node_id, {_strip('name')})) AS f FROM n WHERE length({_strip('name')}) BETWEEN 2 AND 80 GROUP BY ALL ORDER BY f LIMIT 40)"

GRAPH_TERMS_SQL = _TERMS

_SELECT = {
    "ontology_flatten": "SELECT * FROM n",
    "ontology_edges": "SELECT * FROM e",
    "graph_label_counts": "SELECT coalesce(nullif(label, ''), nullif(class, ''), 'unknown') AS label, count(*) AS n FROM n GROUP BY ALL",
    "graph_node_groups": f'SELECT {_GROUP} AS "group", count(*) AS n FROM n GROUP BY ALL',
    "graph_edge_label_counts": "SELECT coalesce(nullif(label, ''), 'edge') AS label, count(*) AS n FROM e GROUP BY ALL",
    "graph_degree": "SELECT * FROM g",
    "graph_isolates": f"SELECT node_id, coalesce({_strip('name')}, node_id) AS name FROM n JOIN g USING (node_id) WHERE degree = 0",
    "graph_lookup": f"SELECT node_id, name, class FROM n WHERE {_NAMED}",
    "graph_neighbors": f"SELECT b.src, n.node_id, n.name, coalesce(nullif(b.label, ''), 'edge') AS edge, n.label, n.class, n.title FROM e b JOIN n ON n.node_id = b.dst WHERE b.src IN (SELECT node_id FROM n WHERE {_NAMED})",
    "graph_neighbors_undirected": f"SELECT b.src, n.node_id, coalesce(nullif(b.label, ''), 'edge') AS edge FROM b JOIN n ON n.node_id = b.dst WHERE b.src IN (SELECT node_id FROM n WHERE {_NAMED})",
    "graph_adjacency_undirected": "SELECT src, dst, label, row_number() OVER (PARTITION BY src ORDER BY dst, label) AS nth FROM b QUALIFY nth <= 80",
    "graph_components": "SELECT component, count(*) AS size FROM (SELECT n.node_id, coalesce(min(r.a), n.node_id) AS component FROM n LEFT JOIN r ON r.b = n.node_id GROUP BY n.node_id) GROUP BY component",
    "graph_layout": "SELECT size, CAST(pos % k AS DOUBLE) * 2.8 AS x, CAST(pos // k AS DOUBLE) * 2.8 AS y FROM (SELECT size, row_number() OVER (ORDER BY size DESC) - 1 AS pos, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS k FROM (SELECT count(*) AS size FROM (SELECT n.node_id, coalesce(min(r.a), n.node_id) AS component FROM n LEFT JOIN r ON r.b = n.node_id GROUP BY n.node_id) GROUP BY component))",
    "graph_top_degree": "SELECT node_id, degree FROM g ORDER BY degree DESC, node_id LIMIT 40",
    "graph_payload": f"""SELECT 'node' AS part, node_id AS key, '{{"id":' || to_json(node_id) || ',"name":' || to_json({_SHOWN}) || ',"group":' || to_json({_GROUP}) || ',"degree":' || degree || ',"pages":[],"attrs":' || {_ATTRS} || '}}' AS json FROM n JOIN g USING (node_id)
        UNION ALL SELECT 'edge', src || ' ' || dst, '{{"source":' || to_json(src) || ',"target":' || to_json(dst) || ',"label":' || to_json(coalesce(nullif(label, ''), 'edge')) || '}}' FROM e
        UNION ALL SELECT 'group', {_GROUP}, CAST(count(*) AS VARCHAR) FROM n GROUP BY ALL
        UNION ALL SELECT 'edge_label', coalesce(nullif(label, ''), 'edge'), CAST(count(*) AS VARCHAR) FROM e GROUP BY ALL""",
    "graph_terms": "SELECT f[2] AS term, f[1] AS node_id FROM t",
    "viewer_filter": f"""SELECT node_id, name, "group", degree FROM (SELECT node_id, {_SHOWN} AS name, {_GROUP} AS "group", degree, lower('[' || to_json(node_id) || ',' || to_json({_SHOWN}) || ',' || to_json({_GROUP}) || '],' || {_ATTRS}) AS said FROM n JOIN g USING (node_id)) WHERE contains(said, '{NEEDLE}') AND "group" = 'Register' AND degree >= 2""",
}
_REACH = "r AS (SELECT src AS a, src AS b FROM e UNION SELECT dst, dst FROM e UNION SELECT r.a, b.dst FROM r JOIN b ON b.src = r.b)"

SQL = {k: f"WITH RECURSIVE {GRAPH_SQL}{', ' + _REACH if k in ('graph_components', 'graph_layout') else ''}{', ' + _TERMS if k == 'graph_terms' else ''} {v}" for k, v in _SELECT.items()} | {
    "ontology_clean": f"WITH {GRAPH_SQL} SELECT DISTINCT r.reg_id, CAST(coalesce(len(r.fields), 0) AS INT) AS given, CAST(len(fr.fields) AS INT) AS kept FROM registers r JOIN fr USING (reg_id)",
    "graph_fuse": f"WITH {GRAPH_SQL} SELECT class AS part, count(*) AS nodes FROM n WHERE class IN ('Register', 'BitField', 'PinSignal') GROUP BY ALL UNION ALL SELECT 'DatasheetDocument', count(*) FROM (SELECT doc_id FROM registry UNION SELECT doc_id FROM registers UNION SELECT doc_id FROM pins) WHERE doc_id IS NOT NULL UNION ALL SELECT label, count(*) FROM e WHERE label <> '' GROUP BY ALL",
}

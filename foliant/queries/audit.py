"""Audit queries over chunks and the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import BLANK
from foliant.operators import audit as A
from foliant.operators import graph as G
from foliant.queries.graph import GRAPH_SQL, GRAPH_TERMS_SQL, entities
from foliant.sources.tables import table

#: Terms looked for in graph and text: words, and ones with other characters.
TERMS = ["watchdog", "arbiter", "Reset", "P20.3", "CTRL", "voltage monitor", "OM900", "naïve"]


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return A.chunks_once(table(spark, folder, "chunks"))


def _fresh(spark: SparkSession, folder: str) -> DataFrame:
    """What a rebuild gives: the chunks that have text and a known type, without those of pictures."""
    c = _chunks(spark, folder)
    return c.filter(~A.invalid_type() & (F.trim("text") != "") & (F.col("chunk_type") != "image_analysis") & F.col("doc_id").isNotNull()).select("doc_id", "chunk_id", "chunk_type")


def audit_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return A.counts(_chunks(spark, folder), "chunk_type")


def audit_doc_counts(spark: SparkSession, folder: str) -> DataFrame:
    return A.counts(_chunks(spark, folder), "doc_id")


def audit_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return A.duplicate_texts(_chunks(spark, folder)).select("text_key", "copies", F.array_join("examples", ",").alias("examples"))


def audit_missing_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("chunk_id", F.array_join(A.missing_metadata(), ",").alias("missing")).filter("missing <> ''")


def audit_empty(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).filter(A.strip("text") == "").select("chunk_id")


def audit_invalid_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).filter(A.invalid_pages()).select("chunk_id", "page_start", "page_end")


def audit_invalid_types(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).filter(A.invalid_type()).select("chunk_id", "chunk_type")


def audit_oversized(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts above the limit; over ``documents`` as prose, since windowed chunks can't be too long."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.lit("structural").alias("chunk_type"))
    return docs.filter(A.oversized()).select("doc_id", A.word_count("text").alias("words"))


def audit_stale_missing(spark: SparkSession, folder: str) -> DataFrame:
    return A.differences(_chunks(spark, folder), _fresh(spark, folder))


def audit_term_checks(spark: SparkSession, folder: str) -> DataFrame:
    g = entities(spark, folder)
    return G.term_hits(g.nodes, g.edges, TERMS)


def audit_term_alignment(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.aligned_terms(_chunks(spark, folder), TERMS)
    return rows.select("term", "matches", F.array_join("examples", ",").alias("examples"))


def audit_graph_term_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """audit_term_alignment over the given terms and the graph's own."""
    rows = A.aligned_terms(_chunks(spark, folder), A.terms_with_graph(TERMS, entities(spark, folder).nodes))
    return rows.select("term", "matches", F.array_join("examples", ",").alias("examples"))


def _shown(issues: DataFrame) -> DataFrame:
    return issues.select("severity", "category", "check", "n", F.array_join("examples", ",").alias("examples"))


def audit_issues(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(A.issues(table(spark, folder, "chunks"), _fresh(spark, folder)))


def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.severities(A.issues(table(spark, folder, "chunks"), _fresh(spark, folder)))


def audit_fresh_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return A.fresh_counts(_fresh(spark, folder))


def full_issues(spark: SparkSession, folder: str, fresh: DataFrame | None, terms: list[str] = TERMS, most: int = 40, with_images: bool = False) -> DataFrame:
    """Issues of the chunks, of the graph, and of the graph's terms against the text."""
    chunks, g = table(spark, folder, "chunks"), entities(spark, folder)
    return A.issues(chunks, fresh, with_images).unionByName(A.graph_issues(chunks, g.nodes, g.edges, terms, most))


def audit_isolated(spark: SparkSession, folder: str) -> DataFrame:
    """The checks of a graph that has isolated nodes: the entity graph without the edges to pins."""
    g = entities(spark, folder)
    return _shown(A.graph_issues(table(spark, folder, "chunks"), g.nodes, g.edges.filter("label <> 'HAS_PIN'"), TERMS).filter("category = 'graph_topology'"))


def audit_full_issues(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(full_issues(spark, folder, _fresh(spark, folder)))


def audit_full_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.severities(full_issues(spark, folder, _fresh(spark, folder)))


QUERIES = [audit_type_counts, audit_doc_counts, audit_duplicates, audit_missing_metadata, audit_empty, audit_invalid_pages, audit_invalid_types, audit_oversized, audit_stale_missing, audit_term_checks, audit_term_alignment, audit_graph_term_alignment, audit_issues, audit_summary, audit_fresh_type_counts, audit_full_issues, audit_full_summary, audit_isolated]

_ENDS = f"regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g')"
_C = f"""
    c AS (SELECT DISTINCT seq, chunk_id, doc_id, chunk_type, coalesce(text, '') AS text, page_start, page_end, section_path FROM chunks),
    m AS (SELECT seq, chunk_id, array_to_string(list_filter([CASE WHEN chunk_type IS NULL THEN 'chunk_type' END, CASE WHEN doc_id IS NULL THEN 'doc_id' END, CASE WHEN page_end IS NULL THEN 'page_end' END, CASE WHEN page_start IS NULL THEN 'page_start' END, CASE WHEN section_path IS NULL THEN 'section_path' END], lambda x: x IS NOT NULL), ',') AS missing FROM c),
    v AS (SELECT * FROM c WHERE chunk_type IN ('structural', 'atomic_table', 'image_analysis', 'hierarchical_summary')),
    p AS (SELECT seq, chunk_id, page_start, page_end FROM c WHERE page_start IS NULL OR page_end IS NULL OR page_start < 0 OR page_end < page_start),
    d AS (SELECT sha1(lower({_ENDS})) AS text_key, count(*) AS copies, array_to_string(list_slice(list(chunk_id ORDER BY seq), 1, 10), ',') AS examples FROM c WHERE {_ENDS} <> '' GROUP BY ALL HAVING count(*) > 1),
    f AS (SELECT DISTINCT doc_id, chunk_id FROM v WHERE trim(text) <> '' AND chunk_type <> 'image_analysis' AND doc_id IS NOT NULL),
    s AS (SELECT DISTINCT doc_id, chunk_id FROM c WHERE chunk_type IS NULL OR chunk_type <> 'image_analysis'),
    x AS (SELECT f.doc_id, count(*) AS fresh_chunks, count(*) FILTER (f.chunk_id NOT IN (SELECT chunk_id FROM s)) AS missing FROM f GROUP BY f.doc_id),
    y AS (SELECT x.*, (SELECT count(*) FROM s WHERE s.doc_id = x.doc_id AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = s.doc_id AND f.chunk_id = s.chunk_id)) AS stale FROM x),
    w AS (SELECT seq, chunk_id FROM c WHERE chunk_type = 'structural' AND len(list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda w: w <> '')) > 459),
    i AS (SELECT * FROM (
        SELECT 'ERROR' AS severity, 'chunk_quality' AS category, 'no_chunks' AS "check", CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS n, '' AS examples FROM c
        UNION ALL SELECT 'ERROR', 'chunk_quality', 'missing_metadata', count(*), array_to_string(list_slice(list(chunk_id ORDER BY seq, chunk_id), 1, 10), ',') FROM m WHERE missing <> ''
        UNION ALL SELECT 'ERROR', 'chunk_quality', 'empty_text', count(*), array_to_string(list_slice(list(chunk_id ORDER BY seq, chunk_id), 1, 10), ',') FROM c WHERE {_ENDS} = ''
        UNION ALL SELECT 'ERROR', 'chunk_quality', 'invalid_pages', count(*), array_to_string(list_slice(list(chunk_id ORDER BY seq, chunk_id), 1, 10), ',') FROM p
        UNION ALL SELECT 'ERROR', 'chunk_quality', 'unknown_type', count(*), array_to_string(list_slice(list(chunk_id ORDER BY seq, chunk_id), 1, 10), ',') FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM v)
        UNION ALL SELECT 'WARN', 'chunk_quality', 'oversized', count(*), array_to_string(list_slice(list(chunk_id ORDER BY seq, chunk_id), 1, 10), ',') FROM w
        UNION ALL SELECT 'WARN', 'chunk_quality', 'no_tables', CASE WHEN count(*) > 0 AND count(*) FILTER (chunk_type = 'atomic_table') = 0 THEN 1 ELSE 0 END, '' FROM c
        UNION ALL SELECT 'WARN', 'chunk_quality', 'duplicate_text', count(*), array_to_string(list_slice(list(text_key ORDER BY text_key), 1, 10), ',') FROM d
        UNION ALL SELECT 'WARN', 'chunk_quality', 'stale_or_missing', count(*), array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 10), ',') FROM y WHERE missing > 0 OR stale > 0) WHERE n > 0)"""
_TERM_TABLE = "k AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in TERMS) + "]) AS term)"

SQL = {k: f"WITH {_C} {v}" for k, v in {
    "audit_type_counts": "SELECT chunk_type, count(*) AS n FROM c GROUP BY ALL",
    "audit_doc_counts": "SELECT doc_id, count(*) AS n FROM c GROUP BY ALL",
    "audit_duplicates": "SELECT * FROM d",
    "audit_missing_metadata": "SELECT chunk_id, missing FROM m WHERE missing <> ''",
    "audit_empty": f"SELECT chunk_id FROM c WHERE {_ENDS} = ''",
    "audit_invalid_pages": "SELECT chunk_id, page_start, page_end FROM p",
    "audit_invalid_types": "SELECT chunk_id, chunk_type FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM v)",
    "audit_stale_missing": "SELECT * FROM y",
    "audit_issues": "SELECT * FROM i",
    "audit_summary": "SELECT count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARN') AS warnings, coalesce(bool_or(severity = 'ERROR'), false) AS failed FROM i",
}.items()} | {
    "audit_oversized": f"SELECT doc_id, CAST(words AS INT) AS words FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda w: w <> '')) AS words FROM documents) WHERE words > 459",
    "audit_term_checks": f"WITH RECURSIVE {GRAPH_SQL}, {_TERM_TABLE} SELECT term, count(n.node_id) AS hits, coalesce(max(degree), 0) AS max_degree FROM k LEFT JOIN n ON contains(lower(coalesce(n.name, n.node_id)), lower(term)) LEFT JOIN g ON g.node_id = n.node_id GROUP BY term",
}
SQL["audit_term_alignment"] = rf"""WITH {_C}, {_TERM_TABLE},
    h AS (SELECT term, seq, chunk_id FROM c JOIN k ON CASE WHEN contains(lower(text), lower(term)) THEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(term) || '([^\p{{L}}\p{{N}}_]|$)') ELSE false END)
    SELECT k.term, count(h.seq) AS matches, coalesce(array_to_string(list_slice(list(chunk_id ORDER BY seq) FILTER (h.seq IS NOT NULL), 1, 5), ','), '') AS examples FROM k LEFT JOIN h USING (term) GROUP BY k.term"""
_ALL_TERMS = f"""gt AS (WITH {GRAPH_SQL}, {GRAPH_TERMS_SQL} SELECT f[2] AS term, f[1] AS node_id FROM t),
    gv AS (SELECT unnest([{', '.join(f"'{t}'" for t in TERMS)}]) AS term, unnest(range({len(TERMS)})) AS pos),
    ak AS (SELECT arg_min(term, pos) AS term FROM (SELECT * FROM gv UNION ALL SELECT term, {len(TERMS)} + row_number() OVER (ORDER BY node_id) FROM gt) GROUP BY lower(trim(term)))"""
_ALIGNED = r"""ah AS (SELECT term, seq, chunk_id FROM c JOIN ak ON CASE WHEN contains(lower(text), lower(term)) THEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])' || regexp_escape(term) || '([^\p{L}\p{N}_]|$)') ELSE false END)"""
SQL["audit_graph_term_alignment"] = f"""WITH {_C}, {_ALL_TERMS}, {_ALIGNED}
    SELECT ak.term, count(ah.seq) AS matches, coalesce(array_to_string(list_slice(list(chunk_id ORDER BY seq) FILTER (ah.seq IS NOT NULL), 1, 5), ','), '') AS examples FROM ak LEFT JOIN ah USING (term) GROUP BY ak.term"""


def _graph_checks(edges: str) -> str:
    """Common table expressions up to gi, the issues of the graph with those of its ``edges`` that a condition leaves."""
    cte = f"{GRAPH_SQL}, ee AS (SELECT * FROM e WHERE {edges}), gg AS (SELECT n.node_id, count(x.id) AS degree FROM n LEFT JOIN (SELECT src AS id FROM ee UNION ALL SELECT dst FROM ee) x ON x.id = n.node_id GROUP BY n.node_id)"
    return f"""gs AS (WITH {cte} SELECT (SELECT count(DISTINCT node_id) FROM n) AS nodes, (SELECT count(*) FROM ee) AS edges),
    al AS (WITH {cte} SELECT DISTINCT node_id, coalesce(nullif(regexp_replace(name, '^{BLANK}+|{BLANK}+$', '', 'g'), ''), node_id) AS name FROM n JOIN gg USING (node_id) WHERE degree = 0),
    tc AS (WITH {cte}, {_TERM_TABLE} SELECT term, count(n.node_id) AS hits, coalesce(max(degree), 0) AS max_degree FROM k LEFT JOIN n ON contains(lower(coalesce(n.name, n.node_id)), lower(term)) LEFT JOIN gg ON gg.node_id = n.node_id GROUP BY term),
    gi AS (SELECT * FROM (
        SELECT 'ERROR' AS severity, 'graph_topology' AS category, 'no_nodes' AS "check", CASE WHEN nodes = 0 THEN 1 ELSE 0 END AS n, '' AS examples FROM gs
        UNION ALL SELECT 'ERROR', 'graph_topology', 'no_edges', CASE WHEN nodes > 1 AND edges = 0 THEN 1 ELSE 0 END, '' FROM gs
        UNION ALL SELECT 'WARN', 'graph_topology', 'isolated_nodes', count(*), array_to_string(list_slice(list(name ORDER BY node_id), 1, 10), ',') FROM al
        UNION ALL SELECT 'WARN', 'graph_topology', 'term_absent', count(*), array_to_string(list_slice(list(term ORDER BY term), 1, 10), ',') FROM tc WHERE hits = 0
        UNION ALL SELECT 'WARN', 'graph_topology', 'term_only_isolated', count(*), array_to_string(list_slice(list(term ORDER BY term), 1, 10), ',') FROM tc WHERE hits > 0 AND max_degree = 0) WHERE n > 0)"""


_FULL = f"""WITH {_C}, {_ALL_TERMS}, {_ALIGNED}, {_graph_checks('true')},
    fi AS (SELECT * FROM i UNION ALL SELECT * FROM gi UNION ALL SELECT * FROM (
        SELECT 'WARN', 'hybrid_alignment', 'terms_not_in_chunks', count(*) AS n, array_to_string(list_slice(list(term ORDER BY term), 1, 10), ',') FROM ak WHERE term NOT IN (SELECT term FROM ah)) WHERE n > 0)"""
SQL["audit_isolated"] = f"WITH {_graph_checks("label <> 'HAS_PIN'")} SELECT * FROM gi"
SQL["audit_fresh_type_counts"] = f"WITH {_C} SELECT doc_id, chunk_type, count(*) AS n FROM (SELECT DISTINCT doc_id, chunk_id, chunk_type FROM v WHERE trim(text) <> '' AND chunk_type <> 'image_analysis' AND doc_id IS NOT NULL) GROUP BY ALL"
SQL["audit_full_issues"] = f"{_FULL} SELECT * FROM fi"
SQL["audit_full_summary"] = f"{_FULL} SELECT count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARN') AS warnings, coalesce(bool_or(severity = 'ERROR'), false) AS failed FROM fi"

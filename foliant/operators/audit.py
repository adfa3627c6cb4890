"""Quality audit of chunks, graph and their agreement: lists of findings, issues, and a report."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import norm, safe_int, strip, whole_term, word_count
from foliant.operators.chunking import WINDOW
from foliant.operators.graph import graph_terms, isolates, term_hits
from foliant.plans.lineage import cut
from foliant.plans.skew import union_all

# What a chunk must say, the chunk types there are, and how far over its window prose may be.
REQUIRED = ["chunk_type", "doc_id", "page_end", "page_start", "section_path"]
TYPES = ["structural", "atomic_table", "image_analysis", "hierarchical_summary"]
MOST_WORDS = int(WINDOW * 1.15)
EXAMPLES = 10


def chunks_once(chunks: DataFrame) -> DataFrame:
    """(seq, chunk_id, doc_id, chunk_type, text, page_start, page_end, section_path), a chunk delivered again once; a null text is empty."""
    return chunks.select("seq", "chunk_id", "doc_id", "chunk_type", F.coalesce("text", F.lit("")).alias("text"), "page_start", "page_end", "section_path").distinct()


def counts(chunks: DataFrame, by: str) -> DataFrame:
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def missing_metadata() -> Column:
    """The required fields that are null, in order."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))


def invalid_pages() -> Column:
    start, end = safe_int("page_start"), safe_int("page_end")
    return F.coalesce(start.isNull() | end.isNull() | (start < 0) | (end < start), F.lit(True))


def invalid_type() -> Column:
    return ~F.coalesce(F.col("chunk_type").isin(TYPES), F.lit(False))


def oversized() -> Column:
    return F.coalesce(F.col("chunk_type") == "structural", F.lit(False)) & (word_count("text") > MOST_WORDS)


def duplicate_texts(chunks: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(text_key, copies, examples): texts equal but for case and blanks at the ends, with the first ids in scan order.

    Groups are met by digest and only ever hold a bounded list: partial aggregates keep the first ids of each task's rows.
    """
    rows = chunks.select("chunk_id", "seq", norm("text").alias("t")).filter("t <> ''").select(F.sha1("t").alias("text_key"), "seq", "chunk_id")
    groups = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    w = Window.partitionBy("text_key").orderBy("seq")
    first = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= examples).groupBy("text_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"]).alias("examples"))
    return groups.join(first, "text_key")


def differences(stored: DataFrame, fresh: DataFrame, with_images: bool = False) -> DataFrame:
    """(doc_id, fresh_chunks, missing, stale) of each document that was built afresh.

    ``missing`` are fresh ids no stored chunk of any document has, ``stale`` stored ids of the document that were not built again.
    Image chunks are left out of ``stored`` unless asked for.
    """
    s = stored if with_images else stored.filter("chunk_type IS NULL OR chunk_type <> 'image_analysis'")
    ids = fresh.select("doc_id", "chunk_id").distinct()
    n = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fresh_chunks"))
    missing = ids.join(s.select("chunk_id"), "chunk_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("missing"))
    stale = s.select("doc_id", "chunk_id").distinct().join(ids, ["doc_id", "chunk_id"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("stale"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return n.join(missing, "doc_id", "left").join(stale, "doc_id", "left").select("doc_id", "fresh_chunks", z("missing"), z("stale"))


def ordered_terms(given: list[str], graph: list[str]) -> list[str]:
    """Given terms, then graph terms, the first spelling of each; blank ones left out."""
    first: dict[str, str] = {}
    for t in [*given, *graph]:
        if t.strip():
            first.setdefault(t.strip().lower(), t)
    return list(first.values())


def terms_with_graph(given: list[str], nodes: DataFrame, most: int = 40) -> list[str]:
    """The given terms, then the first ``most`` of the graph's own names, the first spelling of each."""
    return ordered_terms(given, [r.term for r in graph_terms(nodes, most).orderBy("node_id").collect()])


def alignments(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(term, seq, chunk_id, doc_id, page_start, page_end, chunk_type): chunks in which a term stands as a whole, in any case.

    One scan: a chunk's words are intersected with the terms that are one word, and the other terms, a short list, are tried as
    patterns. That gives the same rows as trying every term as a pattern on every chunk.
    """
    word = {t.strip().lower(): t for t in terms if t.strip().isascii() and t.strip().replace("_", "a").isalnum()}
    rest = [t for t in terms if t.strip() and t.strip().lower() not in word]
    words = F.array_distinct(F.split(F.lower("text"), r"(?U)\W+"))
    table = F.create_map(*[F.lit(x) for kv in word.items() for x in kv]) if word else None
    found = F.transform(F.array_intersect(words, F.array(*[F.lit(w) for w in word])), lambda w: table[w]) if word else F.array().cast("array<string>")
    others = F.array_compact(F.array(*[F.when(whole_term("text", t), F.lit(t)) for t in rest])) if rest else F.array().cast("array<string>")
    return chunks.select(F.explode(F.concat(found, others)).alias("term"), "seq", "chunk_id", "doc_id", "page_start", "page_end", "chunk_type")


def aligned_terms(chunks: DataFrame, terms: list[str], examples: int = 5) -> DataFrame:
    """(term, matches, examples): each term with the number of chunks that have it and the first ids in scan order; 0 for a term in none."""
    hits = alignments(chunks, terms).select("term", "seq", "chunk_id")
    n = hits.groupBy("term").agg(F.count(F.lit(1)).alias("matches"))
    w = Window.partitionBy("term").orderBy("seq")
    first = hits.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= examples).groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"]).alias("examples"))
    every = chunks.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return every.join(n, "term", "left").join(first, "term", "left").select("term", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


CHECKS = [
    ("ERROR", "missing_metadata", "Chunks lack required provenance.", lambda: F.size(missing_metadata()) > 0),
    ("ERROR", "empty_text", "Chunks have no text.", lambda: strip("text") == ""),
    ("ERROR", "invalid_pages", "Chunks have impossible page ranges.", invalid_pages),
    ("ERROR", "unknown_type", "Chunks are of unknown types.", invalid_type),
    ("WARN", "oversized", "Prose chunks are longer than their window allows.", oversized),
]


COLUMNS = ["severity", "category", "check", "message", "n", "examples"]


def _empty() -> Column:
    return F.array().cast("array<string>")


def _first(df: DataFrame, value: str, order: str, message_row: Callable[..., Column], *args: str, most: int = EXAMPLES) -> DataFrame:
    """One issue row for the rows of ``df``: how many there are, and the first few values."""
    first = df.select(F.col(order).alias("o"), F.col(value).cast("string").alias("v")).orderBy("o", "v").limit(most)
    listed = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("examples"))
    both = df.agg(F.count(F.lit(1)).alias("n")).crossJoin(listed)  # one row and one row
    return both.select(message_row(*args, F.col("n"), F.col("examples")).alias("i")).select("i.*")


def _row(severity: str, category: str, check: str, message: str, n: Column, examples: Column | None = None) -> Column:
    found = _empty() if examples is None else F.coalesce(examples, _empty())
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(check).alias("check"), F.lit(message).alias("message"), n.cast("bigint").alias("n"), found.alias("examples"))


def issues(chunks: DataFrame, fresh: DataFrame | None = None, with_images: bool = False) -> DataFrame:
    """(severity, category, check, message, n, examples) of every chunk check that finds something, and of an empty store.

    ``examples`` are the first ``EXAMPLES`` chunk ids in scan order, for repeated texts their keys, for documents that differ from a rebuild
    their ids. All row checks are one aggregate over one scan, and their examples another, of which each task keeps the first few.
    ``graph_issues`` has the other checks.
    """
    c = chunks_once(chunks)
    marks = c.select("chunk_type", *[cond().alias(name) for _, name, _, cond in CHECKS])
    sums = marks.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("chunk_type") == "atomic_table").alias("tables"), *[F.count_if(name).alias(name) for _, name, _, _ in CHECKS])
    hits = c.select(F.explode(F.array_compact(F.array(*[F.when(cond(), F.lit(name)) for _, name, _, cond in CHECKS]))).alias("check"), "seq", "chunk_id")
    top = hits.withColumn("k", F.row_number().over(Window.partitionBy("check").orderBy("seq", "chunk_id"))).filter(F.col("k") <= EXAMPLES)
    top = top.groupBy("check").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"]).alias("shown"))
    found = [
        _row("ERROR", "chunk_quality", "no_chunks", "The store has no chunks.", F.when(F.col("all") == 0, 1).otherwise(0)),
        *[_row(sev, "chunk_quality", name, text, F.col(name)) for sev, name, text, _ in CHECKS],
        _row("WARN", "chunk_quality", "no_tables", "No table chunks were found.", F.when((F.col("all") > 0) & (F.col("tables") == 0), 1).otherwise(0)),
    ]
    one = sums.select(F.explode(F.array(*found)).alias("i")).select("i.*").join(F.broadcast(top), "check", "left")  # a row for each check
    one = one.withColumn("examples", F.coalesce("shown", "examples")).select(*COLUMNS)
    keys = cut(c.select(norm("text").alias("t")).filter("t <> ''").groupBy(F.sha1("t").alias("text_key")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    parts = [one, _first(keys, "text_key", "text_key", _row, "WARN", "chunk_quality", "duplicate_text", "Texts are in the store more than once.")]
    if fresh is not None:
        d = cut(differences(c, fresh, with_images).filter("missing > 0 OR stale > 0"))
        parts.append(_first(d, "doc_id", "doc_id", _row, "WARN", "chunk_quality", "stale_or_missing", "Stored chunks differ from rebuilt ones."))
    return union_all(parts).filter("n > 0")


def _issue(spark: SparkSession, severity: str, category: str, check: str, message: str, n: int, examples: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(severity, category, check, message, n, examples or [])], "severity string, category string, check string, message string, n bigint, examples array<string>")


def graph_issues(chunks: DataFrame, nodes: DataFrame | None, edges: DataFrame | None, terms: list[str], most: int = 40) -> DataFrame:
    """(severity, category, check, message, n, examples) of every check of the graph, and of its terms against the text, that finds something.

    Without a graph (null) only that is an issue. ``terms`` must be in the graph; they and the graph's first ``most`` names, in the text.
    ``examples`` are the names of the first isolated nodes by id, and the first terms in order.
    """
    spark = chunks.sparkSession
    if nodes is None or edges is None:
        return _issue(spark, "ERROR", "graph_topology", "graph_missing", "There is no graph.", 1)
    nodes, edges = cut(nodes), cut(edges)
    alone = cut(isolates(nodes, edges).distinct())
    size = nodes.agg(F.countDistinct("node_id").alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    shape = [
        _row("ERROR", "graph_topology", "no_nodes", "The graph has no nodes.", F.when(F.col("nodes") == 0, 1).otherwise(0)),
        _row("ERROR", "graph_topology", "no_edges", "The graph has nodes but no edges.", F.when((F.col("nodes") > 1) & (F.col("edges") == 0), 1).otherwise(0)),
    ]
    parts = [size.select(F.explode(F.array(*shape)).alias("i")).select("i.*"), _first(alone, "name", "node_id", _row, "WARN", "graph_topology", "isolated_nodes", "Nodes have no edge.")]
    asked = ordered_terms(terms, [])
    if asked:
        hits = cut(term_hits(nodes, edges, asked))
        parts.append(_first(hits.filter("hits = 0"), "term", "term", _row, "WARN", "graph_topology", "term_absent", "Terms are in no node's name."))
        parts.append(_first(hits.filter("hits > 0 AND max_degree = 0"), "term", "term", _row, "WARN", "graph_topology", "term_only_isolated", "Terms are only in names of nodes without edges."))
    text = cut(aligned_terms(chunks_once(chunks), terms_with_graph(terms, nodes, most)).filter("matches = 0"))
    parts.append(_first(text, "term", "term", _row, "WARN", "hybrid_alignment", "terms_not_in_chunks", "Terms are in no chunk's text."))
    return union_all(parts).filter("n > 0")


def search_issues(spark: SparkSession, terms: list[str], search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Terms for which ``search(queries(q, t))``, giving hits with a query_id, finds nothing; a search that fails is a warning too."""
    asked = list(enumerate(ordered_terms(terms, [])))
    try:
        found = {r.query_id for r in search(spark.createDataFrame(asked, "q bigint, t string")).select("query_id").distinct().collect()}
    except Exception as e:  # noqa: BLE001 - whatever keeps the search from running is what the audit reports
        return _issue(spark, "WARN", "live_search", "search_failed", f"The search could not run: {str(e)[:200]}", 1)
    empty = [t for i, t in asked if i not in found]
    return _issue(spark, "WARN", "live_search", "search_empty", "Terms are found by no search.", len(empty), empty[:EXAMPLES]).filter("n > 0")


def fresh_counts(fresh: DataFrame) -> DataFrame:
    """(doc_id, chunk_type, n): freshly built chunks of each document by type."""
    return fresh.select("doc_id", "chunk_id", "chunk_type").distinct().groupBy("doc_id", "chunk_type").agg(F.count(F.lit(1)).alias("n"))


def severities(issue_rows: DataFrame) -> DataFrame:
    """One row: errors, warnings, failed (any error)."""
    return issue_rows.agg(F.count_if(F.expr("severity = 'ERROR'")).alias("errors"), F.count_if(F.expr("severity = 'WARN'")).alias("warnings"), F.coalesce(F.bool_or(F.col("severity") == "ERROR"), F.lit(False)).alias("failed"))


def report(issue_rows: DataFrame) -> str:
    """The audit as JSON with sorted keys; issues are few, one for each check."""
    rows = [r.asDict() for r in issue_rows.orderBy("severity", "check").collect()]
    return json.dumps({"issues": rows, "failed": any(r["severity"] == "ERROR" for r in rows)}, sort_keys=True, indent=2)


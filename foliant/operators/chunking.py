"""Chunks of a document: prose windows, sections, atomic tables, and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import BLANK, col, short_hash, strip
from foliant.plans.ordered import carried, numbered

# Window and overlap in words, and the header words of a bit-field table.
WINDOW, OVERLAP = 400, 50
HEADER_WORDS = ["bit", "bits", "field", "name", "access", "reset", "type", "description", "range", "offset", "address"]


def windows(text: str | Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """The text as it is if it has at most ``size`` words; else windows of ``size`` words joined by one blank, each
    sharing ``overlap`` words with the one before, until one reaches the end. Null is an empty text: one empty window."""
    t = F.coalesce(col(text), F.lit(""))
    words = F.filter(F.split(t, f"{BLANK}+"), lambda w: w != "")
    n, step = F.size(words), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")))
    return F.when(n <= size, F.array(t)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i * step + 1, size), " ")))


def prose_windows(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, window_no, text, words), windows numbered from 0; rows with a null id are left out."""
    rows = df.select(F.col(f"`{item}`").alias("item"), F.posexplode(windows(F.col(f"`{text}`"))).alias("window_no", "text")).filter("item IS NOT NULL")
    return rows.withColumn("words", F.size(F.filter(F.split("text", f"{BLANK}+"), lambda w: w != "")))


def looks_like_bit_fields(header: Column) -> Column:
    """Whether at least two header words occur in the lower-case header, which counts "bits" twice."""
    return header_hits(header) >= 2


def header_hits(header: Column) -> Column:
    text = F.lower(F.array_join(header, " "))
    return F.size(F.filter(F.array(*map(F.lit, HEADER_WORDS)), lambda w: F.contains(text, w)))


def sections(items: DataFrame, doc: str = "doc_id", order: str = "seq") -> DataFrame:
    """(doc_id, island, text, page_start, page_end, section_path): prose between headers, tables and pictures.

    ``items(doc, order, kind, page_no, text)``, kind header, table, picture or text; other kinds count for nothing. A header,
    table or picture ends the prose before it, whose page_end is the page of that item; prose up to the end has its first page,
    or 0, as page_end. page_start is the first page, or page_end where that is null or 0. The section is the last header above, stripped.
    Null pages are 0; a null text is empty.
    """
    i = items.select(F.col(doc).alias("doc_id"), F.col(order).cast("bigint").alias("seq"), "kind", F.coalesce("page_no", F.lit(0)).alias("page_no"), F.coalesce("text", F.lit("")).alias("text")).filter("kind IN ('header', 'table', 'picture', 'text')")
    ends = F.col("kind") != "text"
    run = carried(i, "doc_id", "seq", {"island": ends.cast("int")}, {"section_path": F.when(F.col("kind") == "header", strip("text"))}, {"next_page": F.when(ends, F.col("page_no"))})
    prose = run.filter("kind = 'text'").groupBy("doc_id", "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min_by("page_no", "seq").alias("first_page"),
        F.first("next_page").alias("next_page"),
        F.first("section_path").alias("section_path"),
    )
    end = F.coalesce("next_page", "first_page")
    start = F.when(F.col("first_page") != 0, F.col("first_page")).otherwise(end)
    return prose.select("doc_id", F.col("island").cast("bigint").alias("island"), "text", start.alias("page_start"), end.alias("page_end"), F.coalesce("section_path", F.lit("")).alias("section_path"))


def section_chunks(items: DataFrame, doc: str = "doc_id", order: str = "seq") -> DataFrame:
    """The prose of ``sections`` in windows, with window_no."""
    s = sections(items, doc, order)
    return s.select("doc_id", "island", F.posexplode(windows("text")).alias("window_no", "text"), "page_start", "page_end", "section_path")


def register_chunks(rows: DataFrame, doc: str, register: str, order: str, cells: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, register, text, rows): one atomic chunk for each register of a table, rows in order, never windowed.

    ``cells`` are (label, column) pairs. Rows without a register are dropped; a null cell is empty; a repeated row counts once.
    """
    line = F.concat_ws(" | ", *[F.concat(F.lit(label + ": "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for label, c in cells])
    r = rows.select(F.col(doc).alias("doc_id"), F.col(register).alias("register"), F.col(order).alias("o"), line.alias("line")).filter("register IS NOT NULL").distinct()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"])
    return r.groupBy("doc_id", "register").agg(F.concat(F.lit("Register: "), F.first("register"), F.lit("\n"), F.array_join(lines, "\n")).alias("text"), F.count(F.lit(1)).alias("rows"))


def canonical_map(c: Column) -> Column:
    """The entries of a map in order, as k=v; null is empty."""
    return F.coalesce(F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ";"), F.lit(""))


SIGNATURE = ["doc_id", "text", "chunk_type", "page_start", "page_end", "section_path"]


def unique_ids(chunks: DataFrame, order: str = "seq") -> DataFrame:
    """(seq, occurrence, chunk_id): an id from everything a chunk says and how many equal chunks stand before it.

    The occurrence belongs to the whole signature and every field of it to the hash, so ids of different chunks differ.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SIGNATURE]
    sig = chunks.select(F.col(order).cast("bigint").alias("seq"), F.coalesce("doc_id", F.lit("")).alias("doc"), F.concat_ws(":", *text, canonical_map(F.col("meta"))).alias("sig")).distinct()
    n = numbered(sig.withColumn("h", F.sha1("sig")), ["h"], "seq", "occurrence")
    return n.select("seq", "occurrence", F.concat("doc", F.lit("_"), short_hash(F.concat_ws(":", "sig", F.col("occurrence").cast("string")))).alias("chunk_id"))


def repaired_ids(chunks: DataFrame, item: str, order: str = "seq") -> DataFrame:
    """(seq, id): the first row of an id keeps it; each later one gets a suffix of its position, type, pages and section."""
    c = chunks.select(F.col(order).cast("bigint").alias("seq"), F.col(item).alias("base"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("chunk_type", "page_start", "page_end", "section_path")]).distinct()
    n = numbered(c, ["base"], "seq", "nth")
    salt = short_hash(F.concat_ws(":", "base", F.col("seq").cast("string"), "chunk_type", "page_start", "page_end", "section_path"), 8)
    return n.select("seq", F.when(F.col("nth") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", salt)).alias("id"))


def upserted(store: DataFrame, update: DataFrame, key: str, version: str) -> DataFrame:
    """``store`` with ``update``'s rows in place of those of the same key: the row of the latest ``version`` of each key.

    Of equal versions the greatest row wins, so the result is the same in any order; nothing stale is deleted. Null keys are dropped.
    """
    both = store.unionByName(update)
    plain = [c for c in both.columns if c not in (key, version)]
    row = F.struct(F.col(version).alias("__v"), *[F.to_json(F.struct(c)).alias(f"__o_{i}") for i, c in enumerate(plain)], )
    best = both.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(version, *plain), row).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in both.columns if c != key])


def metadata() -> Column:
    """A chunk's provenance as one map: its five fixed entries, and meta_<k> for each entry of ``meta``; null values are empty."""
    fixed = F.create_map(*[x for c in ("doc_id", "chunk_type", "page_start", "page_end", "section_path") for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))])
    own = F.map_from_entries(F.transform(F.map_entries(F.coalesce("meta", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(F.lit("meta_"), e["key"]).alias("key"), F.coalesce(e["value"], F.lit("")).alias("value"))))
    return F.map_concat(fixed, own)


def table_rows(items: DataFrame, doc: str = "doc_id", order: str = "seq") -> DataFrame:
    """(doc_id, seq, row_no, cells) of items with ``table struct<header, rows>``, rows numbered from 1; no table gives no rows."""
    t = items.select(F.col(doc).alias("doc_id"), F.col(order).alias("seq"), "table").filter("kind = 'table'" if "kind" in items.columns else "true")
    return t.select("doc_id", "seq", F.posexplode("table.rows").alias("at", "cells")).select("doc_id", "seq", (F.col("at") + 1).alias("row_no"), "cells")


def table_chunks(items: DataFrame, doc: str = "doc_id", order: str = "seq") -> DataFrame:
    """(doc_id, seq, register, text): tables as atomic chunks, never windowed.

    A bit-field table with a column whose name contains "register" gives one chunk for each register, without rows that name
    none; any other table is one chunk, its header and rows as lines of cells between bars.
    """
    t = items.filter("kind = 'table' AND table IS NOT NULL").select(F.col(doc).alias("doc_id"), F.col(order).alias("seq"), "page_no", F.col("table.header").alias("h"), F.coalesce("table.rows", F.array().cast("array<array<string>>")).alias("rows"))
    at = F.array_position(F.transform("h", lambda x: F.contains(F.lower(x), F.lit("register"))), F.lit(True)).cast("int") - 1
    t = t.withColumn("at", F.when(looks_like_bit_fields(F.col("h")) & (at >= 0), at))
    bars = lambda r: F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | ")
    whole = t.filter("at IS NULL").select("doc_id", "seq", "page_no", F.lit(None).cast("string").alias("register"), F.concat_ws("\n", bars(F.col("h")), F.transform("rows", bars)).alias("text"))
    cells = t.filter("at IS NOT NULL").select("doc_id", "seq", "page_no", "h", "at", F.posexplode("rows").alias("no", "r")).withColumn("register", F.get("r", F.col("at"))).filter("register IS NOT NULL")
    line = F.array_join(F.transform(F.arrays_zip("h", "r"), lambda x: F.concat(x["h"], F.lit(": "), F.coalesce(x["r"], F.lit("")))), " | ")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"])
    split = cells.groupBy("doc_id", "seq", "page_no", "register").agg(lines.alias("lines")).select("doc_id", "seq", "page_no", "register", F.concat(F.lit("Register: "), "register", F.lit("\n"), F.array_join("lines", "\n")).alias("text"))
    return whole.unionByName(split)

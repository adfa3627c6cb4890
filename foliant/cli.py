"""Command line: python -m foliant.cli ingest|audit|graph|search|ask FOLDER ..."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import audit, images
from foliant.operators.chunking import unique_ids
from foliant.operators.lexical import LexicalIndex
from foliant.operators.tools import Agent, Engine
from foliant.plans.lineage import cut
from foliant.queries.audit import TERMS, full_issues
from foliant.queries.graph import entities
from foliant.sources import sinks
from foliant.sources.build import build
from foliant.sources.tables import table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", help="build the chunks of the registered files, and save them as a new version")
    i.add_argument("folder", help="has the table of registered documents")
    i.add_argument("--files", required=True, help="folder of the registered files")
    i.add_argument("--output", required=True)
    i.add_argument("--skip-images", action="store_true", help="leave pictures out")
    i.add_argument("--image-cache-only", action="store_true", help="take pictures' texts from the images table of the folder, where their analyses are cached; no model is called")
    a = sub.add_parser("audit", help="check chunks and graph of a data folder; exit 1 on any error")
    a.add_argument("folder")
    a.add_argument("--json", help="also write the report to this file")
    a.add_argument("--fresh", help="a table of chunks built anew (doc_id, chunk_id); without it, stale and missing chunks aren't looked for")
    a.add_argument("--files", help="folder of the registered files: build chunks anew from them and compare")
    a.add_argument("--skip-reparse", action="store_true", help="don't build chunks anew")
    a.add_argument("--include-image-processing", action="store_true", help="compare the chunks of pictures too")
    a.add_argument("--terms", nargs="*", default=TERMS, help="terms expected in graph and text")
    a.add_argument("--max-graph-terms", type=int, default=40, help="names of the graph that are looked for in the text")
    a.add_argument("--live-search", action="store_true", help="also search for the expected terms, by words")
    g = sub.add_parser("graph", help="save the entity graph, and a page to look at it")
    g.add_argument("folder")
    g.add_argument("--output", required=True)
    g.add_argument("--page")
    s = sub.add_parser("search", help="answer queries from standard input by words; a blank line is skipped, exit ends")
    s.add_argument("folder")
    s.add_argument("--top-k", type=int, default=6)
    q = sub.add_parser("ask", help="answer questions from standard input with a model that may search; a blank line is skipped, reset forgets, exit ends")
    q.add_argument("folder")
    q.add_argument("--chat", required=True, help="module:function of (messages, tools) -> message")
    q.add_argument("--embed", required=True, help="module:function of texts -> vectors")
    return p


def named(path: str) -> Callable:
    """The function that module:function names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _analysed_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the pictures whose analyses are cached."""
    done = images.indexable(table(spark, folder, "images").groupBy("image_id").agg(F.max_by(F.struct("*"), "analyzed_at").alias("i")).select("i.*"))
    rows = images.results(images.normalized_in_place(done))
    page = F.coalesce("page_no", F.lit(0))
    return rows.select("doc_id", F.lit("image_analysis").alias("chunk_type"), images.chunk_text().alias("text"), page.alias("page_start"), page.alias("page_end"), F.coalesce("section_path", F.lit("")).alias("section_path"), images.structured_meta().alias("meta"))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "ingest":
        chunks = build(spark, table(spark, args.folder, "registry"), args.files, skip_images=args.skip_images or args.image_cache_only)
        if args.image_cache_only and not args.skip_images:
            pictures = cut(_analysed_pictures(spark, args.folder).withColumn("seq", F.monotonically_increasing_id() + F.lit(2**62)))
            chunks = chunks.unionByName(pictures.join(unique_ids(pictures).select("seq", "chunk_id"), "seq"))
        print("chunks:", spark.read.parquet(sinks.save_version(chunks, args.output)).count())
        return 0
    if args.command == "audit":
        fresh = spark.read.parquet(args.fresh) if args.fresh else None
        if args.files and not args.skip_reparse and fresh is None:
            fresh = build(spark, table(spark, args.folder, "registry"), args.files, skip_images=not args.include_image_processing)
        issues = cut(full_issues(spark, args.folder, fresh, args.terms, args.max_graph_terms, args.include_image_processing))
        if args.live_search:
            chunks = table(spark, args.folder, "chunks")
            issues = issues.unionByName(audit.search_issues(spark, args.terms, lambda q: LexicalIndex(chunks, "seq", "text").search(q, "q", "t", 3)))
        if fresh is None:
            print("Stale and missing chunks: not checked (no --fresh or --files).")
        print("\n".join(sinks.report_lines(issues)))
        failed = sinks.save_report(issues, args.json) if args.json else audit.severities(issues).first().failed
        return int(failed)
    if args.command == "graph":
        g = entities(spark, args.folder)
        sinks.save_graph(g.nodes, g.edges, args.output)
        if args.page:
            sinks.save_viewer(g.nodes, g.edges, args.page)
        return 0
    if args.command == "ask":
        g = entities(spark, args.folder)
        vectors = table(spark, args.folder, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
        agent = Agent(Engine(table(spark, args.folder, "chunks"), vectors, g.nodes, g.edges, named(args.embed)), named(args.chat))
        for line in sys.stdin:
            text = line.strip()
            if text in ("exit", "quit"):
                break
            if text == "reset":
                agent.reset()
            elif text:
                print(agent.ask(text))
        return 0
    chunks = table(spark, args.folder, "chunks").groupBy("seq").agg(F.min(F.struct("chunk_id", "text")).alias("c")).select("seq", "c.*")
    index = LexicalIndex(chunks, "seq", "text")
    for line in sys.stdin:
        text = line.strip()
        if text in ("exit", "quit"):
            break
        if text:
            hits = index.search(spark.createDataFrame([(0, text)], "q bigint, t string"), "q", "t", args.top_k)
            for r in hits.join(chunks, F.col("item") == F.col("seq")).orderBy("rank").select("rank", "score", "chunk_id", "text").collect():
                print(r.rank, r.score, r.chunk_id, (r.text or "")[:80].replace("\n", " "))
    return 0


if __name__ == "__main__":
    sys.exit(main())

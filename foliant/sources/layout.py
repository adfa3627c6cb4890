"""Documents as ordered layout items: from text, from HTML, or through a parser of one's own."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS = "doc_id string, seq bigint, kind string, page_no int, text string"
#: A parser turns a file's bytes into (kind, page_no, text) items; kinds are header, table, picture and text.
Parser = Callable[[bytes], list[tuple[str, int, str]]]


def text_items(docs: DataFrame, doc: str, text: str, lines_a_page: int = 5) -> DataFrame:
    """(doc_id, seq, kind, page_no, text): the lines of plain texts as items.

    A line that is a part number alone is a header, one that assigns a hex value a table, any other that isn't blank text. Pages are made up,
    of ``lines_a_page`` lines. Null texts have no items; a repeated row counts once.
    """
    rows = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).dropna().distinct()
    lines = rows.select("doc_id", F.posexplode(F.split("t", "\n")).alias("at", "text"))
    kind = F.when(F.col("text").rlike(r"^\s*[A-Z][A-Z0-9]*-\d+\s*$"), "header").when(F.col("text").rlike("^[A-Z0-9_]+ = 0x"), "table").when(F.trim("text") != "", "text")
    return lines.select("doc_id", (F.col("at") + 1).cast("bigint").alias("seq"), kind.alias("kind"), (F.floor(F.col("at") / lines_a_page) + 1).alias("page_no"), "text").filter("kind IS NOT NULL")


class _Html(HTMLParser):
    _KINDS = {"h1": "header", "h2": "header", "h3": "header", "p": "text", "li": "text", "table": "table", "img": "picture"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, int, str]] = []
        self.kind: str | None = None
        self.parts: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.skipped += 1
        if kind := self._KINDS.get(tag):
            if self.kind != "table":
                self.flush()
                self.kind = kind
            if kind == "picture":
                self.items.append(("picture", 1, dict(attrs).get("alt") or ""))
                self.kind = None
        elif tag in ("tr", "br"):
            self.parts.append("\n")
        elif tag in ("td", "th"):
            self.parts.append(" | ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skipped = max(0, self.skipped - 1)
        if self._KINDS.get(tag) == self.kind:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.kind and not self.skipped:
            self.parts.append(data)

    def flush(self) -> None:
        text = re.sub(r"[ \t]+", " ", "".join(self.parts)).strip()
        if self.kind and text:
            self.items.append((self.kind, 1, text))
        self.kind, self.parts = None, []


def parse_html(content: bytes) -> list[tuple[str, int, str]]:
    """Headings, paragraphs, list items, tables and pictures of a page, scripts and styles left out."""
    p = _Html()
    p.feed(content.decode("utf-8", "replace"))
    p.flush()
    return p.items


def parse_text(content: bytes) -> list[tuple[str, int, str]]:
    return [("text", 1, line) for line in content.decode("utf-8", "replace").split("\n") if line.strip()]


PARSERS: dict[str, Parser] = {"html": parse_html, "htm": parse_html, "txt": parse_text, "md": parse_text}


def parsed(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Items of ``files(doc_id, path, content)``, each by the parser of its ending. Other endings give no items; for PDF pass a parser."""
    known = PARSERS | (parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, k, p, t) for d, path, c in zip(b.doc_id, b.path, b.content, strict=True) if c is not None and (f := known.get(path.rpartition(".")[2].lower())) for i, (k, p, t) in enumerate(f(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "kind", "page_no", "text"])

    return files.select("doc_id", "path", "content").mapInPandas(run, ITEMS)

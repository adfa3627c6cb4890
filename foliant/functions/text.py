"""Text functions as column expressions; blanks are those of Unicode, as both engines' patterns can name them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without blanks of any kind at the ends; null stays null."""
    return F.regexp_replace(col(c), rf"^{BLANK}+|{BLANK}+$", "")


def norm(c: str | Column) -> Column:
    """Stripped, in lower case; null is empty."""
    return F.lower(strip(F.coalesce(col(c), F.lit(""))))


def tokens(c: str | Column) -> Column:
    """Lower-case words between blanks, punctuation kept; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), f"{BLANK}+"), lambda w: w != "")


def word_count(c: str | Column) -> Column:
    return F.size(tokens(c))


def safe_int(c: str | Column) -> Column:
    """A whole number written out, else null."""
    return F.trim(col(c).cast("string")).try_cast("int")


def first_text(*cs: str | Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs])


def whole_term(text: str | Column, term: str) -> Column:
    """Whether ``term`` stands in ``text`` with no word character beside it, in any case; an empty term never does."""
    t = term.strip()
    if not t:
        return F.lit(False)
    return F.coalesce(col(text).rlike(r"(?iU)(?<!\w)\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E(?!\w)"), F.lit(False))


def short_hash(c: Column, digits: int = 12) -> Column:
    return F.substring(F.sha1(c), 1, digits)


def hamming_hex(a: str | Column, b: str | Column) -> Column:
    """Differing bits of two hashes of 16 hex digits; 64 if either is none."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("bigint")
    a, b = col(a), col(b)
    ok = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    pad = lambda c: F.lpad(c, 16, "0")
    bits = F.bit_count(half(pad(a), 1).bitwiseXOR(half(pad(b), 1))) + F.bit_count(half(pad(a), 9).bitwiseXOR(half(pad(b), 9)))
    return F.when(ok, bits).otherwise(64)


def json_object(c: str | Column) -> Column:
    """The outermost {...} of a model's answer, without the fence it may start with, if it parses as an object; else null."""
    s = strip(c)
    bare = F.when(s.startswith("```"), F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(s)
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)


def html_escape(c: str | Column) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out

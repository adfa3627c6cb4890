"""Visually identical text: a confusables skeleton groups texts that look the same."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.lineage import cut
from foliant.plans.skew import attach, member_pairs, pairs_within

# Letters that share a shape, each line a prototype and the letters drawn like it.
LOOK_ALIKES = """
A Α А
B Β В
C С Ϲ
E Ε Е
F Ϝ
G Ԍ
H Η Н
I Ι І Ӏ
J Ј Ϳ
K Κ К
M Μ М
N Ν
O Ο О
P Ρ Р
Q Ԛ
S Ѕ
T Τ Т
W Ԝ
X Χ Х
Y Υ Ү У
Z Ζ
a α а ɑ
c ϲ с ᴄ
d ԁ
e е
g ɡ
h һ
i ι і ı
j ϳ ј
k κ к
l ӏ
o ο о ᴏ
p ρ р
q ԛ
s ѕ ꜱ
u υ
v ν ѵ ᴠ
w ԝ ѡ ᴡ
x х χ
y γ у ү
z ᴢ
Γ Г
Δ ∆
Π П ∏
Σ ∑
Φ Ф
Λ Л
Ω Ω
μ µ
π п
φ ф
ε є
"""
#: Format characters and joiners that take no room, beside those of category Cf.
_NO_WIDTH = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}


@lru_cache(1)
def prototypes() -> dict[int, str]:
    """Code point → what it looks like, for every code point that is not its own prototype (after decomposition)."""
    table: dict[int, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if kind == "Cf" or cp in _NO_WIDTH or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            table[cp] = ""
        elif kind == "Zs":
            table[cp] = " "
        else:
            how, _, to = unicodedata.decomposition(ch).partition(" ")
            # ligatures, sign variants, and numerals that are drawn as letters; the long s is not drawn as an s
            same_letters = how in ("<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>") and (kind[0] == "L" or kind == "Nl") and cp != 0x017F
            if how in ("<wide>", "<narrow>") or same_letters:
                to = unicodedata.normalize("NFKD", ch)
                if how in ("<wide>", "<narrow>") or all(unicodedata.category(x)[0] in "LM" for x in to):
                    table[cp] = to
    for line in LOOK_ALIKES.split("\n"):
        for other in line.split()[1:]:
            table[ord(other)] = line[0]
    for cp, to in list(table.items()):  # what a character maps to may have a prototype itself
        table[cp] = "".join(table.get(ord(x), x) for x in to)
    table[ord("\t")] = " "
    return table


def skeleton(text: str) -> str:
    """Decompose, put each character's prototype in its place, decompose again."""
    if text.isascii():
        return text.replace("\t", " ")
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes()))


def skeletons_of_characters() -> dict[str, str]:
    """Every character that is not its own skeleton, with its skeleton; without the Korean syllables, whose parts follow from their number."""
    return {chr(cp): look for cp in [9, *range(0x80, sys.maxunicode + 1)] if not (0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF) and (look := skeleton(chr(cp))) != chr(cp)}


@lru_cache(1)
def cyrillic_letters() -> dict[int, str]:
    return {ord(line[0]): x for line in LOOK_ALIKES.split("\n") for x in reversed(line.split()[1:]) if "\u0400" <= x <= "\u04ff"}


def consistent_text(text: str) -> str:
    """The form that stands for every text with this skeleton: the skeleton, composed.

    A word that keeps Cyrillic letters without a look-alike is spelled in Cyrillic throughout; this is read off
    the skeleton alone, so equal skeletons still give equal forms.
    """
    look = skeleton(text)
    if not look.isascii():
        look = re.sub(r"[^\W\d_]+", lambda m: m[0].translate(cyrillic_letters()) if re.search("[\u0400-\u04ff]", m[0]) else m[0], look)
    return unicodedata.normalize("NFC", look)


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def skeletons(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, look, exact): 128-bit digests of each text's skeleton and of the text itself. Null ids and texts give no row.

    Texts of ASCII alone are hashed where they are read; only the others pass through Arrow to Python.
    """
    rows = df.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("t")).dropna()
    plain = ~F.col("t").rlike(r"[^\x00-\x7F]")
    ascii_only = rows.filter(plain).select("item", F.unhex(F.md5(F.translate("t", "\t", " "))).alias("look"), F.unhex(F.md5("t")).alias("exact"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            looks = pa.array([_digest(skeleton(x)) for x in texts], pa.binary())
            yield pa.record_batch([b.column(0), looks, pa.array([_digest(x) for x in texts], pa.binary())], names=["item", "look", "exact"])

    kind = rows.schema["item"].dataType.simpleString()
    return ascii_only.unionByName(rows.filter(~plain).mapInArrow(run, f"item {kind}, look binary, exact binary"))


def look_alike_groups(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, look, exact) of the records whose text looks like another text made of other characters.

    Compared are whole texts. Wide and narrow forms, composed and decomposed accents, ligatures, sign variants,
    look-alike letters and the kinds of blank are one; characters without width are nothing. Case, accents,
    superscripts, punctuation, line ends and differences within ASCII are kept. Null texts are no text; an empty
    text looks like one of characters without width. A record delivered again counts once. Records travel as
    two digests and an id, never as text.
    """
    rows = cut(skeletons(df, item, text).distinct())
    looks = rows.groupBy("look").agg(F.min("exact").alias("low"), F.max("exact").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    return attach(rows, looks.select("look", "n"), ["look"], "n").select("item", "look", "exact")


def look_alike_pairs(df: DataFrame, item: str, text: str) -> DataFrame:
    """(a, b), a < b: pairs of records that look the same and are not the same characters."""
    rows = cut(look_alike_groups(df, item, text))
    # pairs of representatives: variants of one look; members of each follow by their text's digest
    variants = rows.select("look", "exact").distinct()
    pairs = pairs_within(variants, ["look"], "exact")
    return member_pairs(pairs, rows, "exact", "item")


def consistent(df: DataFrame, item: str, text: str, out: str = "text") -> DataFrame:
    """Each record once, with its text brought to the one consistent form (null stays null)."""
    rows = df.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias(out)).filter("item IS NOT NULL").distinct()
    plain = F.col(out).isNull() | ~F.col(out).rlike(r"[^\x00-\x7F]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([consistent_text(x) for x in b.column(1).to_pylist()], pa.string())], names=["item", out])

    kind = rows.schema["item"].dataType.simpleString()
    return rows.filter(plain).withColumn(out, F.translate(out, "\t", " ")).unionByName(rows.filter(~plain).mapInArrow(run, f"item {kind}, {out} string"))

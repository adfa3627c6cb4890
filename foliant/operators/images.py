"""Pictures: hashes, the analysis cache, and what a model's analysis is turned into."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import hamming_hex, json_object, strip
from foliant.plans.skew import union_all

# Picture types, those never indexed, the least side in pixels, and the bits a near hash may differ in.
TECHNICAL = ["flowchart", "timing_diagram", "block_diagram", "chart", "table_image", "schematic", "state_machine", "waveform", "plot", "other"]
DECORATION = ["logo", "decorative", "photo"]
LEAST_SIDE, NEAR_BITS = 32, 3


def string_list(c: Column) -> Column:
    """An array's elements stripped, without blank ones; null is empty."""
    return F.coalesce(F.filter(F.transform(c, strip), lambda x: x != ""), F.array().cast("array<string>"))


def picture_type(c: Column) -> Column:
    return F.lower(strip(F.coalesce(F.nullif(c, F.lit("")), F.lit("other"))))


def normalized(df: DataFrame, key: str = "image_id") -> DataFrame:
    """A model's answer in one form: technical types but "other" are indexed whatever it says, decoration never; texts stripped, null is empty."""
    kind = picture_type(F.col("image_type"))
    said = F.coalesce("should_index", F.lit(False))
    index = F.when(kind.isin(DECORATION), False).when(kind.isin(TECHNICAL), said | (kind != "other")).otherwise(said)
    texts = [strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "summary", "extracted_text")]
    return df.select(F.col(key), index.alias("should_index"), kind.alias("image_type"), *texts, *[string_list(F.col(c)).alias(c) for c in ("entities", "relationships", "search_terms")], F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def results(df: DataFrame, key: str = "image_id") -> DataFrame:
    """What is kept of an analysis: an unknown type is "other", logos and decoration are not indexed (a photo may be), an empty title is named."""
    kind = F.when(F.col("image_type").isin(TECHNICAL + DECORATION), F.col("image_type")).otherwise("other")
    n = df.withColumn("image_type", kind)
    index = F.when(F.col("image_type").isin("logo", "decorative"), False).otherwise(F.coalesce("should_index", F.lit(False)))
    return n.withColumns({"should_index": index, "title": F.coalesce(F.nullif("title", F.lit("")), F.lit("Document image"))})


def chunk_text() -> Column:
    """The labelled lines of an analysis; optional ones are left out where empty."""
    listed = lambda label, c, sep: F.when(F.size(c) > 0, F.concat(F.lit(label + ": "), F.array_join(c, sep)))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Image type: "), "image_type"),
        F.concat(F.lit("Title: "), "title"),
        F.concat(F.lit("Summary: "), "summary"),
        F.when(F.col("extracted_text") != "", F.concat(F.lit("Visible text: "), "extracted_text")),
        listed("Entities", "entities", ", "),
        listed("Relationships", "relationships", "; "),
        listed("Search terms", "search_terms", ", "),
    )


def structured_meta() -> Column:
    """The twelve provenance entries of a picture's chunk."""
    entries = {"image_sha256": "image_sha256", "image_phash": "perceptual_hash", "image_path": "image_path", "image_type": "image_type", "image_title": "title", "image_width": "width", "image_height": "height", "image_ordinal": "ordinal", "image_from_cache": "from_cache", "image_confidence": "confidence"}
    plain = [x for k, c in entries.items() for x in (F.lit(k), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    lists = [x for k, c in (("image_entities", "entities"), ("image_search_terms", "search_terms")) for x in (F.lit(k), F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ","))]
    return F.create_map(*plain, *lists)


def large_enough() -> Column:
    return F.coalesce((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE), F.lit(False))


def indexable(df: DataFrame, duplicates: bool = False) -> DataFrame:
    """Pictures to make chunks of: those to be indexed, and of one digest in a document only the first by ordinal, then by id.

    Picked by an aggregate that combines before its shuffle; a null digest repeats nothing.
    """
    rows = df.filter("should_index")
    if duplicates:
        return rows
    key = F.coalesce("image_sha256", F.concat(F.lit("#"), F.col("image_id").cast("string")))
    best = rows.groupBy("doc_id", key.alias("k")).agg(F.min(F.struct("ordinal", "image_id")).alias("m"))
    return rows.join(best.select(F.col("m.image_id").alias("image_id")), "image_id", "left_semi")


def cache_probe(images: DataFrame, cache: DataFrame, distance: int = NEAR_BITS) -> DataFrame:
    """(image_id, hit, cache_sha): "exact" by digest, else "near" by a hash within ``distance`` bits, else "none".

    Of several near entries the one with the least hash, then digest, is taken. Hashes within 3 bits agree in one of four bands of
    16 bits, so an equal band finds all of them; each is verified. A hash that isn't 16 hex digits is near nothing.
    """
    i = images.select("image_id", F.lower("image_sha256").alias("sha"), F.lower("perceptual_hash").alias("ph")).distinct()
    c = cache.select(F.lower("image_sha256").alias("c_sha"), F.lower("perceptual_hash").alias("c_ph")).dropna(subset=["c_sha"]).distinct()
    shas = c.select("c_sha").distinct()
    exact = i.join(shas, F.col("sha") == F.col("c_sha")).select("image_id", F.lit("exact").alias("hit"), F.col("c_sha").alias("cache_sha"))
    left = i.join(shas, F.col("sha") == F.col("c_sha"), "left_anti")
    good = lambda h: F.coalesce(F.col(h).rlike("^[0-9a-f]{16}$"), F.lit(False))
    bands = lambda h: F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.substring(F.col(h), 4 * k + 1, 4).alias("bits")) for k in range(4)]))
    hashes = left.filter(good("ph")).select("ph").distinct().select("ph", bands("ph").alias("b")).select("ph", "b.*")
    stored = c.filter(good("c_ph")).groupBy("c_ph").agg(F.min("c_sha").alias("c_sha")).select("c_ph", "c_sha", bands("c_ph").alias("b")).select("c_ph", "c_sha", "b.*")
    close = hashes.join(stored, ["band", "bits"]).filter(hamming_hex("ph", "c_ph") <= distance)
    best = close.groupBy("ph").agg(F.min(F.struct("c_ph", "c_sha")).alias("m")).select("ph", F.col("m.c_sha").alias("near_sha"))
    rest = left.join(best, "ph", "left").select("image_id", F.when(F.col("near_sha").isNotNull(), "near").otherwise("none").alias("hit"), F.col("near_sha").alias("cache_sha"))
    return union_all([exact, rest])


def difference_hash(pixels: Column, width: int) -> Column:
    """The bits left > right of neighbours in each row of a row-major grid of ``width`` columns, as hex digits of whole groups of four bits."""
    size = F.size(pixels)
    at = F.filter(F.sequence(F.lit(0), size - 2), lambda i: (i % width) != width - 1)
    bits = F.array_join(F.transform(at, lambda i: F.when(F.get(pixels, i) > F.get(pixels, i + 1), "1").otherwise("0")), "")
    nibbles = F.transform(F.sequence(F.lit(0), F.floor(F.length(bits) / 4).cast("int") - 1), lambda k: F.lower(F.conv(F.substring(bits, k * 4 + 1, F.lit(4)), 2, 16)))
    return F.array_join(nibbles, "")


def on_white(pixels: np.ndarray) -> np.ndarray:
    """Pixels (rows, columns, channels) as red, green and blue: grey is spread, transparency lies on white."""
    p = pixels.astype(np.uint16)
    if p.shape[2] in (2, 4):
        alpha = p[:, :, -1:]
        p = (p[:, :, :-1] * alpha + 255 * (255 - alpha) + 127) // 255
    return np.repeat(p, 3, axis=2).astype(np.uint8) if p.shape[2] == 1 else p.astype(np.uint8)


def png_bytes(rgb: np.ndarray) -> bytes:
    """The picture as a PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((len(rgb), 1), np.uint8), rgb.reshape(len(rgb), -1)], axis=1)  # each row with no filter
    header = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")


def _bicubic(size: int, wanted: int) -> np.ndarray:
    """Weights of ``size`` samples in each of ``wanted``: a cubic of four samples, widened where the picture shrinks, as whole 2^-22."""
    scale = size / wanted
    wide = max(scale, 1.0)
    centre = (np.arange(wanted)[:, None] + 0.5) * scale
    at = np.arange(size)[None, :]
    low, high = np.floor(centre - 2 * wide + 0.5), np.floor(centre + 2 * wide + 0.5)
    x = np.abs((at - centre + 0.5) / wide)
    w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0)) * ((at >= low) & (at < high))
    return np.rint(w / w.sum(axis=1, keepdims=True) * 2**22).astype(np.int64)


def grey_grid(rgb: np.ndarray, columns: int = 9, rows: int = 8) -> np.ndarray:
    """The picture in grey (the usual weights of luma), resized across and then down, each time rounded to a byte."""
    grey = (rgb.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16
    fit = lambda x: np.clip((x + 2**21) >> 22, 0, 255)
    return fit(_bicubic(rgb.shape[0], rows) @ fit(grey @ _bicubic(rgb.shape[1], columns).T))


def decoded(pictures: DataFrame) -> DataFrame:
    """(image_id, width, height, content, image_sha256, perceptual_hash) of ``pictures(image_id, width, height, channels, pixels)``.

    pixels are the bytes of row after row, of 1 to 4 channels (grey or red, green, blue, with or without opacity). content is the
    picture on white as PNG, its digest the sha256 of that, and the hash that of differences in a grey 9 x 8 grid. Pictures whose
    bytes don't fill their size, and empty ones, are left out; a null id stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, w, h, n, data in zip(b.image_id, b.width, b.height, b.channels, b.pixels, strict=True):
                rgb = on_white(np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(n)))
                out.append((i, w, h, png_bytes(rgb), grey_grid(rgb).ravel().tolist()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "content", "grid"])

    good = "width > 0 AND height > 0 AND channels BETWEEN 1 AND 4 AND length(pixels) = CAST(width AS bigint) * height * channels"
    kind = pictures.schema["image_id"].dataType.simpleString()
    rows = pictures.filter(good).select("image_id", "width", "height", "channels", "pixels").mapInPandas(run, f"image_id {kind}, width int, height int, content binary, grid array<int>")
    return rows.select("image_id", "width", "height", "content", F.sha2("content", 256).alias("image_sha256"), difference_hash(F.col("grid"), 9).alias("perceptual_hash"))


ANSWER = "should_index boolean, image_type string, title string, summary string, extracted_text string, entities array<string>, relationships array<string>, search_terms array<string>, confidence double"


def answers(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(key, analysis columns) of a model's texts; one that holds no JSON object stands as an indexable "other" of confidence 0.5."""
    parsed = F.from_json(json_object(text), ANSWER)
    kept = raw.select(F.col(key), parsed.alias("a"), strip(F.coalesce(text, F.lit(""))).alias("raw"))
    plain = {"should_index": F.lit(True), "image_type": F.lit("other"), "title": F.lit(None), "summary": F.col("raw"), "confidence": F.lit(0.5)}
    names = [c.split()[0] for c in ANSWER.split(", ")]
    return kept.select(key, *[F.when(F.col("a").isNull(), plain.get(c, F.lit(None))).otherwise(F.col(f"a.{c}")).alias(c) for c in names])


def analysed(candidates: DataFrame, cache: DataFrame, analyse: Callable[[bytes], str | None] | None) -> tuple[DataFrame, DataFrame]:
    """Results for each candidate, and the cache with what was analysed now.

    ``candidates(image_id, doc_id, ordinal, width, height, content, perceptual_hash)``, ``cache(image_sha256, perceptual_hash, + analysis)``. Small ones are
    left out. All look-ups come before any analysis; of equal digests one is analysed; ``analyse`` may be None (cache only). A picture whose analysis fails
    (None or an exception) has no result and isn't cached. ``analyse`` is called for one picture at a time, as a vision model takes them. Of several
    cached analyses of one digest the least is taken.
    """
    from foliant.plans.lineage import cut

    ready = cut(candidates.filter(large_enough()).withColumn("image_sha256", F.sha2("content", 256)))
    probe = cut(cache_probe(ready, cache))
    names = [c.split()[0] for c in ANSWER.split(", ")]
    stored = cache.select(F.lower("image_sha256").alias("cache_sha"), *names).groupBy("cache_sha").agg(F.min(F.struct(*names)).alias("a")).select("cache_sha", "a.*")
    new = ready.join(probe.filter("hit = 'none'").select("image_id"), "image_id", "left_semi").groupBy("image_sha256").agg(F.first("content").alias("content"), F.min("perceptual_hash").alias("perceptual_hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = []
            for content in b.content:
                try:
                    said.append(analyse(bytes(content)) if analyse else None)
                except Exception:  # noqa: BLE001 - one picture's failure must not lose the others
                    said.append(None)
            yield pd.DataFrame({"image_sha256": b.image_sha256, "perceptual_hash": b.perceptual_hash, "said": said})

    said = cut(new.mapInPandas(run, "image_sha256 string, perceptual_hash string, said string")).filter("said IS NOT NULL")
    fresh = said.select("image_sha256", "perceptual_hash").join(normalized(answers(said, "image_sha256", "said"), "image_sha256"), "image_sha256")
    from_cache = ready.join(probe.filter("hit <> 'none'"), "image_id").join(stored, "cache_sha").withColumn("from_cache", F.lit(True))
    from_model = ready.drop("perceptual_hash").join(probe.filter("hit = 'none'"), "image_id").join(fresh.drop("perceptual_hash"), "image_sha256").withColumn("from_cache", F.lit(False))
    out = [results(normalized_in_place(x)).select("image_id", "doc_id", "ordinal", "image_sha256", "from_cache", *names) for x in (from_cache, from_model)]
    cached = cache.select("image_sha256", "perceptual_hash", *names).unionByName(fresh.select("image_sha256", "perceptual_hash", *names))
    return union_all(out), cached


def normalized_in_place(df: DataFrame) -> DataFrame:
    """``df`` with its analysis columns in the one form, others as they are."""
    rest = [c for c in df.columns if c not in [x.split()[0] for x in ANSWER.split(", ")] and c != "image_id"]
    return normalized(df.withColumn("__rest", F.struct("image_id", *rest)), "__rest").select("__rest.*", *[x.split()[0] for x in ANSWER.split(", ")])

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import images as I  # noqa: E741
from tests.conftest import rows

ANALYSIS = "image_id int, should_index boolean, image_type string, title string, summary string, extracted_text string, entities array<string>, relationships array<string>, search_terms array<string>, confidence double"


def analysis(spark, *data):
    return spark.createDataFrame([(i, s, t, None, " s ", None, ["a ", " "], None, [], None) for i, (s, t) in enumerate(data)], ANALYSIS)


def test_normalize(spark):
    n = I.normalized(analysis(spark, (True, "Waveform "), (True, "photo"), (False, "other"), (True, "sankey"), (None, None), (False, "chart")))
    got = [(r.should_index, r.image_type) for r in n.orderBy("image_id").collect()]
    assert got == [(True, "waveform"), (False, "photo"), (False, "other"), (True, "sankey"), (False, "other"), (True, "chart")]
    first = n.orderBy("image_id").first()
    assert (first.summary, first.extracted_text, first.entities, first.relationships, first.confidence) == ("s", "", ["a"], [], 0.0)
    r = I.results(n).orderBy("image_id").collect()
    assert (r[3].image_type, r[3].should_index, r[0].title) == ("other", True, "Document image")


def test_chunk_text(spark):
    r = I.results(I.normalized(analysis(spark, (True, "chart")))).select(I.chunk_text()).first()[0]
    assert r == "Image type: chart\nTitle: Document image\nSummary: s\nEntities: a"


@pytest.mark.parametrize(("w", "h", "ok"), [(32, 32, True), (31, 99, False), (None, 50, False)])
def test_size(spark, w, h, ok):
    assert spark.createDataFrame([(w, h)], "width int, height int").select(I.large_enough()).first()[0] is ok


def test_indexable(spark):
    df = spark.createDataFrame([(1, "d", 2, "x", True), (2, "d", 1, "x", True), (3, "e", 1, "x", True), (4, "d", 3, None, True), (5, "d", 4, None, True), (6, "d", 0, "y", False)], "image_id int, doc_id string, ordinal int, image_sha256 string, should_index boolean")
    assert rows(I.indexable(df), "image_id") == [(2,), (3,), (4,), (5,)]
    assert I.indexable(df, True).count() == 5 and I.indexable(df.limit(0)).count() == 0


def test_cache_probe_against_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    flip = lambda h, k: h ^ sum(1 << b for b in rng.sample(range(64), k))
    images = [(i, f"s{i % 50}", f"{flip(rng.choice(base), rng.randrange(6)):016X}") for i in range(200)] + [(300, None, None), (301, "zz", "n/a")]
    cache = [(f"S{i}", f"{base[i % 40]:016x}") for i in range(25, 65)] + [(None, "0" * 16)]
    got = I.cache_probe(spark.createDataFrame(images, "image_id int, image_sha256 string, perceptual_hash string"), spark.createDataFrame(cache, "image_sha256 string, perceptual_hash string"))
    known = [(s.lower(), int(h, 16)) for s, h in cache if s]
    want = []
    for i, s, h in images:
        near = sorted((x, c) for c, x in known if h and len(h) == 16 and bin(x ^ int(h, 16)).count("1") <= 3)
        want.append((i, "exact", s) if s in dict(known) else (i, "near", near[0][1]) if near else (i, "none", None))
    assert rows(got) == sorted(want, key=repr)


def test_difference_hash(spark):
    grid = [float(x) for row in range(8) for x in ([9, 8, 7, 6, 5, 4, 3, 2, 1] if row % 2 else range(9))]
    assert spark.createDataFrame([(grid,)], "p array<double>").select(I.difference_hash(F.col("p"), 9)).first()[0] == "00ff" * 4


def test_meta(spark, folder):
    r = spark.read.parquet(f"{folder}/images.parquet").select(I.structured_meta().alias("m")).first()
    assert len(r.m) == 12


def test_pipeline(spark):
    cand = "image_id int, doc_id string, ordinal int, width int, height int, content binary, perceptual_hash string"
    data = [(1, "d", 1, 99, 99, bytearray(b"a"), "0" * 16), (2, "d", 2, 99, 99, bytearray(b"a"), "0" * 16), (3, "d", 3, 10, 99, bytearray(b"small"), "0" * 16), (4, "d", 4, 99, 99, bytearray(b"bad"), "f" * 16), (5, "d", 5, 99, 99, bytearray(b"text"), "a" * 16), (6, "d", 6, 99, 99, bytearray(b"near"), "5" * 15 + "4")]
    cache = spark.createDataFrame([("cafe", "5" * 16, True, "chart", "t", "s", "", [], [], [], 0.9)], "image_sha256 string, perceptual_hash string, " + I.ANSWER)

    def model(content):
        if content == b"bad":
            raise RuntimeError
        return "just words" if content == b"text" else '{"should_index": false, "image_type": " Plot ", "title": "T"}'

    found, cached = I.analysed(spark.createDataFrame(data, cand), cache, model)
    got = {r.image_id: (r.image_type, r.should_index, r.title, r.confidence, r.from_cache) for r in found.collect()}
    assert got == {1: ("plot", True, "T", 0.0, False), 2: ("plot", True, "T", 0.0, False), 5: ("other", True, "Document image", 0.5, False), 6: ("chart", True, "t", 0.9, True)}
    assert cached.count() == 3
    only, _ = I.analysed(spark.createDataFrame(data, cand), cache, None)
    assert rows(only, "image_id") == [(6,)]


def test_decoded_pictures(spark):
    falling = bytes(255 - 10 * (x % 18) for _ in range(16) for x in range(18))
    clear = bytes([10, 20, 30, 0] * 4)
    df = spark.createDataFrame([(1, 18, 16, 1, bytearray(falling)), (2, 2, 2, 4, bytearray(clear)), (3, 2, 2, 3, bytearray(b"xx")), (4, 0, 0, 1, bytearray()), (5, 18, 16, 1, None)], "image_id int, width int, height int, channels int, pixels binary")
    got = {r.image_id: r for r in I.decoded(df).collect()}
    assert set(got) == {1, 2} and got[1].perceptual_hash == "f" * 16 and got[2].perceptual_hash == "0" * 16
    assert bytes(got[2].content)[:8] == b"\x89PNG\r\n\x1a\n"
    import zlib

    data = bytes(got[2].content)
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")]) == (b"\0" + b"\xff" * 6) * 2  # white


def test_grid_keeps_flat_and_sized_pictures():
    flat = np.full((37, 53, 3), 77, np.uint8)
    assert (I.grey_grid(flat) == 77).all() and I.grey_grid(flat).shape == (8, 9)
    small = np.arange(72, dtype=np.uint8).reshape(8, 9)
    assert (I.grey_grid(np.repeat(small[:, :, None], 3, axis=2)) == small).all()  # nothing to resize

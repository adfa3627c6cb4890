import random

import numpy as np
import pandas as pd
import pytest

from foliant.llm import neardup
from tests.conftest import rows

SCHEMA = "image_id int, image_sha256 string, perceptual_hash string"


def near(spark, data):
    return neardup.NearDuplicates(spark.createDataFrame(data, SCHEMA), "image_id", "image_sha256", "perceptual_hash")


def brute(data):
    good = {i: (s.lower() if s else None, int(h, 16) if h and len(h) == 16 and all(c in "0123456789abcdefABCDEF" for c in h) else None) for i, s, h in data if i is not None}
    ids = sorted(good)
    pairs = {(a, b) for a in ids for b in ids if a < b and ((good[a][0] and good[a][0] == good[b][0]) or (None not in (good[a][1], good[b][1]) and bin(good[a][1] ^ good[b][1]).count("1") <= 3))}
    links, parent = {i: 0 for i in ids}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted(pairs, key=repr), sorted([(i, find(i), links[i]) for i in ids], key=repr)


def made(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 6)] + [0, 2**64 - 1]
    flip = lambda h, k: h ^ sum(1 << b for b in rng.sample(range(64), k))
    out = [(i, rng.choice([None, "", f"S{rng.randrange(n // 3)}"]), rng.choice(["{:016x}", "{:016X}"]).format(flip(rng.choice(base), rng.randrange(5)))) for i in range(n)]
    return out + [(n, "s1", "n/a"), (n + 1, "s1", None), (n + 2, None, None), (None, "s1", "0" * 16), (n + 3, None, "0" * 15), (n + 4, None, "0" * 17), out[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    data = made(240, seed)
    pairs, groups = brute(data)
    found = near(spark, data)
    assert rows(found.pairs()) == pairs
    assert rows(found.groups(), "item", "group_id", "links") == groups


def test_hot_digest_and_hash(spark):
    data = [(i, "same", "0" * 16) for i in range(60)] + [(i, "same", f"{i:016x}") for i in range(60, 90)] + [(200, "other", "0" * 15 + "1")]
    pairs, groups = brute(data)
    found = near(spark, data)
    assert rows(found.pairs()) == pairs and rows(found.groups(), "item", "group_id", "links") == groups


def test_empty(spark):
    found = near(spark, [])
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_miss_rate():
    assert neardup.miss_rate(3, 14, 32) < 5e-5 and neardup.miss_rate(0, 14, 32) == 0
    for n in (10, 3600, 35_000, 10**9):
        r = neardup.rows_for(n)
        assert neardup.miss_rate(3, r, neardup.bands_for(3, r, 1e-10)) <= 1e-10
        assert r <= 8 or n * (1 / 3) ** r <= 1


def test_recall_of_the_bands():
    """Measured misses at the full distance are as rare as the formula says."""
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**63, 20_000, dtype=np.int64)
    b = a.copy()
    bits = np.argsort(rng.random((len(a), 63)), axis=1)[:, :3]
    for k in range(3):
        b ^= np.int64(1) << bits[:, k].astype(np.int64)
    for rows_, bands in ((14, 4), (10, 6), (8, 3)):
        keys = neardup._band_keys(rows_, bands, 20)
        missed = int((keys(a) != keys(b)).all(axis=0).sum())
        assert abs(missed / len(a) - neardup.miss_rate(3, rows_, bands)) < 0.03
    for n in (4000, 20_000):
        r = neardup.rows_for(n)
        keys = neardup._band_keys(r, neardup.bands_for(3, r, 1e-10), 20)
        assert not (keys(a) != keys(b)).all(axis=0).any()


def test_many_close_hashes(spark):
    """50,000 different hashes, each five bits from one blank picture's, so that all buckets are hot; against all pairs."""
    rng = np.random.default_rng(4)
    v = np.unique((np.uint64(1) << np.argsort(rng.random((50_400, 64)), axis=1)[:, :5].astype(np.uint64)).sum(axis=1, dtype=np.uint64))[:50_000]
    assert len(v) == 50_000
    want = set()
    for at in range(0, len(v), 2000):
        i, j = np.nonzero(np.bitwise_count(v[at : at + 2000, None] ^ v[None, :]) <= 3)
        keep = at + i < j
        want |= set(zip((at + i[keep]).tolist(), j[keep].tolist(), strict=True))
    frame = spark.createDataFrame(pd.DataFrame({"image_id": np.arange(len(v)), "image_sha256": None, "perceptual_hash": [f"{x:016x}" for x in v.tolist()]}), "image_id bigint, image_sha256 string, perceptual_hash string")
    found = neardup.NearDuplicates(frame, "image_id", "image_sha256", "perceptual_hash").pairs().toPandas()
    assert set(zip(found.a.tolist(), found.b.tolist(), strict=True)) == want and want


def test_block_pairs_cover_a_bucket(spark, monkeypatch):
    """A bucket that is split into blocks, each pair of which is compared elsewhere, gives what one place would."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    data = [(i, None, f"{(1 << (i % 64)) ^ (i // 64):016x}") for i in range(300)]
    pairs, _ = brute(data)
    assert rows(near(spark, data).pairs()) == pairs


def test_hot_hash_near_another(spark):
    """Members of two large classes that are close meet in blocks."""
    data = spark.range(2600).selectExpr("id AS image_id", "CAST(NULL AS string) AS image_sha256", "CASE WHEN id < 2500 THEN repeat('0', 16) ELSE repeat('0', 15) || '1' END AS perceptual_hash")
    found = neardup.NearDuplicates(data, "image_id", "image_sha256", "perceptual_hash").pairs()
    assert found.count() == 2600 * 2599 // 2

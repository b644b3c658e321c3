"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from loglens.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int, norm string, part int"


def brute(rows):
    taken = set()
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not abs(256 * x) < H.LARGEST for x in vector):
            continue
        taken.add((key, (label + 1) % 10 if key % 7 == 0 else label, tuple(math.floor(256 * x) for x in vector)))
    out = []
    for a, mine, v in taken:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), key, label) for key, label, w in taken]
        alike = sorted((s, k) for s, k, label in scored if label == mine and k != a)[:5]
        others = sorted((s, k) for s, k, label in scored if label != mine)
        for p, positive in alike:
            fit = [(s, k) for s, k in others if -80 * p <= -100 * s <= -100 * p][:5]
            out += [(a, positive, rank, k, -p, -s) for rank, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    return sorted(map(tuple, H.mined(df).collect()))


def clustered(seed, n, wide, labels=3):
    """Vectors of different lengths around a few directions, some of them alike."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, wide))
    rows = []
    for key in range(n):
        v = centres[rng.integers(12)] + 0.2 * rng.normal(size=wide)
        rows.append((key, (v * rng.choice([0.05, 0.3, 1, 4])).tolist(), int(rng.integers(labels))))
    rows += [(n + k, rows[3][1], k % labels) for k in range(60)]
    return rows


@pytest.mark.parametrize("bucket", [4096, 64])
def test_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(H, "BUCKET", bucket)
    rows = clustered(1, 900, 16)
    want = brute(rows)
    assert got(spark, rows) == want and len(want) > 50


def test_awkward_rows(spark):
    rows = [(0, [0.0, 0.0], 1), (1, [1.0, 2.0], 1), (2, [-1.0, 0.5], 2), (3, None, 1), (4, [1.0, None], 1), (5, [math.nan, 1.0], 2),
            (6, [math.inf, 0.0], 2), (8, [1.0, 2.0], None), (None, [1.0, 1.0], 1), (100, [1.0, 2.0], 1), (100, [1.0, 2.0], 1),
            (9, [1.0, 2.0], 2), (10, [0.9, 1.9], 2), (11, [0.9, 1.9], 2), (11, [0.9, 1.9], 2), (12, [], 1), (13, [1.0], 2),
            (14, [1.0, 2.0, 3.0], 2), (200, [-1.0, -1.0], 1), (300, [1e30, 1.0], 1), (15, [200.0, 400.0], 3), (400, [300.0, 100.0], 3),
            (16, [250.0, 90.0], 3), (17, [290.0, 100.0], 4), (700, [5.0, 5.0], 9), (18, [4.0, 4.0], 0), (19, [3.9, 4.0], 5)]
    random.Random(1).shuffle(rows)
    want = brute(rows)
    assert got(spark, rows) == want and len(want) > 10


def test_one_vector_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET", 50)
    rows = clustered(3, 200, 8) + [(1000 + k, [0.5] * 8, k % 4) for k in range(200)]
    assert got(spark, rows) == brute(rows)


def test_corpus(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, H.mined(vectors).collect())) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, None, 1)]) == []


def test_lists_leave_out_no_row():
    """Every row that reaches the score is among the candidates, and the lists do exclude rows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 24))
    vectors = np.floor(256 * (centres[rng.integers(10, size=2000)] + 0.1 * rng.normal(size=(2000, 24)))).astype(np.int64)
    norms = np.sqrt((vectors**2).sum(axis=1))
    order = np.argsort(-norms)
    bucket = H.Bucket(np.arange(2000), np.zeros(2000, dtype=int), vectors[order], norms[order])
    queries = vectors[:40]
    visited = 0
    for share in (0.999, 0.9, 0.5, -0.5):
        lows = (share * norms[:40] * norms.max()).astype(np.int64)
        seen = {k: dict(zip(found.tolist(), scores.tolist())) for k, found, scores in bucket.search(queries, norms[:40], lows)}
        for k in range(40):
            exact = bucket.vectors @ queries[k]
            need = np.flatnonzero(exact >= lows[k])
            assert all(seen[k][r] == exact[r] for r in need.tolist())
        visited += sum(map(len, seen.values())) if share == 0.9 else 0
    assert visited < 0.3 * 40 * 2000

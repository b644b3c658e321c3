"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from loglens.llm import jaccard


def shingle_set(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute(rows):
    """[(doc_id, n_shingles, component_id)] by comparing everything with everything."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)):
                if 100 * len(a & b) >= 80 * len(a | b):
                    root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((key, len(s), least[find(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id bigint, text string, key string, n int")
    return sorted((tuple(r) for r in jaccard.components(df, **more).collect()), key=repr)


def corpus(seed, n=120, vocabulary=60):
    """Texts with copies, near copies on both sides of the bound, and passages that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(40)] for _ in range(3)]
    texts = []
    while len(texts) < n:
        text = [word() for _ in range(rng.choice([3, 8, 30, 60, 120]))]
        if rng.random() < 0.5:
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(passages)
        texts.append(text)
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = list(rng.choice([text, texts[-1]]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += [word() for _ in range(rng.randrange(len(copy) // 5 + 1))]
            texts.append(copy)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,hot", [(1, 256), (2, 3)])
def test_all_pairs(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_small_batches_and_a_long_run(spark, monkeypatch):
    """One group of near copies over many Arrow batches, with counts that stop early."""
    monkeypatch.setattr(jaccard, "HOT", 5)
    monkeypatch.setattr(jaccard, "TOGETHER", 80)
    rng = random.Random(5)
    base = [f"b{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(rng.randrange(3)):
            text[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(text)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = found(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute(rows)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in jaccard.components(docs).collect()), key=repr) == brute(rows)


CASES = [(1, None), (2, ""), (3, " \t\n"), (4, "Four Words Are Here"), (5, "four words\tare here"), (6, "four words are"),
         (7, "ÉCOLE one two three four"), (8, "école one two three four"), (9, "a b c d e"), (9, "a b c d e"), (10, "a b c d e a b c d e"),
         (None, "null id with five words"), (None, "alone null id with words"), (12, "null id with five words"),
         (13, "x " * 20_000), (14, "x x x x x"), (15, "x" * 100_000), (16, "a\x1cb c d e f"), (17, "a b c d e f")]


def test_cases(spark):
    assert found(spark, CASES) == brute(CASES)
    assert found(spark, []) == []


def test_one_of_each(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(CASES)], "doc_id bigint, text string, row int")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == [(False, k) for k in (1, 2, 3, 4, 6, 7, 8, 9, 10, 13, 15, 16, 17)] + [(True, 0)] * 2


def test_levels_never_exclude_a_partner():
    """A set with a partner is never dropped, and both share as many shingles as the lower level asks."""
    rng = np.random.default_rng(4)
    for _ in range(2000):
        n = int(rng.integers(1, 120))
        m = int(rng.integers(-(-4 * n // 5), 5 * n // 4 + 1))
        common = -(-8 * (n + m) // 18)
        if common > min(n, m):
            continue
        counts = {("c", k): int(rng.integers(2, 50)) for k in range(common)}
        one = {**counts, **{("a", k): 1 if rng.random() < 0.7 else int(rng.integers(2, 50)) for k in range(n - common)}}
        two = {**counts, **{("b", k): 1 if rng.random() < 0.7 else int(rng.integers(2, 50)) for k in range(m - common)}}
        prefixes = []
        for s in (one, two):
            shared = sorted((c, t) for t, c in s.items() if c > 1)
            level, taken = jaccard.choose_level(len(s), np.array([c for c, _ in shared]))
            assert level
            alone, over = len(s) - len(shared), len(s) - jaccard.least_common(len(s))
            prefixes.append((level, {t: max(1, alone + k - over + 1) for k, (_, t) in enumerate(shared[:taken])}))
        level = min(p[0] for p in prefixes)
        both = [t for t in prefixes[0][1] if t in prefixes[1][1] and max(p[1][t] for p in prefixes) <= level]
        assert len(both) >= level


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e f", "x", 1, None, 2.5), (2, "a b c d e f", "y", 2, "m", 2.5), (3, "other", None, 3, "n", None)]
    names = "doc_id bigint, text string, stays string, row int, met string, doc double"
    got = jaccard.one_of_each(spark.createDataFrame(rows, names))
    assert got.columns == ["doc_id", "text", "stays", "row", "met", "doc"]
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_slices_are_bounded():
    assert list(jaccard._slices([1, 1, 1, 5, 9, 1], 2, 6)) == [(0, 2), (2, 4), (4, 5), (5, 6)]
    assert list(jaccard._slices([], 2, 6)) == [] and list(jaccard._slices([99], 2, 6)) == [(0, 1)]


def test_near_misses_stay_apart_and_links_are_kept(spark):
    """Copies with few or too many changed words around one text, and a second text's copies."""
    import random

    draw = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(120):
        words = list(base)
        for at in draw.sample(range(200), 5 if k % 3 else 2):
            words[at] = f"x{k}_{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [set(map(int, jaccard.shingles(t))) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in jaccard.components(df).collect()}
    assert got == {k: find(k) for k in range(len(sets))} and 1 < len(set(got.values())) < 120


def test_filter_grows_with_its_keys(spark):
    import numpy as np

    keys = spark.range(60_000).selectExpr("xxhash64(id) AS x")
    chance = jaccard.Filter(keys, "x")
    held = np.array([r.x for r in keys.collect()], dtype=np.int64)
    assert chance.bits == 1 << 20 and chance.may_hold(held).all()
    other = np.array([r.x for r in spark.range(1_000_000, 1_020_000).selectExpr("xxhash64(id) AS x").collect()], dtype=np.int64)
    assert chance.may_hold(other).mean() < 0.02

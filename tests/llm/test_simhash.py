"""SimHash near-duplicates against brute force."""

import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loglens.llm import simhash
from loglens.llm.components import connected


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(values):
    """Least position of the component of every value."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 2:
                one, two = sorted((find(i), find(j)))
                root[two] = one
    return [find(i) for i in range(len(values))]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=80), st.text(alphabet="aB \t\x0b\x1c\x85É", max_size=120)))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_text_is_counted_in_parts(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "bb", "Ccc", "d"], k=5000))
    want = brute_fingerprint(text)
    monkeypatch.setattr(simhash, "_AT_ONCE", 64)
    assert simhash.fingerprint(text) == want


def test_links_are_all_pairs_in_reach(spark):
    """Random fingerprints with neighbours of one to three flipped bits, and a dense ball of them."""
    draw = random.Random(5)
    values = {0, 1, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        base = draw.getrandbits(64)
        values.add(base)
        for _ in range(4):
            values.add(base ^ sum(1 << k for k in draw.sample(range(64), draw.randint(1, 3))))
    ball = draw.getrandbits(64)
    values |= {ball ^ (1 << a | 1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fingerprint bigint")
    got = {frozenset(x & (1 << 64) - 1 for x in r) for r in simhash.links(df).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2}
    assert got == want and len(want) > 500


TEXTS = [None, "", " \t ", "one", "ONE", "one two", "a b c", "A  b\nC", "x" * 5000, "long text " * 20_000, "é É ß", "a b c d"]


def test_components_on_awkward_rows(spark):
    draw = random.Random(7)
    base = " ".join(draw.choices("alpha beta gamma delta epsilon zeta".split(), k=60))
    texts = TEXTS + [base, base + " eta", base.upper(), base.replace("alpha", "iota", 1)]
    rows = [(i, t, "clash", 1.5) for i, t in enumerate(texts)] + [(4, "one", "again", None), (4, "one", "again", None), (None, "one two", None, None), (None, "unique words here", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, least double")
    got = sorted((tuple(r) for r in simhash.components(df).collect()), key=repr)
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(prints)
    want = []
    for (key, *_), value, root in zip(rows, prints, roots):
        ids = [r[0] for r, other in zip(rows, roots) if other == root and r[0] is not None]
        want.append((key, f"{value:016x}", min(ids, default=None)))
    assert got == sorted(want, key=repr)


def test_components_of_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{p:016x}", rows[k].doc_id) for r, p, k in zip(rows, prints, brute_components(prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(rows)


def test_empty_table(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id int, text string")).collect() == []


@pytest.mark.parametrize("edges, want", [
    ([], {}), ([(1, 1)], {}), ([(k, k + 1) for k in range(300)], {0: 301}), ([(0, k) for k in range(1, 50)] + [(60, 70), (70, 61)], {0: 50, 60: 3})])
def test_connected(spark, edges, want):
    got = connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    by = {}
    for r in got:
        by.setdefault(r.root, []).append(r.point)
    assert {min(points): len(points) for points in by.values()} == want
    assert len(got) == sum(want.values())

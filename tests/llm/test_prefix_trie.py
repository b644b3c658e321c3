"""The trie of conversation prefixes against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loglens.llm import prefix_trie


def brute(rows):
    """Nodes by dictionaries of whole prefixes. Rows are (conv_id, turn, role, text)."""
    def digest(role, text):
        role, text = (role or "").encode(), (text or "").encode()
        return hashlib.sha256(str(len(role)).encode() + b":" + role + text).hexdigest()[:32]

    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, held in members.items():
        ends = sorted(c for c in held if len(whole[c]) == len(p))
        out.append((min(held), len(p), min(members[p[:-1]]) if p else None, len(held), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn int, role string, text string, key string, depth int")
    return sorted(map(tuple, prefix_trie.nodes(df, **more).collect()), key=repr)


def test_awkward_rows(spark):
    rows = [(0, 0, "user", "a"), (0, 1, None, None), (0, None, "user", "first"), (0, 2, "user", ""), (0, 2, "user", ""),
            (1, 0, "user", "b"), (1, 5, "assistant", "é" * 4000), (5, 3, "u:ser", "x"), (5, 3, "u", "ser:x"),
            (7, 0, "user", "only"), (12, 0, "", ""), (None, 0, "user", "lost"), (-3, 0, "user", "n"), (-7, 0, "user", "n"), (-5, 0, "a", "b"),
            (-10, 1, "user", "m"), (10**15, 0, "user", "a")]
    rows += [(20, k, "user", str(k % 3)) for k in range(300)] + [(c, k, "user", str(k % 3)) for c in (21, 22, 23, 24) for k in range(290 + c)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed, in_range", [(1, 20_000), (2, 7), (3, 40)])
def test_random_conversations(spark, seed, in_range):
    """Few words, so that prefixes, ends and copies meet everywhere; small ranges, so that they cross borders."""
    draw = random.Random(seed)
    shared = [(draw.choice(["user", "assistant"]), draw.choice(["a", "b", "c" * 9])) for _ in range(14)]
    rows = []
    for c in range(400):
        n = draw.choice([0, 1, 3, 9, 12, 14])
        turns = shared[:n] if draw.random() < 0.4 else [(draw.choice(["user", "assistant"]), draw.choice("ab")) for _ in range(n)]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    assert got(spark, rows, in_range=in_range) == brute(rows)


def test_group_of_copies_crosses_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(5 * c, k, "user", t) for c in range(500) for k, t in enumerate("same old story".split() + ["tail"] * (c % 97 == 0))]
    assert got(spark, rows, in_range=10) == brute(rows)


def test_corpus(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, prefix_trie.nodes(turns).collect()), key=repr) == brute(rows)


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "a")]) == []


def test_common_turns():
    a, b = bytes(range(64)), bytes(range(48)) + b"x" * 16
    assert [prefix_trie.common_turns(*p) for p in ((a, a), (a, b), (a, a[:16]), (a, b""), (b"y" * 16, a))] == [4, 3, 1, 0, 0]

"""Packing and byte-level BPE against the tokenizer libraries on awkward texts."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loglens.llm import bpe, packing

TEXTS = [
    None, "", " ", "a", "Hello, world.", "x" * 5000, "ab" * 3000 + " tail", "  \n\n\t two   spaces \r\n",
    "don't 'S we'LL it's", "ÉÈ café H̱ İ Σας ß", "<|endoftext|> <|startoftext|>",
    "Hello <|endoftext|> wor<|startoftext|>ld", "a<|EndOfText|>b <|ENDOFTEXT|>", "<|endoftext|" + " |>", "a\x1cb\x1d c",
    "日本語のテキスト 한국어 עברית 🙂🙃", "1234 12.5 0x9f ### !!,. a.b,c. end.", " nbsp wide\u0085next", "z" * 200 + ",",
    "!" * 3000, "​‍﻿", "word " * 9000,
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None), (3, "a", "again", 2), (3, "a", "again", 2)]
    return data, spark.createDataFrame(data, "doc_id bigint, text string, piece string, ids int")


def reference():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe_equals_the_library(rows):
    data, df = rows
    got = sorted(map(tuple, bpe.round_trip(df).collect()), key=repr)
    own = reference()
    want = []
    for key, text, *_ in data:
        ids = np.array(own.encode_ordinary(text or ""), dtype="<u4").tobytes()
        want.append((key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


CODEC = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
OWN = reference()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab ,.'sS1\n\t\x1c\x0bé", max_size=80), st.text(alphabet="thein", max_size=200)))
def test_bpe_on_any_text(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, dtype="<u4").tolist() == OWN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def whole(texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abÉ ,.'sS1\n\t\x1ć̱Hİ", max_size=80)))
def test_words_alone_give_the_ids_of_the_text(text):
    ids = packing.word_encoder(P.path("word_bpe_49k.json")).encode([text])[0]
    assert np.frombuffer(ids, dtype="<u4").tolist() == whole([text])[0]


def test_packing_holds_every_piece(rows):
    data, df = rows
    got = packing.packed_documents(df).collect()
    left = defaultdict(int)
    for (key, _, *_), ids in zip(data, whole([t for _, t, *_ in data])):
        ids = [*ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], dtype="<u4").tobytes()
            left[(key, k, at, len(part) // 4, zlib.crc32(part))] += 1
    for r in got:
        left[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] -= 1
    assert not any(left.values())
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_is_tight(spark):
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in np.minimum(rng.lognormal(6, 1, 20_000) + 1, 4096)]
    bins = packing.OpenSequences(4096, 64)
    used = {bins.place(n)[0] for n in lengths}
    assert len(used) == bins.made
    assert len(used) <= 1.02 * sum(lengths) / 4096


def test_fullest_closes_first():
    bins = packing.OpenSequences(10, 2)
    assert [bins.place(n) for n in (6, 7, 8, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]
    bins = packing.OpenSequences(10, 1)
    assert [bins.place(n) for n in (6, 5, 5)] == [(0, 0), (1, 0), (1, 5)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.packed_documents(none).collect() == []
    assert bpe.round_trip(none).collect() == []


def test_very_long_piece():
    """A piece of a million characters: its tokens are looked up window by window."""
    for text in ("a" * 1_000_000, "abcdefgh" * 50_000, "thequickbrown" * 30_000):
        ids = CODEC.encode(text)
        assert CODEC.decode(ids) == text.encode()
    text = "thequickbrown" * 3000 + "é" * 3000
    assert np.frombuffer(CODEC.encode(text), dtype="<u4").tolist() == OWN.encode_ordinary(text)


def test_memories_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "_PIECES", 100_000)
    monkeypatch.setattr(bpe, "_PAIRS", 50_000)
    monkeypatch.setattr(packing, "_KNOWN", 100_000)
    words = packing.WordEncoder(P.path("word_bpe_49k.json"))
    own = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = " ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(300))
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == OWN.encode_ordinary(text)
        assert np.frombuffer(words.encode([text])[0], dtype="<u4").tolist() == whole([text])[0]
        assert own.known_bytes <= 100_000 + 300 and len(own.pairs) * 100 <= 50_000 + 100 and len(words.known) <= 700


def test_one_operator_holds_memory_at_a_time():
    from loglens.llm import memory
    held = {"a": [1], "b": [1]}
    memory.claim("a", held["a"].clear)
    memory.claim("a", held["a"].clear)
    assert held == {"a": [1], "b": [1]}
    memory.claim("b", held["b"].clear)
    assert held == {"a": [], "b": [1]}
    memory.claim("c")
    assert held == {"a": [], "b": []}

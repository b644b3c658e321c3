"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so that one automaton over characters finds every token
that occurs in a piece of text. A sequence of tokens is what the merges give exactly if every
two neighbours are what the merges give for the two alone. The encoder therefore takes the
longest token at each place, goes back to shorter ones where it doesn't agree with its left
neighbour, and never tries a place twice that led nowhere. Agreement of two tokens is decided by
their merges once and remembered.

Defined cases: a null text is an empty one and has no tokens; a null id stays null; repeated rows
are encoded once each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.memory import claim, trim

#: Bytes of pieces and of token pairs that a worker remembers, at most; each memory starts anew when it
#: is full. An entry counts its text and what Python's objects take beside it.
_PIECES, _PAIRS, _LONG_PIECE = 64 << 20, 64 << 20, 64
_PIECE_BYTES, _PAIR_BYTES = 200, 100
#: Bytes of a piece whose tokens are looked up at once.
_WINDOW = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Starts:
    """The tokens that start at each place of a piece, shortest first, found window by window: only the
    window that is read is held."""

    def __init__(self, found, text: bytes, longest: int):
        self.found, self.text, self.longest, self.first, self.held = found, text, longest, 0, []

    def at(self, place: int) -> list[tuple[int, int]]:
        if not self.first <= place < self.first + len(self.held):
            self.first = place // _WINDOW * _WINDOW
            some = self.text[self.first : self.first + _WINDOW + self.longest]
            self.held = [[] for _ in some[:_WINDOW]]
            for last, (rank, length) in self.found.iter(some.decode("latin-1")):
                if last - length + 1 < len(self.held):
                    self.held[last - length + 1].append((rank, length))
        return self.held[place - self.first]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.split = regex.compile(pattern).findall
        self.split_ascii = _ascii_split(pattern)
        self.found = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.found.add_word(token.decode("latin-1"), (rank, len(token)))
        self.found.make_automaton()
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.pairs: dict[int, bool] = {}

    def forget(self) -> None:
        self.known.clear()
        self.known_bytes = 0
        self.pairs.clear()

    def merged(self, text: bytes) -> list[int]:
        """By the merges themselves, for two tokens: the pair of least rank is joined, the first
        where there are several."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            joined = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            least = min((r for r in joined if r is not None), default=None)
            if least is None:
                break
            at = joined.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def agree(self, left: int, right: int) -> bool:
        key = left << 32 | right
        said = self.pairs.get(key)
        if said is None:
            if len(self.pairs) * _PAIR_BYTES >= _PAIRS:
                self.pairs.clear()
            said = self.pairs[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return said

    def piece(self, text: bytes) -> list[int]:
        """Ids of one piece."""
        if not text:
            return []
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        if n <= _WINDOW:
            starts: list[list[tuple[int, int]]] = [[] for _ in text]
            for last, (rank, length) in self.found.iter(text.decode("latin-1")):
                starts[last - length + 1].append((rank, length))
            starts_at = starts.__getitem__
        else:
            starts_at = _Starts(self.found, text, self.longest).at
        dead = bytearray(n + 1)
        # The place, and how many of its tokens, shortest first, are still to be tried.
        ids: list[int] = []
        places: list[tuple[int, int]] = []
        at, left = 0, len(starts_at(0))
        while at < n:
            here = starts_at(at)
            while left:
                left -= 1
                rank, length = here[left]
                if not dead[at + length] and (not ids or self.agree(ids[-1], rank)):
                    ids.append(rank)
                    places.append((at, left))
                    at += length
                    left = len(starts_at(at)) if at < n else 0
                    break
            else:
                if not ids:
                    raise ValueError("the ranks don't cover every byte")
                dead[at] = 1
                ids.pop()
                at, left = places.pop()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids, each four bytes, little end first."""
        known = self.known
        parts = (self.split_ascii if self.split_ascii and text.isascii() else self.split)(text)
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        out = []
        for part in parts:
            ids = known.get(part)
            if ids is None:
                ids = np.array(self.piece(part.encode()), dtype="<u4").tobytes()
                if len(part) <= _LONG_PIECE:
                    if self.known_bytes >= _PIECES:
                        known.clear()
                        self.known_bytes = 0
                    known[part] = ids
                    self.known_bytes += _PIECE_BYTES + len(part)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _ascii_split(pattern: str):
    """The pattern for texts of ASCII only, where its classes are plain ranges. The standard
    library reads those, and faster."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]")
    plain = plain.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return None if "\\p" in plain or "\\P" in plain else re.compile(plain, re.ASCII).findall


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, each four bytes, little end first."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = codec(path, pattern)
        claim("bpe", known.forget)
        for batch in texts:
            yield pd.Series([known.encode(t or "") for t in batch], dtype=object)
        trim()

    return docs.select(F.col(doc_id).alias("doc_id"), F.pandas_udf(encode, "binary")(F.col(text)).alias("ids"))


def decoded(tokens: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
            ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes that the column of ids stands for."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def decode(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = codec(path, pattern)
        claim("bpe", known.forget)
        for batch in column:
            yield pd.Series([known.decode(x) for x in batch], dtype=object)
        trim()

    return tokens.withColumn("decoded", F.pandas_udf(decode, "binary")(F.col(ids)))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every document. One pass, so that a task needs
    one worker: texts are encoded, and what comes out is decoded."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = codec(path, pattern)
        claim("bpe", known.forget)
        for batch in texts:
            rows = []
            for value in batch:
                ids = known.encode(value or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(known.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        trim()

    said = F.pandas_udf(both, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), said.alias("said")).select("doc_id", "said.*")

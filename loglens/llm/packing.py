"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised, ended with a separator id and cut only where they are longer than a
sequence. The pieces are dealt at random over shards; each shard packs its pieces online with
bounded space: a fixed number of open sequences, kept in a bitset whose bit ``f`` says that some
open sequence has ``f`` free places. A piece goes to the open sequence with the least free space
that holds it. Where none does, a new one opens, and if that is one too many the fullest closes.

Defined cases: a null or empty text is the separator alone; a null id stays null; repeated rows are
packed once each; columns other than the id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import ChainMap
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.memory import claim, trim
from loglens.session import stage

#: Places in a sequence, and the id that ends each document.
SEQUENCE, SEPARATOR = 4096, 1
#: Open sequences of a shard, and pieces that a shard packs. Both bound memory, not the result.
OPEN, SHARD_PIECES = 1024, 40_000
#: Bytes of words and ids that a worker keeps, at most; the memory starts anew when it is full. An entry
#: counts its text and what Python's objects take beside it.
_KNOWN, _LONG_WORD, _WORD_BYTES = 176 << 20, 64, 240
#: New words encoded at once, and characters of the texts that are split at once.
_AT_ONCE, _GROUP = 500, 1_000_000
#: Python's ``split`` cuts at these, the tokenizer doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
PIECES = "length int, start bigint, piece int, ids_crc32 bigint"


def _letters_only(word: str) -> bool:
    """Letters in lower case as well: a capital I with a dot becomes a letter and a mark."""
    return word.isalpha() and (word.isascii() or word.lower().isalpha())


class WordEncoder:
    """Encodes texts to ids, each four bytes, little end first.

    The vocabulary never joins text across white space, so words are encoded by themselves and
    their ids are kept; a last comma or full stop after letters is a token of its own. New words of
    letters alone are encoded many at a time: each ends with the only token that ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold a token of the library's own list are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.marks = dict(zip(",.", self.plain([",", "."])))

    def forget(self) -> None:
        self.known.clear()
        self.known_bytes = 0

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters."""
        out = []
        for at in range(0, len(words), _AT_ONCE):
            some = words[at : at + _AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) != len(some):  # the two libraries see different letters
                out.extend(self.plain(some))
                continue
            packed = ids.tobytes()
            out.extend(packed[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()))
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Keep the ids of new words; those of very long ones are only returned."""
        known, marks = self.known, self.marks
        bare = {w: w[:-1] if w[-1] in marks and _letters_only(w[:-1]) else w for w in words}
        # Many a word is known without its comma.
        ids = {r: known[r] for r in set(bare.values()) if r in known}
        new = set(bare.values()).difference(ids)
        simple = [w for w in new if _letters_only(w)]
        other = list(new.difference(simple))
        ids.update(zip(simple, self.letters(simple)))
        ids.update(zip(other, self.plain(other)))
        found = {w: ids[b] if len(b) == len(w) else ids[b] + marks[w[-1]] for w, b in bare.items()}
        long = {w: found.pop(w) for w in words if len(w) > _LONG_WORD}
        self.known.update(found)
        self.known_bytes += len(found) * _WORD_BYTES
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        # In lower case: a word that only looks like such a token must not become one.
        lowered = [t.lower() if t.isascii() else t for t in texts]
        whole = [any(a in low or a in t for a in self.added) or _ODD_SPACE.search(t) for t, low in zip(texts, lowered)]
        split = [None if w else low.split() for low, w in zip(lowered, whole)]
        new = set().union(*[w for w in split if w]).difference(self.known)
        if self.known_bytes + len(new) * _WORD_BYTES > _KNOWN:
            self.forget()
            new = set().union(*[w for w in split if w])
        long = self.learn(new)
        ids = ChainMap(self.known, long) if long else self.known
        return [self.plain([t])[0] if w is None else b"".join(map(ids.__getitem__, w)) for t, w in zip(texts, split)]

    def stream(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, read in groups of bounded size."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _GROUP:
                yield from self.encode(group)
                group, size = [], 0
        yield from self.encode(group)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text",
                 sequence: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id as text, piece, start, length, ids_crc32) of every document; one narrow pass over the texts."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    end, step = separator.to_bytes(4, "little"), 4 * sequence

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(path)
        claim("packing", encoder.forget)
        for batch in batches:
            rows = []
            for key, ids in zip(batch["doc_id"], encoder.stream(t or "" for t in batch["text"])):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((key, len(part) // 4, at // 4, k, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "length", "start", "piece", "ids_crc32"])
        trim()

    # The id passes Python as text: pandas would turn a column of numbers with a null into floats.
    named = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInPandas(pieces, f"doc_id string, {PIECES}")


class OpenSequences:
    """The open sequences of one shard."""

    def __init__(self, sequence: int, most: int):
        self.sequence, self.most = sequence, most
        self.bits, self.by_free, self.open, self.made = 0, {}, 0, 0

    def _put(self, free: int, number: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(number)
            self.bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.sequence, self.made
            self.made += 1
            if self.open >= self.most and free > length:
                self._take((self.bits & -self.bits).bit_length() - 1)
        self._put(free - length, number)
        return number, self.sequence - free


def pack(pieces: DataFrame, sequence: int = SEQUENCE, most_open: int = OPEN,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``sequence``.

    ``pieces`` must be a written table: the deal takes row numbers from its files, so that a
    repeated task deals alike. Shards grow in number, not in size.
    """
    spark = pieces.sparkSession
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("_key", F.xxhash64(F.monotonically_increasing_id())).withColumn(
        "_shard", F.pmod("_key", F.lit(shards)).cast("int"))
    width = min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = [*pieces.columns, "sequence_id", "offset"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, bins = None, None
        for batch in batches:
            at = []
            for number, length in zip(batch["_shard"], batch["length"]):
                if number != shard:
                    shard, bins = number, OpenSequences(sequence, most_open)
                local, offset = bins.place(length)
                at.append(((int(number) << 32) + local, offset))
            placed = pd.DataFrame(at, columns=["sequence_id", "offset"], dtype="int64")
            yield pd.concat([batch.reset_index(drop=True), placed], axis=1)[columns]

    return (
        dealt.repartition(width, "_shard").sortWithinPartitions("_shard", "_key")
        .mapInPandas(place, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))
    )


def packed_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text",
                     sequence: int = SEQUENCE, separator: int = SEPARATOR, most_open: int = OPEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    kind = docs.schema[doc_id].dataType.simpleString()
    pieces = stage(token_pieces(docs, path, doc_id, text, sequence, separator), "pieces")
    return pack(pieces, sequence, most_open).select(
        F.col("doc_id").cast(kind).alias("doc_id"), "piece", "start", F.col("length").cast("bigint").alias("length"),
        "ids_crc32", "sequence_id", "offset")

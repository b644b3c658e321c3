"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases: each is the longest phrase seen before plus one character (its
characters are code points; what is left at the end is no new phrase). The phrases, all different,
are hashed, and the fingerprint is the least ``SIZE`` of the hashes. The share of common hashes
among the least of both texts estimates the likeness of the two phrase sets, and so how well one
text would compress with the other's dictionary.

Defined cases: a null text is an empty one and has the empty fingerprint, which is like itself
(1) and unlike any other (0); a null id comes after all others; rows of equal id are ordered by a
hash of their text; repeated rows get a row each; the only row of a table is its own next; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.memory import claim, trim

#: Hashes in a fingerprint, of 32 bits each.
SIZE = 128
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Parser:
    """A phrase dictionary as a tree, with the end of each phrase of one text."""

    def __init__(self):
        self.root: dict = {}
        self.node = self.root

    def feed(self, text: str, start: int) -> tuple[list[int], list[tuple[dict, str]]]:
        """Ends of the phrases in ``text``, whose first character stands at ``start``, and where
        each was added, so that it can be taken out again."""
        root, node = self.root, self.node
        ends, added = [], []
        for at, letter in enumerate(text, start + 1):
            following = node.get(letter)
            if following is None:
                node[letter] = {}
                added.append((node, letter))
                ends.append(at)
                node = root
            else:
                node = following
        self.node = node
        return ends, added


@lru_cache(maxsize=1)
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _FACTOR, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the factor and of its inverse, from tables up to a power of two."""
    up, down = _powers_to(max(1 << 17, 1 << n.bit_length()))
    return up[: n + 1], down[: n + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minima(text: str, ends: list[int], size: int) -> np.ndarray:
    """The least hashes of the phrases between neighbouring ends, ascending."""
    if not ends:
        return np.empty(0, dtype=np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    up, down = _powers(len(codes))
    summed = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_mixed(codes + np.uint64(1)) * up[:-1], out=summed[1:])
    last = np.array(ends)
    first = np.concatenate([[0], last[:-1]])
    phrases = (summed[last] - summed[first]) * down[first]
    hashes = np.unique((_mixed(phrases + _FACTOR) >> np.uint64(32)).astype(np.uint32))
    return hashes[:size]


def written(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of two phrase sets from their least hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:size]
    common = np.intersect1d(np.intersect1d(a, b, assume_unique=True), least, assume_unique=True)
    return len(common) / len(least)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a narrow pass."""
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("fingerprint")
        for batch in texts:
            yield pd.Series([written(minima(t or "", Parser().feed(t or "", 0)[0], size)) for t in batch], dtype=object)
        trim()

    return docs.select(F.col(doc_id).alias("doc_id"), F.pandas_udf(read, "string")(F.col(text)).alias("fingerprint"))


def edited_pair(text: str, following: str, size: int) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text (its last half replaced by the start of the next) and both fingerprints.

    The two share their first half, so that is parsed once: the phrases of the original's second
    half are taken out of the dictionary again before the edited one's is read.
    """
    half = len(text) // 2
    kept, other = text[: len(text) - half], following[:half]
    parser = Parser()
    ends, _ = parser.feed(kept, 0)
    node = parser.node
    rest, added = parser.feed(text[len(kept):], len(kept))
    for place, letter in reversed(added):
        del place[letter]
    parser.node = node
    edited = kept + other
    changed, _ = parser.feed(other, len(kept))
    return edited, minima(text, ends + rest, size), minima(edited, ends + changed, size)


def _firsts(rows: DataFrame, parts: int) -> list[tuple[int, bool, int]]:
    """Where ``parts`` ranges of about as many documents begin, ascending; as long as the shuffle is wide. Rows of
    one id are in several ranges if there are many. The order is by descending id, and by the hash of the text among
    equal ones."""
    ranged = rows.select(F.bitwise_not("key").alias("o0"), F.col("none").alias("o1"), F.col("tie").alias("o2")).repartitionByRange(parts, "o0", "o1", "o2")
    found = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("o0", "o1", "o2")).alias("first")).collect()
    return sorted(tuple(r["first"]) for r in found)


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
               parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The ids are whole numbers. Texts are dealt by ranges of descending id and hash of the text and sorted
    there, which moves each text once; the first text of every range is sent to the range before it as
    well (of the first range, to the last), so that each range sees what follows its last text. A task
    is one range and holds three texts at a time.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = F.lit(-(1 << 63))
    named = docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), least).alias("key"), F.col(doc_id).isNull().alias("none"),
        F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    firsts = _firsts(named, parts)
    begins = set(firsts)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Add ``part``; copy the first row of a range for the one before, once in a task if it is repeated."""
        claim("fingerprint")
        sent: set[int] = set()
        for batch in batches:
            order = list(zip((~batch["key"]).tolist(), batch["none"].tolist(), batch["tie"].tolist()))
            at = [bisect_right(firsts, o) - 1 for o in order]
            batch["part"] = np.array(at, dtype=np.int32)
            batch["guest"] = False
            # Compressed, as the shuffle moves and sorts every text.
            batch["text"] = [zstandard.compress(t.encode(), 3) for t in batch["text"]]
            yield batch
            keep = [o in begins and k not in sent and not sent.add(k) for o, k in zip(order, at)]
            heads = batch[keep]
            if len(heads):
                yield heads.assign(part=((heads["part"] - 1) % len(firsts)).astype(np.int32), guest=True)
        trim()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by range, in descending order of ids, and the guests of a range last."""
        claim("fingerprint")
        part, current, waiting, over = None, None, None, True

        def step(following: str) -> None:
            """``current`` gets the text after it; ``waiting``, the row before, can go out."""
            nonlocal waiting
            key, none, text = current
            edited, own, changed = edited_pair(text, following, size)
            if waiting:
                out.append((*waiting[:-1], likeness(waiting[-1], own, size)))
            waiting = (None if none else key, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own),
                       written(changed), likeness(own, changed, size), own)

        for batch in batches:
            out: list[tuple] = []
            for key, none, text, at, guest in zip(*(batch[c] for c in ("key", "none", "text", "part", "guest"))):
                if at != part:
                    part, current, waiting, over = at, None, None, False
                if over:
                    continue
                text = zstandard.decompress(text).decode()
                if current:
                    step(text)
                if guest:
                    ends, _ = Parser().feed(text, 0)
                    out.append((*waiting[:-1], likeness(waiting[-1], minima(text, ends, size), size)))
                    over = True
                current = (key, none, text)
            made = pd.DataFrame(out, columns=columns)
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made
        trim()

    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    dealt = named.mapInPandas(deal, "key bigint, none boolean, text binary, tie bigint, part int, guest boolean")
    return (
        dealt.repartitionById(max(1, len(firsts)), F.col("part")).sortWithinPartitions("part", "guest", F.desc("key"), "none", "tie")
        .mapInPandas(read, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                     "edited_fingerprint string, near_edited double, near_next double")
    )

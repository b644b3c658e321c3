"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: bit k is set if it is set in over half of the hashes of a document's
three-word shingles, repeats included. Documents link where their fingerprints differ in ``DISTANCE``
bits or fewer.

The fingerprint is cut into four segments of 16 bits. There are four tables; each leaves one segment
out and holds every different fingerprint under the 48 bits of the others. Two differing bits lie
either in one segment, and then the table without it has both under the same key, or in two, and
then the keys of the table without one of them differ by one bit in the other. So a fingerprint looks
up its own key in every table, and the Hamming ball of one bit around a segment of its key in the
tables that stand for a pair of segments: each pair of segments is looked at in one table, and a bit
is only ever set, never cleared, as the partner comes the other way. What a look-up finds is
verified by the complete distance. A key has at most 65,536 different fingerprints whatever the data,
and near copies that fill it would have to differ in one segment only, so no group is hot and no
pairs within a group are listed; equal fingerprints are one entry.

Defined cases: words are separated by space and tab to carriage return, ASCII letters lose their case;
a text of one or two words has one shingle, the whole sequence; null and empty texts have fingerprint
zero, which links like any other; a null id is never the least of a component unless all are null;
repeated rows are a row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.components import connected
from loglens.llm.memory import claim, trim
from loglens.operators.joins import hot_keys, spread_join
from loglens.session import stage

WIDTH, SEED, DISTANCE = 3, 42, 2
#: Segments, and for each table (by the segment it leaves out) those around which it is looked up.
SEGMENT, BALLS = 16, {0: (1, 2), 1: (2, 3), 2: (3,), 3: (0,)}
#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 15


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text, as an unsigned number."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII case and white space only
    if not words:
        return 0
    whole, width = b" ".join(words), min(WIDTH, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    set_in, hashed = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _AT_ONCE):
        some = slice(at, at + _AT_ONCE)
        hashes = np.array([hashed(whole[a:b], SEED) for a, b in zip(starts[some], ends[some])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text, as a signed number; a narrow pass."""
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("simhash")
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))
        trim()

    return docs.select(F.col(doc_id).alias("doc_id"), F.pandas_udf(read, "bigint")(F.col(text)).alias("fingerprint"))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _look_ups() -> list[tuple[int, int, int]]:
    """(table, bits of its key, bit to set in the key): zero for the key itself."""
    out = []
    for left_out, around in BALLS.items():
        held = ~(0xFFFF << SEGMENT * left_out) & (1 << 64) - 1
        out.append((left_out, _signed(held), 0))
        out += [(left_out, _signed(held), _signed(1 << SEGMENT * s + k)) for s in around for k in range(SEGMENT)]
    return out


def links(different: DataFrame, column: str = "fingerprint") -> DataFrame:
    """(a, b): every pair of different fingerprints at ``DISTANCE`` bits or fewer, once or twice."""
    def rows(steps: list[tuple[int, int, int]]) -> DataFrame:
        said = F.array(*[F.struct(*[F.lit(x).cast(kind).alias(name) for x, kind, name in zip(
            step, ("tinyint", "bigint", "bigint"), ("part", "held", "bit"))]) for step in steps])
        return different.select(F.col(column).alias("f"), F.explode(said).alias("step")).where(
            F.col("f").bitwiseAND(F.col("step.bit")) == 0).select(
            "f", "step.part", F.col("f").bitwiseAND(F.col("step.held")).bitwiseOR(F.col("step.bit")).alias("key"),
            (F.col("step.bit") == 0).alias("own"))

    steps = _look_ups()
    table = rows([s for s in steps if not s[2]]).select("part", "key", F.col("f").alias("b"))
    met = rows(steps).withColumnRenamed("f", "a").join(table, ["part", "key"])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return met.where(near & (~F.col("own") | (F.col("a") < F.col("b")))).select("a", "b")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document; the fingerprint as 16 hex digits."""
    signed = stage(fingerprints(docs, doc_id, text), "fingerprints")
    different = stage(
        signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "different")
    found = connected(links(different)).select(F.col("point").alias("fingerprint"), "root")
    rooted = stage(different.join(found, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    named = spread_join(rooted.select("fingerprint", "root"), least.select("root", "component_id"), ["root"],
                        by="fingerprint", hot=hot_keys(least, ["root"], "members"))
    placed = spread_join(signed, named.select("fingerprint", "component_id"), ["fingerprint"], by="doc_id",
                         hot=hot_keys(different, ["fingerprint"], "copies"))
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")

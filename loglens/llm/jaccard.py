"""Exact Jaccard join on word shingles with adaptive multi-match prefixes.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
With a set of ``n`` shingles in any fixed order, two linked documents share at least ``m`` of their
first ``n - ceil(0.8 n) + m`` shingles, for every ``m``. So a longer prefix asks for more common
shingles. The join uses this three times; no step drops a link:

1. *Screen.* In order of their hashes, the first 30 % of each set are counted over all documents.
   A document stays if enough of them occur in another text; most have no near copy and end here.
2. *Prefixes.* All shingles of the remaining sets are counted. A document that shares fewer than
   80 % of its own with the others has no partner. Each other one orders its shingles by count,
   rare first, and lengthens its prefix as long as that lowers the estimated cost of its candidates
   (pairs that the prefix's counts let expect, and verifications among those with ``m`` matches).
3. *Candidates.* Per shingle and size class every document is first held against one leader only.
   There the lower of both levels says how many shingles must match. Then only documents that are
   in different components meet, where all but the largest component of a shingle are compared
   with everything, on the prefix that the two sizes leave; what meets has to match as often in its
   prefixes as the lower level says before whole sets are compared. Pairs inside a component
   are never listed: they can't change it.

Equal sets are handled once. Every candidate is verified on its whole sets. Sets hold 64-bit hashes.

Defined cases: words are separated by space and tab to carriage return, ASCII letters lose their
case; a text of one to four words has one shingle, the whole sequence; null and empty texts have none
and link with nothing; documents of equal sets link; a null id is never the least of a component
unless all are null; repeated rows are a row each; other columns are ignored by ``components`` and
kept by ``one_of_each``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.components import connected
from loglens.llm.memory import claim, trim
from loglens.operators.joins import hot_keys, spread_join
from loglens.session import stage

WIDTH = 5
#: Links ask for ``PART`` hundredths.
PART = 80
#: The screen's level is 1 + n // SCREEN; a partner's set may be a fifth smaller, hence its demand.
SCREEN = 10
#: Bits of the filter that spares sets without a chance the shuffle: for each key, and at most (32 MB). What it
#: lets through is joined.
FILTER_SHARE, FILTER_BITS = 16, 1 << 28
#: Texts whose screen prefixes are read together, at most, and their characters; shingles of sets that are counted together.
TOGETHER, TOGETHER_CHARS, TOGETHER_SHINGLES = 2000, 4_000_000, 500_000
#: Counts of a shingle stop here: more frequent ones are ordered by their hash.
HOT = 256
#: Prefix levels that are weighed against each other.
LEVELS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128]
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text, ascending."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII case and white space only
    n = len(words)
    if n < WIDTH:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), n)
        return np.array([whole] if n else [], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    found = each[: n - WIDTH + 1]
    for k in range(1, WIDTH):
        found = found * _FACTOR ^ each[k : n - WIDTH + 1 + k]
    return np.unique(_mixed(found))


def least_common(n):
    """Fewest common shingles of a linked document with a set of ``n``."""
    return -(-PART * n // 100)


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tie, key, x, n): a hash of the text, the identity of its set (null if empty), a
    short form of it and its size."""
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("jaccard")
        for batch in texts:
            rows = []
            for value in batch:
                s = shingles(value)
                key = set_key(s) if len(s) else None
                rows.append((key, _short(key) if key else 0, len(s)))
            yield pd.DataFrame(rows, columns=["key", "x", "n"])
        trim()

    said = F.pandas_udf(read, "key binary, x bigint, n bigint")(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tie"), said.alias("s")).select(
        "doc_id", "tie", "s.*")


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and their lengths."""
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
    return starts, np.diff(np.append(starts, len(h)))


def _flat(sets: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, owner, place among the owners of the shingle), ordered by shingle and owner."""
    h = np.concatenate(list(sets.values()))
    x = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(s) for s in sets.values()])
    order = np.lexsort((x, h))
    h, x = h[order], x[order]
    starts, sizes = _runs(h)
    return h, x, np.arange(len(h)) - np.repeat(starts, sizes)


def _slices(weights: list[int], rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of at most ``rows`` that weigh ``most`` or less, or are one row."""
    a = held = 0
    for b, weight in enumerate(weights):
        if b > a and (b - a == rows or held + weight > most):
            yield a, b
            a, held = b, 0
        held += weight
    if a < len(weights):
        yield a, len(weights)


def _texts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[str | None]]:
    """The first column, so many rows and characters at a time: what is made of them is much larger."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(0)), 0).to_pylist()
        for a, b in _slices(sizes, rows, TOGETHER_CHARS):
            yield batch.column(0).slice(a, b - a).to_pylist()


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns.values()], list(columns))


def _by_shingle(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows of one partition, ordered by ``h``, as (h, x, credit, seen) with whole runs of equal
    ``h``. A run longer than ``most`` comes in parts, each behind the first ``most`` rows of the run
    once more: ``seen`` counts these. So a task never holds more than that between batches."""
    held, seen = None, 0
    for batch in batches:
        now = [batch[c].to_numpy() for c in ("h", "x", "credit")]
        if held is not None:
            now = [np.concatenate(pair) for pair in zip(held, now)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if len(now[0]) - cut > 2 * most:
            yield *now, seen
            held, seen = [c[cut : cut + most] for c in now], most
        else:
            held = [c[cut:] for c in now]
            if cut:
                yield *[c[:cut] for c in now], seen
                seen = 0
    if held is not None:
        yield *held, seen


def _screen_credits(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(x, credit): how many shingles of its screen prefix a text has in common with others.

    Among texts read together equal sets count once, and a shingle of several texts is sent for two of them
    only; what the others have in such shingles is added up and sent as credit, so no shingle is
    hot. Credit may be counted again at the borders of batches, never too low.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for texts in _texts(batches, TOGETHER):
            prefixes: dict[int, np.ndarray] = {}
            for value in texts:
                s = shingles(value)
                if len(s):
                    prefixes[_short(set_key(s))] = s.view(np.int64)[: len(s) - least_common(len(s)) + 1 + len(s) // SCREEN]
            if not prefixes:
                continue
            h, x, place = _flat(prefixes)
            sent = place < 2
            yield _rows(h=h[sent], x=x[sent], credit=np.zeros(sent.sum(), dtype=np.int64))
            met, times = np.unique(x[~sent], return_counts=True)
            yield _rows(h=met, x=met, credit=times)
        trim()

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("jaccard")
        for h, x, credit, _ in _by_shingle(batches, 2):
            given = credit > 0
            h2, x2 = h[~given], x[~given]
            starts, sizes = _runs(h2)
            several = np.repeat(x2[starts + sizes - 1] != x2[starts], sizes)
            several &= np.concatenate([[True], (h2[1:] != h2[:-1]) | (x2[1:] != x2[:-1])]) if len(h2) else True
            found, times = np.unique(x2[several], return_counts=True)
            yield pd.DataFrame({"x": np.concatenate([found, x[given]]), "credit": np.concatenate([times, credit[given]])})
        trim()

    rows = docs.select(F.col(text).alias("text")).mapInArrow(read, "h bigint, x bigint, credit bigint")
    met = rows.repartition(width, "h").sortWithinPartitions("h", "x").mapInPandas(detect, "x bigint, credit bigint")
    return met.groupBy("x").agg(F.sum("credit").alias("credit"))


class Filter:
    """A Bloom filter of random 64-bit keys, as large as their number asks for up to ``FILTER_BITS`` bits. It is
    made in pieces by the tasks; the driver puts the pieces together."""

    _SHIFTS, _PIECE = (0, 18, 36), 1 << 17

    def __init__(self, keys: DataFrame, column: str):
        wanted = max(self._PIECE, FILTER_SHARE * keys.count())
        self.bits = min(FILTER_BITS, 1 << (wanted - 1).bit_length())
        size = self._PIECE

        def fill(rows: pd.DataFrame) -> pd.DataFrame:
            held = np.zeros(size, dtype=np.uint8)
            held[rows["bit"].to_numpy()] = 1
            return pd.DataFrame({"piece": rows["piece"].iloc[:1], "held": [np.packbits(held, bitorder="little").tobytes()]})

        places = [F.shiftrightunsigned(column, k).bitwiseAND(F.lit(self.bits - 1)) for k in self._SHIFTS]
        bits = keys.select(F.explode(F.array(*places)).alias("bit")).select(
            F.shiftright("bit", size.bit_length() - 1).alias("piece"), F.col("bit").bitwiseAND(F.lit(size - 1)).alias("bit")).distinct()
        held = np.zeros(self.bits // 8, dtype=np.uint8)
        for r in bits.groupBy("piece").applyInPandas(fill, "piece bigint, held binary").collect():
            at = r["piece"] * size // 8
            held[at : at + size // 8] = np.frombuffer(r["held"], dtype=np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(held.view("<u4"))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        held, keys = self.sent.value, keys.view(np.uint64)
        out = np.ones(len(keys), dtype=bool)
        for shift in self._SHIFTS:
            bit = (keys >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (held[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & 1 == 1
        return out

    def column(self, key: Column) -> Column:
        return F.pandas_udf(lambda keys: pd.Series(self.may_hold(keys.to_numpy(dtype=np.int64))), "boolean")(key)


def _candidate_sets(docs: DataFrame, signed: DataFrame, text: str, width: int) -> DataFrame:
    """(v, key, n, items): the sets that pass the screen, each once, numbered. ``signed`` has each set once."""
    credits = _screen_credits(docs, text, width)
    sizes = signed.select("x", "key", "n")
    need = 1 + F.floor(F.col("n") * PART / (100 * SCREEN))
    passed = stage(sizes.join(credits, "x").where(F.col("credit") >= need).select("x", "key", "n"), "passed")
    chance = Filter(passed, "x")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for texts in _texts(batches, TOGETHER // 4):
            found: dict[bytes, np.ndarray] = {}
            for value in texts:
                s = shingles(value)
                key = set_key(s) if len(s) else None
                if key and key not in found and chance.may_hold(np.array([_short(key)]))[0]:
                    found[key] = s.view(np.int64)
            ends = np.cumsum([0, *map(len, found.values())], dtype=np.int32)
            flat = np.concatenate([*found.values(), np.empty(0, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), type=pa.binary()), pa.ListArray.from_arrays(ends, pa.array(flat))], ["key", "items"])
        trim()

    every = docs.select(F.col(text).alias("text")).mapInArrow(read, "key binary, items array<bigint>")
    chosen = every.join(passed.select("key", "n"), "key").dropDuplicates(["key"])
    return stage(chosen.select(F.monotonically_increasing_id().alias("v"), "key", "n", "items"), "sets")


def _counted(sets: DataFrame, width: int) -> DataFrame:
    """(v, h, df) for every shingle that several sets have; counts stop at ``HOT``.

    Where ``HOT`` sets read together have a shingle its count is settled: that many are sent for
    it, and the others go straight to the result.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(1)).to_pylist()
            for a, b in _slices(sizes, TOGETHER // 4, TOGETHER_SHINGLES):
                v, items = (c.slice(a, b - a) for c in batch.columns)
                h, x, place = _flat({k: one.values.to_numpy() for k, one in zip(v.to_pylist(), items)})
                settled = place >= HOT
                yield _rows(deal=np.where(settled, x, h), h=h, x=x, credit=np.where(settled, HOT, 0))
        trim()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("jaccard")
        for h, x, credit, seen in _by_shingle(batches, HOT):
            _, sizes = _runs(h)
            df = np.maximum(np.minimum(np.repeat(sizes, sizes), HOT), credit)
            yield pd.DataFrame({"v": x, "h": h, "df": df})[(df > 1) & (np.arange(len(h)) >= seen)]
        trim()

    rows = sets.select("v", "items").mapInArrow(read, "deal bigint, h bigint, x bigint, credit bigint")
    return rows.repartition(width, "deal").drop("deal").sortWithinPartitions("h", "x").mapInPandas(
        count, "v bigint, h bigint, df bigint")


def choose_level(n: int, counts: np.ndarray) -> tuple[int, int]:
    """(level, common shingles in its prefix) for a set of ``n`` with these counts of its shingles
    that others have, ascending; (0, 0) if it can't have a partner.

    A prefix of level m is n - ceil(0.8 n) + m long, the shingles without another owner first. Its
    cost is the pairs that its counts make, and the verification of those that match m times.
    """
    alone, over = n - len(counts), n - least_common(n)
    if len(counts) < least_common(n) or over + 1 <= alone:
        return 0, 0
    pairs = np.cumsum(counts - 1.0)
    best = None
    for level in LEVELS:
        held = over + level - alone
        if held > len(counts):
            break
        if held < level:
            return 0, 0
        cost = pairs[held - 1] * (1 + n / (8 * level))
        if best is None or cost < best[0]:
            best = (cost, level, held)
    return best[1:]


def _prefixes(sets: DataFrame, counted: DataFrame, width: int) -> DataFrame:
    """(h, v, n, common, place, least, level): the prefix of every set at its level; ``common`` counts
    the shingles that other sets have, ``place`` is that of this one in the set's order, from 0, and
    ``least`` the first level whose prefix has it."""
    sizes = sets.select("v", F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("df"), "n")
    rows = counted.withColumn("n", F.lit(0).cast("bigint")).unionByName(sizes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a set come together, its size first and then its shingles, rare first."""
        claim("jaccard")
        held = None
        for batch in batches:
            now = [batch[c].to_numpy() for c in ("v", "h", "df", "n")]
            if held is not None:
                now = [np.concatenate(pair) for pair in zip(held, now)]
            at = int(np.searchsorted(now[0], now[0][-1]))
            held = [c[at:] for c in now]
            if at:
                yield chosen(*[c[:at] for c in now])
        if held is not None:
            yield chosen(*held)
        trim()

    def chosen(v: np.ndarray, h: np.ndarray, df: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        starts, _ = _runs(v)
        out = []
        for a, b in zip(starts, [*starts[1:], len(v)]):
            size = int(n[a])
            level, taken = choose_level(size, df[a + 1 : b])
            if level:
                alone = size - (b - a - 1)
                first = np.maximum(1, np.arange(taken) + alone - (size - least_common(size)) + 1)
                out.append(pd.DataFrame({"h": h[a + 1 : a + 1 + taken], "v": v[a], "n": size, "common": b - a - 1,
                                         "place": np.arange(taken) + alone, "least": first, "level": level}))
        columns = ["h", "v", "n", "common", "place", "least", "level"]
        return pd.concat(out) if out else pd.DataFrame(columns=columns, dtype="int64")

    return rows.repartition(width, "v").sortWithinPartitions("v", F.col("n") == 0, "df", "h").mapInPandas(
        cut, "h bigint, v bigint, n bigint, common bigint, place bigint, least bigint, level bigint")


def _matching(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs that match often enough for the lower of their levels. Rows are (a, b, level,
    least), one for each common shingle."""
    return pairs.where("least <= level").groupBy("a", "b", "level").agg(F.count(F.lit(1)).alias("times")).where(
        "times >= level").select("a", "b")


def _matching_prefixes(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(a, b) of pairs whose prefixes match often enough for the lower of their levels. A pair carries its prefixes."""
    tokens = stage(prefixes.groupBy("v").agg(
        F.max("level").alias("level"), F.collect_list(F.struct("h", "least")).alias("tokens")), "prefix_tokens")
    both = pairs.select("a", "b")
    for end in ("a", "b"):
        both = both.join(tokens.select(F.col("v").alias(end), F.col("level").alias(f"level_{end}"), F.col("tokens").alias(f"tokens_{end}")), end)
    level = F.least("level_a", "level_b")
    held = [F.transform(F.filter(f"tokens_{end}", lambda t: t["least"] <= level), lambda t: t["h"]) for end in ("a", "b")]
    return both.where(F.size(F.array_intersect(*held)) >= level).select("a", "b")


def _may_link(n: str, common: str, other_n: str, other_common: str) -> Column:
    """Whether the sets can share enough: all that either shares with anyone, at most."""
    return (100 + PART) * F.least(common, other_common) >= PART * (F.col(n) + F.col(other_n))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) by whole sets. Each pair carries one of its sets to the other."""
    items = sets.select("v", "items")
    one = pairs.join(items.select(F.col("v").alias("b"), F.col("items").alias("items_b")), "b")
    two = one.join(items.select(F.col("v").alias("a"), F.col("items").alias("items_a")), "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return two.select("a", "b", (100 * common >= PART * (F.size("items_a") + F.size("items_b") - common)).alias("linked"))


def links(sets: DataFrame, width: int) -> DataFrame:
    """(a, b): enough links between the sets to connect all that are linked, each verified."""
    prefixes = stage(_prefixes(sets, _counted(sets, width), width), "prefixes")
    # A leader for each shingle and size class: the set with the least share of shingles of its own,
    # which of a text and its edited copies is the text. Sizes that may link are in one class or in
    # neighbours; across classes the second round looks.
    classed = prefixes.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PART)))
    share = (1 - F.col("common") / F.col("n")).alias("share")
    led = classed.groupBy("h", "size").agg(F.min(F.struct(share, "v", "n", "common", "least", "level")).alias("first"))
    by_leader = classed.join(led, ["h", "size"]).where(
        (F.col("v") != F.col("first.v")) & _may_link("n", "common", "first.n", "first.common"))
    first = _matching(by_leader.select(
        F.least("v", "first.v").alias("a"), F.greatest("v", "first.v").alias("b"),
        F.least("level", "first.level").alias("level"), F.greatest("least", "first.least").alias("least")))
    tried = stage(_verified(first, sets), "tried")
    placed = connected(tried.where("linked").select("a", "b"))
    roots = prefixes.join(placed.select(F.col("point").alias("v"), "root"), "v", "left").withColumn(
        "root", F.coalesce("root", "v"))
    rooted = stage(roots, "rooted")
    # The largest component of each shingle; shingles of one component are done.
    parts = rooted.groupBy("h", "root").agg(F.count(F.lit(1)).alias("times"))
    largest = parts.groupBy("h").agg(
        F.max_by("root", F.struct("times", "root")).alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    open_ = rooted.join(largest, "h")
    few = open_.where("root <> largest").select(
        "h", *[F.col(c).alias(f"{c}_b") for c in ("v", "n", "common", "place", "root")])
    # At the first shingle that two sets have in common, both must have enough left from there on. So
    # each linked pair meets on a prefix that is as short as its two sizes allow.
    left = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    met = open_.join(few, "h").where(
        (F.col("root") != F.col("root_b")) & ((F.col("root") == F.col("largest")) | (F.col("v") < F.col("v_b"))) & _may_link("n", "common", "n_b", "common_b")
        & ((100 + PART) * left >= PART * (F.col("n") + F.col("n_b"))))
    second = met.select(F.least("v", "v_b").alias("a"), F.greatest("v", "v_b").alias("b")).distinct()
    again = _matching_prefixes(second.join(tried.select("a", "b"), ["a", "b"], "left_anti"), prefixes)
    return stage(tried.where("linked").select("a", "b").unionByName(
        _verified(again, sets).where("linked").select("a", "b")), "links")


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tie, n, label): equal labels in a component; null for empty sets. A written table."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = stage(signatures(docs, doc_id, text), "signatures")
    different = stage(signed.where("n > 0").groupBy("x", "key", "n").agg(F.count(F.lit(1)).alias("copies")), "different")
    sets = _candidate_sets(docs, different, text, width)
    found = connected(links(sets, width))
    names = sets.select("v", "key")
    counts = found.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    labels = names.select(F.col("v").alias("root"), F.col("key").alias("label"))
    roots = spread_join(found.join(names.select(F.col("v").alias("point"), "key"), "point"), labels, ["root"], by="point",
                        hot=hot_keys(counts, ["root"], "n")).select("key", "label")
    copied = hot_keys(different.select("key", "copies"), ["key"], "copies")
    return stage(spread_join(signed, roots, ["key"], by="doc_id", how="left", hot=copied).select(
        "doc_id", "tie", "n", F.coalesce("label", "key").alias("label")), "labelled")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    rows = _labelled(docs, doc_id, text)
    least = stage(rows.where("label IS NOT NULL").groupBy("label").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "least")
    named = spread_join(rows, least.select("label", "least"), ["label"], by="doc_id", how="left", hot=hot_keys(least, ["label"], "rows"))
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every component: the least id, by a hash of the text among equal
    ids. Only rows that may be of a component of several are moved."""
    rows = _labelled(docs, doc_id, text).where("label IS NOT NULL")
    groups = stage(rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "tie")).alias("kept")).where("rows > 1"), "groups")
    crowded = stage(spread_join(rows, groups.drop("rows"), ["label"], by="doc_id", hot=hot_keys(groups, ["label"], "rows")).select(
        F.xxhash64("doc_id", "tie").alias("row"),
        (F.col("kept.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("kept.tie") == F.col("tie"))).alias("stays")).distinct(), "crowded")
    chance = Filter(crowded, "row")
    # A document's own columns stay in a struct, so they can have any name.
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col(doc_id), F.xxhash64(text)).alias("row"))
    keyed = keyed.withColumn("met", chance.column(F.col("row")))
    met = keyed.where("met").join(crowded, "row", "left")
    # Rows of a component of several that stay are alike in id and text if there is more than one.
    single = met.where("stays IS NULL").select("doc.*")
    first = met.where("stays").dropDuplicates(["row"]).select("doc.*")
    return keyed.where("NOT met").select("doc.*").unionByName(single).unionByName(first)

"""Search that leaves out files: a trigram filter for each file of a table.

A search for a text or a regular expression needs certain trigrams (three ASCII characters in a row, without
case) to be in a line. The index holds a bitmap of hashed trigrams for each file; files that lack one that is
needed are not read, and what is read goes through the plain predicate, so the rows are those of a scan.
Files that are newer than the index are always read, and so is everything where no trigram is needed: needles
under three characters, and patterns of which nothing certain can be said.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.operators import filters
from loglens.session import stage
from loglens.sources import commits
from loglens.sources.tables import read_table, write_table

#: Bits of a file's map, and characters whose trigrams are taken together.
BITS, TOGETHER = 1 << 18, 1 << 20
#: Characters that match an ASCII letter without case although their lower case is another one.
_ODD = {"ſ": "s", "K": "k", "ı": "i", "İ": "i"}


def _plain(text: Column) -> Column:
    return F.lower(F.translate(text, "".join(_ODD), "".join(_ODD.values())))


def _codes(text: bytes) -> np.ndarray:
    """The different trigrams of a text, as numbers; none with a zero or a byte that isn't ASCII."""
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.uint32)
    good = (b > 0) & (b < 128)
    codes = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return np.unique(codes[good[:-2] & good[1:-1] & good[2:]])


def _places(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - (BITS.bit_length() - 1))


# --- what a search needs: a trigram's code, ("and", parts), ("or", parts), or None for nothing ---


def _both(parts: list, kind: str):
    parts = [p for p in parts if p is not None] if kind == "and" else parts
    if not parts or any(p is None for p in parts):
        return None
    return parts[0] if len(parts) == 1 else (kind, parts)


def _of_literal(text: str):
    return _both([int(c) for c in _codes(text.lower().encode())], "and")


def needed_by_substring(needle: str | None):
    """``%`` and ``_`` are wildcards."""
    pieces = re_split(needle or "")
    return _both([_of_literal(p) for p in pieces], "and")


def re_split(needle: str) -> list[str]:
    """Literal runs of ASCII characters."""
    out = [""]
    for c in needle:
        if c in "%_" or not 0 < ord(c) < 128:
            out.append("")
        else:
            out[-1] += c
    return out


def needed_by_regex(pattern: str | None):
    """What every match of a pattern needs. Nothing is said of syntax that the two languages read differently."""
    pattern = pattern or ""
    if any(odd in pattern for odd in ("&&", "\\0", "\\Q", "\\p", "\\P", "(?x", "(?ix")) or _nested_class(pattern):
        return None
    try:
        return _needed(parser.parse(pattern))
    except Exception:  # what this parser can't read is not judged
        return None


def _nested_class(pattern: str) -> bool:
    inside, at = False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[" and inside:
            return True
        elif c == "[":
            inside = True
            if pattern[at + 1 : at + 2] == "^":
                at += 1
            if pattern[at + 1 : at + 2] == "]":
                return True  # a first bracket is a member here and an error there
        elif c == "]":
            inside = False
        at += 1
    return False


def _needed(sequence):
    parts, run = [], ""

    def close() -> None:
        nonlocal run
        parts.append(_of_literal(run))
        run = ""

    def walk(items) -> None:
        nonlocal run
        for kind, value in items:
            if kind is op.LITERAL and 0 < value < 128:
                run += chr(value)
            elif kind is op.SUBPATTERN:
                # Flags that a group switches don't matter: what is needed is without case anyway.
                walk(value[3])
            elif kind is op.AT:
                continue
            else:
                close()
                if kind is op.BRANCH:
                    parts.append(_both([_needed(b) for b in value[1]], "or"))
                elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
                    parts.append(_needed(value[2]))
                elif kind is op.ATOMIC_GROUP:
                    parts.append(_needed(value))

    walk(sequence)
    close()
    return _both(parts, "and")


def holds(need, bits: np.ndarray) -> bool:
    """Whether a bitmap may have what is needed."""
    if need is None:
        return True
    if isinstance(need, int):
        place = int(_places(np.array([need], dtype=np.uint32))[0])
        return bool(bits[place >> 3] >> (place & 7) & 1)
    kind, parts = need
    return (all if kind == "and" else any)(holds(p, bits) for p in parts)


# --- index and search -------------------------------------------------------------------------


def build(table: DataFrame, column: str = "content") -> DataFrame:
    """(file, bits): the trigrams of every file of a table that is read from files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now]), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["file", "bits"])

        for batch in batches:
            files, texts = [unquote(f) for f in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            a = size = 0
            for b in range(len(files) + 1):
                if b < len(files) and files[b] == files[a] and size < TOGETHER:
                    size += len(texts[b] or "")
                    continue
                if b == a:
                    break
                if files[a] != now:
                    if now is not None:
                        yield done()
                    now, held = files[a], np.zeros(BITS, dtype=np.uint8)
                held[_places(_codes("\0".join(t or "" for t in texts[a:b]).encode()))] = 1
                a, size = b, len(texts[b] or "") if b < len(files) else 0
        if now is not None:
            yield done()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in part["bits"]], axis=0)
        return pd.DataFrame({"file": part["file"].iloc[:1], "bits": [bits.tobytes()]})

    rows = table.select(F.col("_metadata.file_path").alias("file"), _plain(F.col(column)).alias("text"))
    return rows.mapInArrow(read, "file string, bits binary").groupBy("file").applyInPandas(merge, "file string, bits binary")


@dataclass(frozen=True)
class Index:
    """The index of a Parquet table, kept beside it."""

    spark: SparkSession
    table: str
    path: str
    column: str = "content"

    def refresh(self) -> int:
        """Add the files that the index doesn't have, drop those that are gone; how many were read."""
        known = read_table(self.spark, self.path) if commits.current(self.spark, self.path) else None
        now = self._files()
        held = {r["file"] for r in known.select("file").collect()} if known is not None else set()
        new = sorted(set(now) - held)
        if known is not None and not new and held <= set(now):
            return 0
        whole = None
        if new:
            listed = self.spark.createDataFrame([(f,) for f in new], "file string")
            made = build(self.spark.read.schema(read_table(self.spark, self.table).schema).parquet(*new), self.column)
            # A file without rows has no trigrams.
            whole = listed.join(made, "file", "left").select("file", F.coalesce("bits", F.lit(bytearray(BITS // 8))).alias("bits"))
        if known is not None:
            kept = known.join(self.spark.createDataFrame([(f,) for f in now], "file string"), "file", "left_semi")
            whole = kept if whole is None else kept.unionByName(whole)
        if whole is not None:
            write_table(stage(whole, "search_index"), self.path)
        return len(new)

    def _files(self) -> list[str]:
        place = commits.current(self.spark, self.table)
        return [name for name, _, _ in commits.listing(self.spark, place)] if place else []

    def files(self, need) -> list[str]:
        """Files that may hold what is needed. As long as the table's list of files."""
        now = self._files()
        if need is None or not commits.current(self.spark, self.path):
            return now
        judge = F.pandas_udf(lambda bits: pd.Series([holds(need, np.frombuffer(b, dtype=np.uint8)) for b in bits], dtype=bool), "boolean")
        lacking = {r["file"] for r in read_table(self.spark, self.path).where(~judge(F.col("bits"))).select("file").collect()}
        return [f for f in now if f not in lacking]

    def _search(self, need, predicate: Column | None) -> DataFrame:
        schema = read_table(self.spark, self.table).schema
        files = self.files(need)
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        return rows if predicate is None else rows.where(predicate)

    def substring(self, needle: str | None) -> DataFrame:
        """The rows of ``filters.search_substring``."""
        return self._search(needed_by_substring(needle), filters.search_substring(needle, self.column))

    def regex(self, pattern: str | None) -> DataFrame:
        """The rows of ``filters.search_regex``."""
        return self._search(needed_by_regex(pattern), filters.search_regex(pattern, self.column))


"""Message templates: the masking rule, and mining by token similarity.

Mining works on distinct masked patterns, numbered by first appearance. Patterns meet in a *leaf* (token
count and first token). A leaf is mined in *parts* of consecutive patterns, each by itself: a
pattern joins the template with most equal tokens, or founds one. A part's templates are a summary that
merges: their tokens by place, where different ones become a wildcard. The founders of all parts of a leaf
are then merged in order of appearance by the same rule, founders of one part never with each
other, and the members follow their founder. So a leaf of one part is mined as one stream, a larger
one by several tasks, and what a line adds never changes how earlier lines were merged.

That makes the result extensible. ``Mined`` holds the known patterns, the templates, and the state of the
part that is still open; ``extend`` mines the patterns that are new and gives what mining the old and the
new lines together would give, without reading the old lines.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.functions import text
from loglens.operators.celltree import record
from loglens.operators.joins import hot_keys, spread_join
from loglens.operators.ranking import dense_ids
from loglens.session import python_width, stage
from loglens.sources import commits
from loglens.sources.tables import read_table, require

# Miner parameters.
SIMILARITY = 0.3
MAX_CHILDREN = 100
WILDCARD = "<*>"
#: Patterns of a part; the parts of a leaf are mined in parallel.
PART = 1 << 16


def mask_templates(lines: DataFrame) -> DataFrame:
    """Add ``template`` (digit-bearing tokens masked) and ``event_id`` (its rank from 1)."""
    masked = lines.withColumn("template", text.mask_digits(F.col("content")))
    ids = dense_ids(masked, "template", "event_id", start=1)
    hot = hot_keys(ids, ["template"], "n")
    return spread_join(masked, ids.drop("n"), ["template"], by="line_id", hot=hot)


def _digest(pattern: str) -> Column:
    """Patterns are told apart by SHA-256, so their texts only move to be mined."""
    return F.unhex(F.sha2(F.col(pattern), 256)).alias("digest")


def _pattern() -> Column:
    """Null contents are empty ones."""
    return text.mask_digits(text.squeeze(text.strip(F.coalesce("content", F.lit("")))))


@dataclass(frozen=True)
class Mined:
    """Templates of a log, and what it takes to go on with its next lines."""

    #: (digest, line): every known pattern and the first line of its template.
    patterns: DataFrame
    #: (width, head, first_line): first tokens that have a leaf of their own.
    heads: DataFrame
    #: (leaf, part, founder, line, tokens): templates of the part that is open.
    open: DataFrame
    #: (leaf, line, tokens, last_part, template): templates as founders left them, and in their final form.
    templates: DataFrame

    SCHEMAS = {
        "patterns": "digest binary, line bigint", "heads": "width int, head string, first_line bigint",
        "open": "leaf string, part bigint, founder bigint, line bigint, tokens string",
        "templates": "leaf string, line bigint, tokens string, last_part bigint, template string"}

    @classmethod
    def nothing(cls, spark: SparkSession) -> Mined:
        return cls(*[spark.createDataFrame([], cls.SCHEMAS[f.name]) for f in fields(cls)])

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Mined:
        place = commits.current(spark, require(spark, path, "template mining"))
        return cls(*[read_table(spark, f"{place}/{f.name}") for f in fields(cls)])

    def save(self, path: str) -> None:
        """A new version of all tables, which appear together."""
        def write(place: str) -> None:
            for f in fields(self):
                getattr(self, f.name).write.parquet(f"{place}/{f.name}")

        commits.publish(self.templates.sparkSession, path, write)

    def event_ids(self) -> DataFrame:
        """(line, event_id, template): ids count from 1 by first appearance, so they stay as the log grows."""
        ids = dense_ids(self.templates.select("line"), "line", "event_id", start=1).drop("n")
        return ids.join(self.templates.select("line", "template"), "line")


def _heads(patterns: DataFrame, known: DataFrame, max_children: int) -> DataFrame:
    """First tokens with a leaf of their own: the first ``max_children`` of a token count, less the wildcard's."""
    seen = patterns.where(F.col("head") != WILDCARD).select("width", "head", "first_line").unionByName(known)
    order = F.row_number().over(Window.partitionBy("width").orderBy("first_line"))
    return seen.groupBy("width", "head").agg(F.min("first_line").alias("first_line")).withColumn("place", order).where(
        F.col("place") < max_children).drop("place")


def _leaves(patterns: DataFrame, heads: DataFrame) -> DataFrame:
    """Add ``leaf``: the token count and the first token, if that has a leaf of its own, else a wildcard."""
    own = heads.select("width", "head", F.lit(True).alias("own"))
    keyed = spread_join(patterns, own, ["width", "head"], by="first_line", how="left")
    head = F.when(F.col("own"), F.col("head")).otherwise(F.lit(WILDCARD))
    return keyed.withColumn("leaf", F.concat_ws(" ", F.col("width").cast("string"), head)).drop("own", "width", "head")


def merge_tokens(a: list[str], b: list[str]) -> list[str]:
    return [x if x == y else WILDCARD for x, y in zip(a, b)]


#: Rows of one leaf that are searched together, pairs and tokens that are compared at once.
_PIECE, _AT_ONCE = 1024, 1 << 21


def _least(similarity: float, width: np.ndarray | int) -> np.ndarray:
    """Equal tokens that a template of so many must have."""
    return np.ceil(similarity * np.asarray(width) - 1e-12).astype(np.int64)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The tokens of all texts as numbers, where each text ends in them, and the tokens that the numbers stand for."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = lists.flatten().dictionary_encode()
    ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))]
    return coded.indices.to_numpy().astype(np.int64), ends, coded.dictionary


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of about ``_AT_ONCE`` in all, or of one element."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _AT_ONCE, "right")))
        yield slice(start, end)
        start = end


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _alike(texts: list[str], piece: np.ndarray, part: np.ndarray | None, similarity: float) -> dict[int, list[int]]:
    """For each text the earlier ones of its ``piece`` with enough equal tokens, less those of its ``part``.

    All pieces are searched at once. Most tokens of prose are in one text only, so texts with too few shared ones are left
    out first. Two texts with enough equal tokens share one of those that each has besides its most common ones."""
    code, ends, words = _tokens(texts)
    n, width = len(texts), np.diff(ends)
    least, row = _least(similarity, width), np.repeat(np.arange(len(texts)), width)
    wild = words.index(WILDCARD).as_py()
    place = np.arange(len(code)) - np.repeat(ends[:-1], width)
    key = (np.repeat(piece, width) * max(width.max(initial=1), 1) + place) * max(len(words), 1) + code
    kept = np.flatnonzero((code != wild) & (least > 0)[row])
    kept = kept[np.argsort(key[kept], kind="stable")]
    while True:
        first = np.flatnonzero(np.diff(key[kept], prepend=-1))
        sizes = np.diff(np.r_[first, len(kept)])
        shared = np.repeat(sizes, sizes)
        many = np.bincount(row[kept[shared > 1]], minlength=n)
        left = (shared > 1) & (many >= least)[row[kept]]
        if left.all():
            break
        kept = kept[left]
    if not len(kept):
        return {}
    by_row = np.lexsort((key[kept], shared, row[kept]))
    rows = row[kept][by_row]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    rare = kept[np.sort(by_row[rank <= (many - least)[rows]])]
    starts = np.flatnonzero(np.diff(key[rare], prepend=-1))
    sizes = np.diff(np.r_[starts, len(rare)])
    start = np.repeat(starts, sizes)
    before, rows = np.arange(len(rare)) - start, row[rare]
    pairs = []
    for at in _slices(before):
        one, other = np.repeat(rows[at], before[at]), rows[_ranges(start[at], before[at])]
        if part is not None:
            apart = part[one] != part[other]
            one, other = one[apart], other[apart]
        both = np.unique(one * n + other)
        one, other = both // n, both % n
        for some in _slices(width[one]):
            w = width[one[some]]
            if not len(w):
                continue
            x, y = code[_ranges(ends[one[some]], w)], code[_ranges(ends[other[some]], w)]
            same = np.add.reduceat((x == y) & (x != wild), np.cumsum(w) - w, dtype=np.int64)
            pairs.append(both[some][same >= least[one[some]]])
    found: dict[int, list[int]] = {}
    if pairs:
        for pair in np.unique(np.concatenate(pairs)).tolist():
            found.setdefault(pair // n, []).append(pair % n)
    return found


class _Leaf:
    """Templates of one token count, found by the rare tokens that they have at a place.

    Prose has millions of templates in a leaf, hardly any of them alike, so nothing here is an object for each template
    or token but its text. Templates are put without being indexed; a search first indexes those that aren't yet, as sorted
    arrays of tokens with their templates, of which there are few, as arrays of about the same size are merged."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.texts: list[str] = []
        self.line = array("q")
        self.part = array("q")
        #: Tokens of the indexed templates as numbers of 64 bits, 0 for a wildcard; room for more behind them.
        self.number, self.known = np.empty((0, 0), dtype=np.int64), 0
        #: Sorted tokens, and the template of each.
        self.index: list[tuple[np.ndarray, np.ndarray]] = []

    @property
    def templates(self) -> list[list[str]]:
        return [t.split(" ") for t in self.texts]

    @staticmethod
    def _numbers(texts: list[str]) -> np.ndarray:
        """A row for each text, all of which have as many tokens. Equal tokens have equal numbers."""
        code, _, words = _tokens(texts)
        words = words.to_numpy(zero_copy_only=False)
        number = pd.util.hash_array(words, categorize=False).view(np.int64)
        number[number == 0] = 1
        number[words == WILDCARD] = 0
        return number[code].reshape(len(texts), -1)

    @staticmethod
    def _keys(number: np.ndarray) -> np.ndarray:
        """The numbers of tokens, told apart by place."""
        return number ^ (np.arange(number.shape[1]) * 0x1E3779B97F4A7C15)

    def put(self, text: str, line: int, part: int = -1) -> int:
        self.texts.append(text if isinstance(text, str) else " ".join(text))
        self.line.append(line)
        self.part.append(part)
        return len(self.texts) - 1

    def _indexed(self) -> None:
        if self.known == len(self.texts):
            return
        number = self._numbers(self.texts[self.known:])
        if len(self.texts) > len(self.number):
            room = np.empty((max(len(self.texts), len(self.number) * 3 // 2), number.shape[1]), dtype=np.int64)
            room[:self.known] = self.number[:self.known].reshape(self.known, number.shape[1])
            self.number = room
        self.number[self.known:len(self.texts)] = number
        some = number.ravel() != 0
        key = self._keys(number).ravel()[some]
        at = np.repeat(np.arange(self.known, len(self.texts), dtype=np.int32), number.shape[1])[some]
        while True:
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            if not self.index or len(self.index[-1][0]) > 2 * len(key):
                break
            more = self.index.pop()
            key, at = np.r_[more[0], key], np.r_[more[1], at]
        self.index.append((key, at))
        self.known = len(self.texts)

    def near(self, texts: list[str]) -> dict[int, list[int]]:
        """For each text, by its place, the templates that may have enough equal tokens."""
        self._indexed()
        if not self.known or not texts:
            return {}
        number = self._numbers(texts)
        least, key = int(_least(self.similarity, number.shape[1])), self._keys(number)
        held = (number != 0).sum(axis=1)
        bounds = [(np.searchsorted(k, key, "left"), np.searchsorted(k, key, "right")) for k, _ in self.index]
        size = sum(right - left for left, right in bounds)
        # A template with enough equal tokens has one of these; the most common ones are only compared.
        order = np.argsort(np.where(number != 0, size, np.iinfo(np.int64).max), axis=1, kind="stable")
        row, rank = np.nonzero(np.arange(number.shape[1])[None, :] < (held - least + 1)[:, None])
        place = order[row, rank]
        row, place = row[size[row, place] > 0], place[size[row, place] > 0]
        found: dict[int, list[int]] = {}
        for at in _slices(size[row, place]):
            here, where = row[at], place[at]
            met = []
            for (left, right), (_, template) in zip(bounds, self.index):
                low, many = left[here, where], right[here, where] - left[here, where]
                met.append(np.repeat(here, many) * self.known + template[_ranges(low, many)])
            both = np.unique(np.concatenate(met))
            for some in _slices(np.full(len(both), number.shape[1])):
                one, other = both[some] // self.known, both[some] % self.known
                x = number[one]
                enough = ((x == self.number[other]) & (x != 0)).sum(axis=1) >= least
                for r, k in zip(one[enough].tolist(), other[enough].tolist()):
                    found.setdefault(r, []).append(k)
        return found

    def _exact(self, tokens: list[str], among: Iterable[int]) -> dict[int, int]:
        """Equal tokens of those templates that have enough of them."""
        least = int(_least(self.similarity, len(tokens)))
        same = {k: sum(a == b != WILDCARD for a, b in zip(tokens, self.texts[k].split(" "))) for k in (
            among if least > 0 else range(len(self.texts)))}
        return {k: n for k, n in same.items() if n >= least}

    def _equal(self, tokens: list[str]) -> dict[int, int]:
        """Equal tokens of every template that has enough of them."""
        return self._exact(tokens, self.near([" ".join(tokens)]).get(0, ()))

    def add(self, tokens: list[str], line: int, part: int | None = None) -> int:
        """The template that the tokens join, see ``_join``."""
        return self._join(tokens, self._equal(tokens), line, part)

    def _join(self, tokens: list[str], same: dict[int, int], line: int, part: int | None) -> int:
        """The template that the tokens join: the one with most equal tokens, then most wildcards, then the
        oldest, but none of the same ``part``; a new one if too few are equal."""
        if part is not None:
            same = {k: n for k, n in same.items() if self.part[k] != part}
        most = max(same.values(), default=0)
        best = max((k for k in same if same[k] == most), key=lambda k: (self._wildcards(k), -k), default=None)
        if best is None:
            return self.put(" ".join(tokens), line, -1 if part is None else part)
        merged = merge_tokens(self.texts[best].split(" "), tokens)
        self.texts[best] = " ".join(merged)
        if best < self.known:
            self.number[best, [t == WILDCARD for t in merged]] = 0
        if part is not None:
            self.part[best] = part
        return best

    def _wildcards(self, k: int) -> int:
        return self.texts[k].split(" ").count(WILDCARD)


#: Rows that a task gives at once.
_ROWS = 10_000


def _in_pieces(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    while piece := list(islice(rows, _ROWS)):
        yield record(schema, *zip(*piece))


class _Search:
    """The rows of a batch, sorted by leaf, on their way into templates. ``text`` is what a row is compared by, ``key`` its leaf;
    a row of the same ``part`` isn't compared, if there are parts."""

    def __init__(self, text: list[str], key: list, part: list[int] | None, similarity: float):
        self.text, self.part, self.similarity = text, part, similarity
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        #: (start, end) of what is searched together, at most ``_PIECE`` rows of one leaf.
        self.pieces = [(c, min(c + _PIECE, end)) for start, end in zip(cuts, cuts[1:]) for c in range(start, end, _PIECE)]
        piece = np.repeat(np.arange(len(self.pieces)), [b - a for a, b in self.pieces])
        self.alike = _alike(text, piece, None if part is None else np.array(part, dtype=np.int64), similarity)

    def open(self, leaf: _Leaf, a: int, b: int) -> None:
        """The rows of a piece go into ``leaf``, which has the earlier ones of theirs."""
        self.leaf, self.founded = leaf, {}
        self.near = {a + r: ks for r, ks in leaf.near(self.text[a:b]).items()} if leaf.texts else {}

    def put(self, i: int, line: int, part: int = -1) -> int:
        k = self.founded[i] = self.leaf.put(self.text[i], line, part)
        return k

    def add(self, i: int, line: int) -> int:
        """What ``_Leaf.add`` does with row ``i``."""
        part, many = None if self.part is None else self.part[i], len(self.leaf.texts)
        if i not in self.alike and i not in self.near and self.similarity > 1e-12:
            return self.put(i, line, -1 if part is None else part)
        among = dict.fromkeys([*self.near.get(i, ()), *(self.founded[j] for j in self.alike.get(i, ()) if j in self.founded)])
        tokens = self.text[i].split(" ")
        k = self.leaf._join(tokens, self.leaf._exact(tokens, among), line, part)
        if k == many:
            self.founded[i] = k
        return k


_MINED = "kind string, leaf string, part bigint, founder bigint, line bigint, first string, tokens string"
_MERGED = "kind string, leaf string, part bigint, founder bigint, line bigint, tokens string, template string"


def _mine_parts(rows: DataFrame, similarity: float, width: int) -> DataFrame:
    """Rows (leaf, part, fresh, first_line, tokens, line): patterns, and before them the templates known in an
    open part. Gives (kind 'member', line, founder) for each pattern and, behind a part, (kind 'template', leaf,
    part, founder, line, first, tokens): ``first`` is how the founder looked, ``line`` the template it is known to be in.
    No ``tokens`` means that they are still those of ``first``."""
    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, leaf, first, line = None, None, [], []

        def done() -> Iterator[tuple]:
            for k in range(len(line)):
                yield "template", *now, leaf.line[k], line[k], first[k], None if leaf.texts[k] == first[k] else leaf.texts[k]

        for batch in batches:
            names, parts, fresh, at, tokens, known = (batch[c].to_pylist() for c in ("leaf", "part", "fresh", "first_line", "tokens", "line"))
            keys = list(zip(names, parts))
            search = _Search(tokens, keys, None, similarity)
            for a, b in search.pieces:
                if keys[a] != now:
                    yield from done()
                    now, leaf, first, line = keys[a], _Leaf(similarity), [], []
                search.open(leaf, a, b)
                for i in range(a, b):
                    k = search.add(i, at[i]) if fresh[i] else search.put(i, at[i])
                    if k == len(first):
                        first.append(tokens[i] if fresh[i] else None)
                        line.append(None if fresh[i] else known[i])
                    if fresh[i]:
                        yield "member", None, None, leaf.line[k], at[i], None, None
        yield from done()

    return rows.repartition(width, "leaf", "part").sortWithinPartitions("leaf", "part", "fresh", "first_line").mapInArrow(
        lambda batches: _in_pieces(mined(batches), _MINED), _MINED)


def _merge_parts(rows: DataFrame, similarity: float, width: int) -> DataFrame:
    """Rows (leaf, fresh, order, part, founder, line, first, tokens, template): known templates and then the templates
    of parts in order of their founders. Gives (kind 'founder', founder, line) and, behind a leaf, (kind 'template', leaf,
    line, tokens, part, template). No ``template`` means that it is ``tokens``."""
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, leaf, final, at = None, None, [], {}

        def done() -> Iterator[tuple]:
            for k in range(len(final)):
                yield "template", now, leaf.part[k], None, leaf.line[k], leaf.texts[k], None if final[k] == leaf.texts[k] else final[k]

        for batch in batches:
            names, fresh, part, founder, line, first, tokens, template = (batch[c].to_pylist() for c in (
                "leaf", "fresh", "part", "founder", "line", "first", "tokens", "template"))
            search = _Search([t if f is None else f for f, t in zip(first, tokens)], names, part, similarity)
            for a, b in search.pieces:
                if names[a] != now:
                    yield from done()
                    now, leaf, final, at = names[a], _Leaf(similarity), [], {}
                search.open(leaf, a, b)
                for i in range(a, b):
                    if not fresh[i]:  # a template of the table
                        at[line[i]] = search.put(i, line[i], part[i])
                        final.append(tokens[i] if template[i] is None else template[i])
                        continue
                    now_ = first[i] if tokens[i] is None else tokens[i]
                    if first[i] is None:  # known to be in a template, and perhaps more general now
                        k = at[line[i]]
                    else:
                        k = search.add(i, founder[i])
                        if k == len(final):
                            final.append(now_)
                            at[founder[i]] = k
                        yield "founder", None, None, founder[i], leaf.line[k], None, None
                    if final[k] != now_:
                        final[k] = " ".join(merge_tokens(final[k].split(" "), now_.split(" ")))
        yield from done()

    return rows.repartition(width, "leaf").sortWithinPartitions("leaf", "fresh", "first_line").mapInArrow(
        lambda batches: _in_pieces(merged(batches), _MERGED), _MERGED)


def _patterns(keyed: DataFrame) -> DataFrame:
    return stage(keyed.groupBy(F.col("_pattern").alias("pattern")).agg(
        F.min("line_id").alias("first_line"), F.count(F.lit(1)).alias("n")), "patterns")


def _extended(known: Mined, patterns: DataFrame, similarity: float, max_children: int, part_size: int) -> Mined:
    """``known`` with the patterns that are new to it."""
    width = python_width(patterns.sparkSession)
    before = known.patterns.count()
    words = patterns.withColumn("words", text.tokens(F.col("pattern")))
    new = words.select(_digest("pattern"), "first_line", F.size("words").alias("width"), F.col("words")[0].alias("head")).join(
        known.patterns, "digest", "left_anti")
    new = stage(new, "new")
    numbered = dense_ids(new, "first_line", "rank", start=before).drop("n")
    heads = stage(_heads(new, known.heads, max_children), "heads")
    split = stage(_leaves(new.join(numbered, "first_line"), heads).select(
        "digest", "first_line", F.floor(F.col("rank") / part_size).alias("part"), "leaf"), "numbered")
    none = F.lit(-1).cast("bigint")  # a null would make all numbers of a batch floating-point ones
    fresh = patterns.select("first_line", F.col("pattern").alias("tokens")).join(split.drop("digest"), "first_line").select(
        "leaf", "part", F.lit(True).alias("fresh"), "first_line", "tokens", none.alias("line"))
    held = known.open.select("leaf", "part", F.lit(False).alias("fresh"), F.col("founder").alias("first_line"), "tokens", "line")
    parts = stage(_mine_parts(fresh.unionByName(held), similarity, width), "parts")
    made = parts.where("kind = 'template'")
    table = known.templates.select(
        "leaf", F.lit(False).alias("fresh"), F.col("line").alias("first_line"), F.col("last_part").alias("part"),
        none.alias("founder"), "line", F.lit(None).cast("string").alias("first"), "tokens", F.nullif("template", "tokens").alias("template"))
    added = made.select(
        "leaf", F.lit(True).alias("fresh"), F.col("founder").alias("first_line"), "part", "founder", F.coalesce("line", none).alias("line"), "first", "tokens",
        F.lit(None).cast("string").alias("template"))
    merged = stage(_merge_parts(table.unionByName(added), similarity, width), "merged")
    founders = merged.where("kind = 'founder'").select("founder", "line").unionByName(known.open.select("founder", "line"))
    members = parts.where("kind = 'member'").select(F.col("line").alias("first_line"), "founder")
    counts = members.groupBy("founder").agg(F.count(F.lit(1)).alias("n"))
    placed = spread_join(members, founders, ["founder"], by="first_line", hot=hot_keys(counts, ["founder"], "n"))
    named = split.select("digest", "first_line").join(placed.select("first_line", "line"), "first_line").select("digest", "line")
    patterns_ = stage(known.patterns.unionByName(named), "known")
    # A part is open until it has all its patterns.
    current = patterns_.count() // part_size
    open_ = made.where(F.col("part") == current).drop("line").withColumn("tokens", F.coalesce("tokens", "first")).join(founders, "founder")
    return Mined(
        patterns_, heads, stage(open_.select("leaf", "part", "founder", "line", "tokens"), "open"),
        merged.where("kind = 'template'").select(
            "leaf", "line", "tokens", F.col("part").alias("last_part"), F.coalesce("template", "tokens").alias("template")))


def extend(known: Mined, lines: DataFrame, similarity: float = SIMILARITY, max_children: int = MAX_CHILDREN,
           part_size: int = PART) -> tuple[DataFrame, Mined]:
    """Lines behind those that ``known`` was mined from (their ``line_id`` is larger): the lines with ``event_id``
    and ``template``, and the extended templates. Mining in steps gives what mining at once gives, with the
    same parameters; lines of earlier steps take their final template from ``with_stored_templates``."""
    keyed = lines.withColumn("_pattern", _pattern())
    patterns = _patterns(keyed)
    grown = _extended(known, patterns, similarity, max_children, part_size)
    return _named(keyed, patterns.select(_digest("pattern"), "n"), grown), grown


def _named(keyed: DataFrame, counts: DataFrame, known: Mined) -> DataFrame:
    held = known.patterns.join(counts, "digest")
    crowded = hot_keys(held.groupBy("line").agg(F.count(F.lit(1)).alias("n")), ["line"], "n")
    numbers = dense_ids(known.templates.select("line"), "line", "event_id", start=1).drop("n")
    numbered = spread_join(held.select("digest", "line"), numbers, ["line"], by="digest", hot=crowded)
    table = spread_join(numbered, known.templates.select("line", "template"), ["line"], by="digest", hot=crowded).drop("line")
    lines = keyed.withColumn("_digest", _digest("_pattern")).drop("_pattern")
    hot = hot_keys(counts, ["digest"], "n").withColumnRenamed("digest", "_digest")
    return spread_join(lines, table.withColumnRenamed("digest", "_digest"), ["_digest"], by="line_id", how="left", hot=hot).drop("_digest")


def with_stored_templates(known: Mined, lines: DataFrame) -> DataFrame:
    """Add ``event_id`` and ``template`` from the table; null where a line's pattern is new to it."""
    keyed = lines.withColumn("_pattern", _pattern())
    counts = stage(keyed.groupBy(_digest("_pattern")).agg(F.count(F.lit(1)).alias("n")), "digests")
    return _named(keyed, counts, known)


def with_mined_templates(lines: DataFrame, similarity: float = SIMILARITY, max_children: int = MAX_CHILDREN,
                         part_size: int = PART) -> DataFrame:
    """Add ``event_id`` and ``template`` to lines with a ``line_id`` and ``content``; ids count
    from 1 by first appearance. Only distinct patterns are merged and joined back."""
    return extend(Mined.nothing(lines.sparkSession), lines, similarity, max_children, part_size)[0]


def mine_templates(lines: DataFrame, similarity: float = SIMILARITY, max_children: int = MAX_CHILDREN,
                   part_size: int = PART) -> DataFrame:
    """(line_id, event_id, template) for every line."""
    return with_mined_templates(lines.select("line_id", "content"), similarity, max_children, part_size).select(
        "line_id", "event_id", "template")

"""The trie of conversation prefixes, from sorted neighbours.

Every turn becomes a digest of 16 bytes, a conversation the string of its turns' digests. The strings
are sorted by ranges. Two sorted neighbours share a prefix of some depth, the LCP edge between them.
Within a range a union-find takes the edges in descending depth: a component is the set of
conversations below a node, every merge makes a branching node at the edge's depth, and the turns
between two merges are nodes with one child. Nodes that hold neither the first nor the last
conversation of their range are finished there.

The others, on the two borders of a range, may go on in the ranges beside it. A range's forest is
contracted to these two paths, and nodes of equal prefix are merged across the borders. What a subtree
holds is a sum over nodes, each of which counts on one path that runs through it; so it comes from
running sums along the paths.

Defined cases: turns are ordered by turn, null first, then by the digest of role and text; a null role
or text is an empty one; repeated rows are turns of their own; rows without a conversation id are of
no conversation and are left out; a conversation without turns is a member of the root; ``%`` is
the remainder with the sign of the id; other columns are ignored; an empty table has no nodes.
A conversation travels as one row of 24 bytes a turn, and its texts don't, so one of a million turns takes
24 MB. The ids that end at one node are sorted and written out in parallel; their SHA-256, which can't be
split, is taken in one task as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.memory import claim
from loglens.operators.joins import spread_join
from loglens.session import stage

#: Conversations that share turns, and the number of a conversation's first turns that may be replaced.
GROUP, HEADS = 5, 9
#: Conversations of a range, about.
RANGE = 20_000
#: Ids in a text that is hashed at once.
CHUNK = 1000
_DIGEST = 16
NODE = ("kind tinyint, path bigint, depth bigint, key binary, parent_key binary, conv_id bigint, parent_conv_id bigint, "
        "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends_sha256 string")
_TYPES = {"tinyint": pa.int8(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in NODE.split(", "))])
#: Kinds of rows that a range makes: finished nodes, nodes on a border, conversations that end at one of these.
FINISHED, BORDER, END = 0, 1, 2


def _head(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its group."""
    return F.crc32(conv.cast("string")) % HEADS


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the rebuilt turns of every conversation in order, each a digest and its text's bytes."""
    role_, text_ = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    said = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"),
        F.substring(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256), 1, 2 * _DIGEST).alias("digest"),
        F.octet_length(text_).cast("bigint").alias("size"))
    own = stage(said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns")), "turns")
    first = own.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("heads"))
    h = _head(F.col("conv_id"))
    none = F.filter("turns", lambda t: F.lit(False))
    return own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(first, "base", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("heads", none), F.lit(1), h.cast("int")),
                            F.slice("turns", (h + 1).cast("int"), F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


class Component:
    """The conversations below one node: what is known of the node at ``depth``."""

    __slots__ = ("first", "last", "depth", "conv", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, row: int, depth: int, conv: int):
        self.first = self.last = row
        self.depth, self.conv, self.n = depth, conv, 1
        self.children = self.leaves = self.saved = 0
        self.ends = [conv]
        self.waiting: list[dict] = []  # children that don't know their parent's conversation yet


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two strings of digests begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // _DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // _DIGEST


def joined(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


class Forest:
    """The nodes of one sorted range of conversations."""

    def __init__(self, path: int, convs: list[int], keys: list[bytes], sizes: list[np.ndarray]):
        self.path, self.convs, self.keys, self.sizes = path, convs, keys, sizes
        self.lcp = [common_turns(a, b) for a, b in zip(keys, keys[1:])]
        #: For every row the turns that it shares with the first and the last one.
        self.before, self.after = _running_least(self.lcp), _running_least(self.lcp[::-1])[::-1]
        self.rows: list[dict] = []
        n = len(convs)
        self.parent = list(range(n))
        self.found = [Component(k, len(keys[k]) // _DIGEST, convs[k]) for k in range(n)]
        for at in np.argsort(-np.array(self.lcp, dtype=np.int64), kind="stable").tolist():
            self.merge(at, at + 1, self.lcp[at])
        top = self.found[self.root(0)]
        self.lift(top, -1)

    def root(self, row: int) -> int:
        while self.parent[row] != row:
            self.parent[row] = row = self.parent[self.parent[row]]
        return row

    def merge(self, a: int, b: int, depth: int) -> None:
        i, j = self.root(a), self.root(b)
        one, two = self.found[i], self.found[j]
        self.lift(one, depth)
        self.lift(two, depth)
        if one.n < two.n:
            i, j, one, two = j, i, two, one
        self.parent[j], self.found[j] = i, None
        one.first, one.last = min(one.first, two.first), max(one.last, two.last)
        one.conv, one.n = min(one.conv, two.conv), one.n + two.n
        one.children, one.leaves, one.saved = one.children + two.children, one.leaves + two.leaves, one.saved + two.saved
        one.ends.extend(two.ends)
        one.waiting.extend(two.waiting)

    def lift(self, c: Component, depth: int) -> None:
        """Finish the nodes of ``c`` below ``depth``; it then stands for the node there."""
        while c.depth > depth:
            self.finish(c)
            c.depth -= 1

    def finish(self, c: Component) -> None:
        """Write the node that ``c`` stands for, and make it a child of the node above. On a border only
        what lies below it within the range counts, and its own part waits until it is merged."""
        left, right = c.first == 0, c.last == len(self.convs) - 1
        for child in c.waiting:
            child["parent_conv_id"] = c.conv
        size = int(self.sizes[c.first][c.depth - 1]) if c.depth else 0
        row = {"depth": c.depth, "conv_id": c.conv, "n_convs": c.n, "n_children": c.children, "n_leaves": c.leaves,
               "saved_tokens": c.saved}
        if left or right:
            named = {"kind": BORDER, "key": self.key(c.first, c.depth), "size": size,
                     "parent_key": self.key(c.first, c.depth - 1) if c.depth else None}
            if left:
                self.rows.append(row | named | {"path": 2 * self.path})
            if right:
                # Where both paths run through the node, its sums count on the first.
                nothing = dict.fromkeys(("n_convs", "n_children", "n_leaves", "saved_tokens"), 0) if left else {}
                self.rows.append(row | named | nothing | {"path": 2 * self.path + 1})
            self.rows += [{"kind": END, "key": named["key"], "conv_id": conv} for conv in c.ends]
            c.children = c.leaves = c.saved = 0
            c.waiting = []
        else:
            c.leaves, c.saved = c.leaves or 1, c.saved + (c.n - 1) * size
            row |= {"kind": FINISHED, "n_leaves": c.leaves, "saved_tokens": c.saved, "ends_sha256": joined(c.ends)}
            self.rows.append(row)
            above = self.on_border_above(c)
            if above:
                row["parent_key"] = self.key(c.first, c.depth - 1)
            c.children, c.waiting = 1, [] if above else [row]
        c.ends = []

    def on_border_above(self, c: Component) -> bool:
        """Whether the parent of the node holds the first or the last conversation of the range."""
        return max(self.before[c.first], self.after[c.last]) >= c.depth - 1

    def key(self, row: int, depth: int) -> bytes:
        return hashlib.blake2b(self.keys[row][: depth * _DIGEST], digest_size=16).digest()


def _running_least(values: list[int]) -> list[int]:
    out = [1 << 60]
    for v in values:
        out.append(min(out[-1], v))
    return out


def _forests(convs: DataFrame, parts: int) -> DataFrame:
    """Rows of ``NODE``: what each sorted range makes of its conversations."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("trie")
        ids, keys, sizes = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            keys += batch.column(1).to_pylist()
            sizes += [row.values.to_numpy() for row in batch.column(2)]
        if ids:
            rows = Forest(TaskContext.get().partitionId(), ids, keys, sizes).rows
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=_SCHEMA)

    keyed = convs.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"))
    return keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(grow, NODE)


def _ends(rows: DataFrame, width: int) -> DataFrame:
    """(key, ends_sha256) of nodes on a border at which conversations end. Sorted ranges of the ids are written
    out in parallel, ``CHUNK`` at most in a text; a node's task hashes its texts as they come."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("trie")
        for batch in batches:
            keys, ids, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            a = 0
            for b in range(1, len(keys) + 1):
                if b == len(keys) or keys[b] != keys[a] or b - a == CHUNK:
                    out.append((keys[a], ids[a], ",".join(map(str, ids[a:b]))))
                    a = b
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.string()))],
                ["key", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("trie")
        now, held = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key == now:
                    held.update(b"," + ids.as_py().encode())
                else:
                    if held:
                        done.append((now, held.hexdigest()))
                    now, held = key, hashlib.sha256(ids.as_py().encode())
            yield made(done)
        if held:
            yield made([(now, held.hexdigest())])

    def made(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends_sha256"])

    ends = rows.where(F.col("kind") == END).select("key", "conv_id")
    texts = ends.repartitionByRange(width, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        write, "key binary, first bigint, ids string")
    return texts.repartition(width, "key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(
        digest, "key binary, ends_sha256 string")


def _merged(rows: DataFrame, width: int) -> DataFrame:
    """The nodes on borders, merged by their key, with the sums over their subtrees."""
    border = rows.where(F.col("kind") == BORDER)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    alone = stage(border.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums,
        F.max("size").alias("size"), F.min("path").alias("owner")), "border")
    more = alone.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    nodes = stage(alone.join(more, "key", "left").select(
        "key", "parent_key", "depth", "conv_id", "n_convs", children.alias("n_children"), "owner",
        (F.col("n_leaves") + F.when(children == 0, 1).otherwise(0)).alias("leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).alias("saved")), "border_nodes")
    # A node's own part counts on its first path; every path through a node runs on through its subtree.
    below = Window.partitionBy("path").orderBy(F.desc("depth"))
    counts = F.col("path") == F.col("owner")
    along = border.select("path", "key").join(nodes.select("key", "depth", "owner", "leaves", "saved"), "key").select("key", *[
        F.sum(F.when(counts, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("leaves", "saved")])
    whole = along.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.drop("leaves", "saved", "owner").join(whole, "key").join(above, "parent_key", "left").join(
        _ends(rows, width), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def nodes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
          in_range: int = RANGE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    convs = stage(rebuilt(turns, conv, turn, role, text), "rebuilt")
    many, long = convs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()
    rows = stage(_forests(convs, max(width, -(-many // in_range), -(-long // (16 * in_range)))), "nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    merged = stage(_merged(rows, width), "merged")
    finished = rows.where(F.col("kind") == FINISHED)
    named = spread_join(
        finished.where("parent_key IS NOT NULL").drop("parent_conv_id"),
        merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), ["parent_key"], by="conv_id")
    return finished.where("parent_key IS NULL").select(*columns).unionByName(named.select(*columns)).unionByName(merged.select(*columns))

"""Near pairs under cosine distance, without listing all pairs.

Unit vectors are kept in a tree of cells (``celltree``) and its leaves are dealt into a few blocks of about equal
size. Each pair of blocks is a task: one block is held, the other one streams past it, and bounds on the largest
weights and the extent of a leaf leave out the vectors that have no partner there; what is left meets in one matrix
product per batch. So a vector is sent once for each block, not once for each leaf, and the number of blocks only grows
where a block would not fit a task. Vectors are sent in compressed packs, which take a quarter of the room of rows.
What leaves a task is a count, a label or a link for each vector, never the pairs.

Where links or a number of neighbours that is enough are asked for, all vectors meet a few hubs first, and only what is
left open by them is compared with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.operators import celltree, vectors
from loglens.session import python_width, stage

_DIGITS = 9
_SLACK = 1e-6
#: Blocks at most as long as one holds no more than so many bytes of vectors.
BLOCKS, HELD = 8, 128 << 20
#: Vectors that all others are compared with first where there are more than ``MANY``; what they settle isn't compared again.
HUBS, MANY = 4096, 16_384


@dataclass(frozen=True)
class Groups:
    """Where vectors meet. ``members`` (cell, id, a, idx, w) has each vector in its leaf, ``a`` its copies."""

    items: DataFrame
    members: DataFrame
    width: int | np.ndarray
    low: float
    #: (cell, block) of all leaves, and how many blocks there are; groups of fewer points keep them.
    placed: tuple[DataFrame, int]

    @cached_property
    def tree(self) -> celltree.Tree:
        """The tree of the cells with its bounds, which only ``visits`` needs."""
        return celltree.build(self.items, scale=self.width if isinstance(self.width, np.ndarray) else None)

    @cached_property
    def many(self) -> int:
        return self.members.count()

    @property
    def points(self) -> DataFrame:
        return self.members.select(F.col("id").alias("point"), F.col("a").alias("copies"))

    def only(self, points: DataFrame) -> Groups:
        kept = points.select(F.col("point").alias("id"))
        return replace(self, members=self.members.join(kept, "id", "left_semi"))

    def packs(self, members: DataFrame) -> DataFrame:
        """(block, pack): ``members`` in packs of one block each."""
        cells, _ = self.placed
        return _packed(members.join(F.broadcast(cells), "cell"))

    @cached_property
    def visits(self) -> DataFrame:
        """A row for each leaf that a vector may have a partner in: what the bounds leave, as a written table. The
        searches below don't use it, they apply the bounds inside their tasks."""
        return celltree.visits(self.tree, self.members.drop("cell").withColumn("low", F.lit(self.low)))

    def pairs_computed(self) -> int:
        """Products that the visits stand for."""
        sizes = self.tree.leaves.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return self.visits.groupBy("cell").agg(F.count(F.lit(1)).alias("v")).join(sizes, "cell").agg(
            F.coalesce(F.sum(F.col("n") * F.col("v")), F.lit(0))).first()[0]


def _groups(items: DataFrame, eps: float, scale: np.ndarray | None = None) -> Groups:
    leaves, width = celltree.place(items, scale=scale)
    return Groups(items, leaves, width, round(1.0 - eps, _DIGITS), _blocks(leaves))


def text_groups(weights: DataFrame, points: DataFrame, eps: float) -> Groups:
    """Groups for sparse unit vectors (point, idx, w) and their points (point, copies)."""
    if not 0.0 <= eps < 1.0:
        raise ValueError("eps must be in [0, 1): vectors without a common word are at distance 1")
    packed = weights.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("e"))
    items = stage(packed.join(points.select("point", "copies"), "point").select(
        F.col("point").alias("id"), F.col("copies").alias("a"), F.col("e.idx").alias("idx"), F.col("e.w").alias("w")), "items")
    return _groups(items, eps)


def model_groups(model: vectors.TextVectors, eps: float) -> Groups:
    """Groups for the points of a text model, which travel as counts."""
    if not 0.0 <= eps < 1.0:
        raise ValueError("eps must be in [0, 1): vectors without a common word are at distance 1")
    return _groups(model.packed(), eps, model.scale)


def dense_groups(points: DataFrame, eps: float) -> Groups:
    """Groups for dense unit vectors (point, copies, vec)."""
    return _groups(points.select(
        F.col("point").alias("id"), F.col("copies").alias("a"), F.array().cast("array<int>").alias("idx"), F.col("vec").alias("w")), eps)


def _near(x: np.ndarray, y: np.ndarray, low: float) -> np.ndarray:
    """Which products of the rows of two matrices, of length 1 at most, reach ``low`` after rounding. They are formed in
    single precision, and again in double precision where that doesn't tell."""
    products = x.astype(np.float32) @ y.astype(np.float32).T
    unsure = 1.2e-7 * (x.shape[1] + 8) + 10.0**-_DIGITS
    near = products >= np.float32(low)
    r, c = np.nonzero(np.abs(products - np.float32(low)) <= unsure)
    for k in range(0, len(r), _AGAIN):
        r_, c_ = r[k:k + _AGAIN], c[k:k + _AGAIN]
        near[r_, c_] = np.round(np.einsum("ij,ij->i", x[r_], y[c_]), _DIGITS) >= low
    return near


#: Products that are formed again at once.
_AGAIN = 8192


class _Part:
    """Some held vectors of neighbouring leaves, with the bounds on their products."""

    def __init__(self, rows: pa.RecordBatch, start: int, width: int | np.ndarray):
        self.rows, self.width, self.at = rows, width, slice(start, start + rows.num_rows)
        x = self.matrix()
        self.middle, self.hi, self.lo = x.mean(axis=0), x.max(axis=0), x.min(axis=0)
        self.r = float(np.sqrt(((x - self.middle) ** 2).sum(axis=1).max()))

    def matrix(self) -> np.ndarray:
        return celltree.matrix(self.rows, self.width)


class _Held:
    """The held block of a task: ids, ``a`` and parts."""

    def __init__(self, batches: list[pa.RecordBatch], width: int | np.ndarray):
        table = pa.Table.from_batches(batches)
        self.ids, self.a = table["id"].to_numpy(), table["a"].to_numpy()
        whole = table.select(["id", "idx", "w"]).combine_chunks().to_batches()[0]
        cells = table["cell"].to_numpy()
        ends = [*(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        self.parts, start = [], 0
        for end in ends:  # small leaves beside each other are one part
            if end - start >= max(1, celltree.LEAF // 8) or end == len(cells):
                for at in range(start, end, celltree.LEAF):
                    self.parts.append(_Part(whole.slice(at, min(celltree.LEAF, end - at)), at, width))
                start = end
        self.middle, self.hi, self.lo = (np.vstack([getattr(p, name) for p in self.parts]).T for name in ("middle", "hi", "lo"))
        self.r = np.array([p.r for p in self.parts])

    def reach(self, x: np.ndarray, low: float) -> np.ndarray:
        """Whether the vectors of a batch may have a partner in the parts."""
        ball = x @ self.middle + np.sqrt((x * x).sum(axis=1))[:, None] * self.r[None, :]
        box = np.maximum(x, 0) @ self.hi + np.minimum(x, 0) @ self.lo
        return np.minimum(ball, box) >= low - _SLACK


def _blocks(members: DataFrame) -> tuple[DataFrame, int]:
    """(cell, block) of all leaves, and how many blocks there are."""
    cells = stage(members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(12 * F.size("w") + 64).alias("bytes")), "blocks")
    many, size = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    blocks = int(max(1, min(BLOCKS, -(-many // celltree.LEAF)), -(-size // HELD)))
    # One row for each leaf, so the window is small. A leaf is smaller than a block.
    before = F.sum("bytes").over(Window.orderBy("cell")) - F.col("bytes")
    return cells.select("cell", F.least(F.floor(before * blocks / max(size, 1)), F.lit(blocks - 1)).cast("int").alias("block")), blocks


def _packed(members: DataFrame) -> DataFrame:
    """(block, pack): what a partition has of a block, in order of the leaves, as a few compressed values."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, vectors_ = batch["block"].to_numpy(), batch.select(["cell", "id", "a", "idx", "w"])
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            at = [(c, min(celltree.LEAF, end - c)) for start, end in zip(cuts, cuts[1:]) for c in range(start, end, celltree.LEAF)]
            yield celltree.record("block int, pack binary", [int(block[c]) for c, _ in at], [_pack(vectors_.slice(c, n)) for c, n in at])

    return members.sortWithinPartitions("block", "cell", "id").mapInArrow(pack, "block int, pack binary")


_PACK = pa.schema([("cell", pa.list_(pa.string())), ("whole", pa.bool_()), *((c, pa.binary()) for c in ("n", "id", "a", "length", "idx", "w"))])


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: high bytes are nearly all equal."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(planes: pa.Scalar, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(planes.as_buffer(), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _pack(batch: pa.RecordBatch) -> bytes:
    """The vectors (cell, id, a, idx, w) as steps from dimension to dimension and numbers, both in planes; ``n`` rows follow each
    other in a cell, and numbers are whole where all are."""
    cells = batch["cell"].to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    idx, w = batch["idx"], batch["w"]
    at, numbers = idx.flatten().to_numpy(), w.flatten().to_numpy(zero_copy_only=False)
    steps, first = np.diff(at, prepend=0).astype(np.int32), idx.offsets.to_numpy()[:-1][np.diff(idx.offsets.to_numpy()) > 0] - idx.offsets[0].as_py()
    steps[first] = at[first]
    whole = bool((numbers == np.rint(numbers)).all() and (np.abs(numbers) < 2**31).all() and not np.signbit(numbers[numbers == 0]).any())
    row = [cells[cuts].tolist(), whole, *map(_planes, (
        np.diff(np.r_[cuts, len(cells)]).astype(np.int64), batch["id"].to_numpy(), batch["a"].to_numpy(),
        np.diff(w.offsets.to_numpy()).astype(np.int32), steps, numbers.astype(np.int32) if whole else numbers))]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _PACK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PACK)], schema=_PACK))
    return out.getvalue().to_pybytes()


def _unpack(pack: pa.BinaryScalar) -> pa.RecordBatch:
    row = pa.ipc.open_stream(pack.as_buffer()).read_next_batch()
    n, ids, a = (_values(row[c][0], "<i8") for c in ("n", "id", "a"))
    length, steps, w = _values(row["length"][0], "<i4"), _values(row["idx"][0], "<i4"), _values(row["w"][0], "<i4" if row["whole"][0].as_py() else "<f8")
    ends = np.r_[0, np.cumsum(length)].astype(np.int32)
    idx_ends = ends if len(steps) else np.zeros_like(ends)
    total = np.cumsum(steps, dtype=np.int64)
    before = np.r_[0, total][idx_ends[:-1]]  # a vector's first step is its first dimension
    idx = total - np.repeat(before, np.diff(idx_ends))
    return celltree.record(
        "cell string, id bigint, a bigint, idx array<int>, w array<double>", np.repeat(np.array(row["cell"][0].as_py(), dtype=object), n).tolist(), ids, a,
        pa.ListArray.from_arrays(pa.array(idx_ends, pa.int32()), pa.array(idx.astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.astype(float))))


#: Tasks that share the visitors of a block.
_CUTS = 4


def _meet(groups: Groups, held: DataFrame, visitors: DataFrame | None, schema: str, start: Callable, few: bool = False) -> DataFrame:
    """All of ``visitors`` past all of ``held``, or with None each unordered pair of ``held`` in one task. With ``few`` it is
    ``held`` that is small: it is sent to all tasks, and the visitors once for each ``HELD`` bytes of it.

    ``start(held block, alone)`` gives a function from a batch of visitors to a batch of the result, and one for the end,
    which may be None. ``alone`` says that the block meets itself, in both orders."""
    mine, last, width = groups.packs(held), groups.placed[1] - 1, groups.width
    if visitors is None:
        # Block i meets block j >= i: it is held for the earlier ones and a visitor to the later ones.
        here = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block"))))
        there = mine.where(F.col("block") < last).withColumn("later", F.explode(F.sequence(F.col("block") + 1, F.lit(last)))).select(
            F.col("later").alias("block"), F.col("block").alias("other"), "pack")
    elif few:
        size = held.agg(F.coalesce(F.sum(12 * F.size("w") + 64), F.lit(0))).first()[0]
        many = max(1, -(-size // HELD))
        here = mine.select((F.col("block") % many).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(_CUTS * (last + 1) - 1))).alias("other"), "pack")
        there = groups.packs(visitors).select(
            F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("block"),
            (F.col("block") * _CUTS + F.pmod(F.xxhash64("pack"), F.lit(_CUTS)).cast("int")).alias("other"), "pack")
    else:
        # Few visitors are dealt into fewer groups, as what is held is sent to each of them.
        many = min(last + 1, max(1, -(-visitors.count() // celltree.LEAF)))
        here = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        there = groups.packs(visitors).select(
            (F.col("block") % many).alias("other"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"), "pack")
    columns = ["block", "other", "kind", "pack"]
    both = here.withColumn("kind", F.lit(0)).select(*columns).unionByName(there.withColumn("kind", F.lit(1)).select(*columns)).repartition(
        python_width(held.sparkSession), "block", "other").sortWithinPartitions("block", "other", "kind")
    alone_too = visitors is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, going = None, [], None

        def opened() -> Iterator[pa.RecordBatch]:
            """Starts with the rows that were gathered; a block that meets itself visits itself."""
            nonlocal rows, going
            alone = alone_too and now[0] == now[1]
            whole = pa.Table.from_batches(rows).sort_by([("cell", "ascending"), ("id", "ascending")]).combine_chunks().to_batches()
            rows = []
            going = start(_Held(whole, width), alone)
            if alone:
                for batch in whole:
                    yield from visited(batch)

        def visited(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for c in range(0, batch.num_rows, celltree.TOGETHER):
                yield going[0](batch.slice(c, min(celltree.TOGETHER, batch.num_rows - c)))

        def closed() -> Iterator[pa.RecordBatch]:
            if rows and alone_too and now[0] == now[1]:
                yield from opened()
            if going and going[1]:
                yield going[1]()

        for batch in batches:
            for block, other, kind, pack in zip(*(batch[c] for c in columns)):
                if (key := (block.as_py(), other.as_py())) != now:
                    yield from closed()
                    now, rows, going = key, [], None
                if not kind.as_py():
                    rows.append(_unpack(pack))
                    continue
                if rows:
                    yield from opened()
                if going:
                    yield from visited(_unpack(pack))
        yield from closed()

    return both.mapInArrow(run, schema)


def _hubs(groups: Groups) -> pa.RecordBatch:
    """Some vectors (id, a, idx, w), chosen by a hash."""
    ids = stage(groups.members.select("id").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(HUBS), "hub_ids")
    found = groups.members.join(F.broadcast(ids), "id", "left_semi").select("id", "a", "idx", "w").toArrow()
    return found.sort_by("id").combine_chunks().to_batches()[0]


def _past_hubs(groups: Groups, hubs: pa.RecordBatch, schema: str, start: Callable) -> DataFrame:
    """What ``start(hubs as a matrix)``, a function of a matrix of vectors and their batch, gives for all members. A written table."""
    width = groups.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visit = None
        for batch in batches:
            for c in range(0, batch.num_rows, celltree.TOGETHER):
                visit = visit or start(celltree.matrix(hubs, width))
                some = batch.slice(c, min(celltree.TOGETHER, batch.num_rows - c))
                yield visit(celltree.matrix(some, width), some)

    return stage(groups.members.select("id", "a", "idx", "w").mapInArrow(run, schema), "past_hubs")


def core_points(groups: Groups, eps: float, min_samples: int) -> DataFrame:
    """(point): those that make ``min_samples`` rows with their copies and neighbours. Most have enough of them among the
    hubs; the neighbours of the others are counted."""
    own = groups.points
    if groups.many <= MANY:
        return own.join(neighbour_counts(groups, eps), "point", "left").where(
            F.col("copies") + F.coalesce("near", F.lit(0)) >= min_samples).select("point")
    hubs, low = _hubs(groups), round(1.0 - eps, _DIGITS)
    names, copies = hubs["id"].to_numpy(), hubs["a"].to_numpy()

    def count(matrix: np.ndarray):
        def visit(x: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
            near = _near(x, matrix, low) & (batch["id"].to_numpy()[:, None] != names[None, :])
            return celltree.record("id bigint, rows bigint", batch["id"], batch["a"].to_numpy() + _weighed(near, copies))

        return visit

    counted = _past_hubs(groups, hubs, "id bigint, rows bigint", count)
    known = counted.where(F.col("rows") >= min_samples).select(F.col("id").alias("point"))
    unsure = stage(counted.where(F.col("rows") < min_samples).select(F.col("id").alias("point")), "unsure")
    schema, width = "point bigint, rows bigint", groups.width

    def start(held: _Held, alone: bool):
        rows = np.zeros(len(held.ids), dtype=np.int64)

        def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, ids, here = celltree.matrix(batch, width), batch["id"].to_numpy(), batch["a"].to_numpy()
            reach = held.reach(x, low)
            for k, part in enumerate(held.parts):
                some = np.flatnonzero(reach[:, k])
                if len(some):
                    near = _near(x[some], part.matrix(), low) & (ids[some][:, None] != held.ids[part.at][None, :])
                    rows[part.at] += _weighed(near.T, here[some])
            return celltree.record(schema, [], [])

        return visit, lambda: celltree.record(schema, held.ids, rows)

    met = _meet(groups, groups.only(unsure).members, groups.members, schema, start, few=True)
    more = met.unionByName(own.select("point", F.col("copies").alias("rows")).join(unsure, "point", "left_semi")).groupBy("point").agg(
        F.sum("rows").alias("rows")).where(F.col("rows") >= min_samples).select("point")
    return known.unionByName(more)


def neighbour_counts(groups: Groups, eps: float) -> DataFrame:
    """(point, near): rows within ``eps`` of each point, its own copies not included."""
    schema, width, low = "point bigint, near bigint", groups.width, round(1.0 - eps, _DIGITS)

    def start(held: _Held, alone: bool):
        own = np.zeros(len(held.ids), dtype=np.int64)

        def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, ids, copies = celltree.matrix(batch, width), batch["id"].to_numpy(), batch["a"].to_numpy()
            counts, reach = np.zeros(len(ids), dtype=np.int64), held.reach(x, low)
            for k, part in enumerate(held.parts):
                some = np.flatnonzero(reach[:, k])
                if not len(some):
                    continue
                near = _near(x[some], part.matrix(), low)
                if alone:
                    near &= ids[some][:, None] != held.ids[part.at][None, :]
                else:
                    own[part.at] += _weighed(near.T, copies[some])
                counts[some] += _weighed(near, held.a[part.at])
            return celltree.record(schema, ids, counts)

        return visit, None if alone else lambda: celltree.record(schema, held.ids, own)

    met = _meet(groups, groups.members, None, schema, start)
    return met.groupBy("point").agg(F.sum("near").alias("near"))


def _weighed(near: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of the true cells of each row."""
    return np.count_nonzero(near, axis=1) if (weights == 1).all() else near @ weights


class _Sets:
    """Disjoint sets of the vectors in a task; ``label`` is the set of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, n: int) -> slice:
        at = len(self.label)
        self.label = np.concatenate([self.label, np.arange(at, at + n)])
        return slice(at, at + n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins the sets of the pairs; the places of the pairs that joined two sets."""
        left, right = self.label[a], self.label[b]
        least, most = np.minimum(left, right), np.maximum(left, right)
        _, first = np.unique(least * len(self.label) + most, return_index=True)
        first = first[least[first] != most[first]]
        parent: dict[int, int] = {}

        def top(v: int) -> int:
            while v in parent:
                v = parent[v]
            return v

        taken = []
        for k, u, v in zip(first.tolist(), least[first].tolist(), most[first].tolist()):
            u, v = top(u), top(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
                taken.append(k)
        if parent:
            moved = np.arange(len(self.label))
            for v in sorted(parent):  # a parent is less than its child, so it has its final place
                moved[v] = moved[parent[v]]
            self.label = moved[self.label]
        return np.array(taken, dtype=np.int64)


def component_edges(groups: Groups, eps: float) -> DataFrame:
    """(a, b): links that connect the same points as all near pairs do; a task gives fewer than it has vectors.

    Many vectors are compared with some hubs first. Those that the hubs connect with the largest set, the crowd, are
    compared only with those outside of it, which are few if the data is dense."""
    if groups.many <= MANY:
        return _all_edges(groups, eps)
    hubs, low = _hubs(groups), round(1.0 - eps, _DIGITS)
    names, schema = hubs["id"].to_numpy(), "hub boolean, a bigint, b bigint"
    sets, matrix = _Sets(len(names)), celltree.matrix(hubs, groups.width)
    for c in range(0, len(names), celltree.TOGETHER):
        r, k = np.nonzero(_near(matrix[c:c + celltree.TOGETHER], matrix, low))
        sets.join(r + c, k)
    known = sets.label

    def link(matrix: np.ndarray):
        task = _Sets(0)
        task.label = known.copy()

        def visit(x: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
            near, ids = _near(x, matrix, low), batch["id"].to_numpy()
            any_, first = near.any(axis=1), near.argmax(axis=1)
            r, k = np.nonzero(near & (task.label[first][:, None] != task.label[None, :]))
            new = task.join(first[r], k)
            b = np.where(any_, names[first], ids)  # without a hub a point is linked with itself
            return celltree.record(schema, [False] * len(ids) + [True] * len(new), np.r_[ids, names[first[r[new]]]], np.r_[b, names[k[new]]])

        return visit

    linked = _past_hubs(groups, hubs, schema, link)
    place = {name: k for k, name in enumerate(names.tolist())}
    pairs = [(place[r["a"]], place[r["b"]]) for r in linked.where("hub").select("a", "b").distinct().collect()]  # hubs x tasks at most
    if pairs:
        sets.join(*(np.array(side) for side in zip(*pairs)))
    held_by = np.zeros(len(names), dtype=np.int64)  # of each set, by its label
    is_hub = F.broadcast(linked.sparkSession.createDataFrame([(name,) for name in names.tolist()], "b bigint"))
    for r in linked.where("NOT hub").join(is_hub, "b", "left_semi").groupBy("b").count().collect():  # a row for each hub
        held_by[sets.label[place[r["b"]]]] += r["count"]
    crowd = linked.sparkSession.createDataFrame(
        [(name,) for name, label in zip(names.tolist(), sets.label.tolist()) if label == held_by.argmax()], "b bigint")
    outside = stage(linked.where("NOT hub").join(F.broadcast(crowd), "b", "left_anti").select(F.col("a").alias("point")), "outside")
    own = [(int(a), int(b)) for a, b in zip(names, names[known]) if a != b]  # what the hubs link among themselves
    edges = linked.where("a <> b").select("a", "b").unionByName(linked.sparkSession.createDataFrame(own, "a bigint, b bigint"))
    return edges.unionByName(_outside_edges(groups, outside, low))


def _outside_edges(groups: Groups, outside: DataFrame, low: float) -> DataFrame:
    """(a, b): links of the points ``outside`` the crowd, whose members are all connected."""
    schema, width = "a bigint, b bigint", groups.width
    held = groups.only(outside).members
    # A visitor's ``a`` tells whether it is in the crowd.
    named = outside.select(F.col("point").alias("id"), F.lit(0).cast("bigint").alias("out"))
    visitors = groups.members.join(named, "id", "left").withColumn("a", F.coalesce("out", F.lit(1).cast("bigint"))).drop("out")

    def start(held: _Held, alone: bool):
        many = len(held.ids)
        sets = _Sets(many + 1)  # the last one is the crowd

        def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, ids, inside = celltree.matrix(batch, width), batch["id"].to_numpy(), batch["a"].to_numpy() == 1
            at, reach, found = sets.add(len(ids)), held.reach(x, low), []
            mine = np.arange(at.start, at.stop)
            sets.label[mine[inside]] = sets.label[many]
            for k, part in enumerate(held.parts):
                theirs, matrix = np.arange(part.at.start, part.at.stop), None
                for crowded in (True, False):
                    some = np.flatnonzero(reach[:, k] & (inside == crowded))
                    which = np.flatnonzero(sets.label[theirs] != sets.label[many]) if crowded else np.arange(len(theirs))
                    if len(some) and len(which):
                        matrix = part.matrix() if matrix is None else matrix
                        _joined(sets, _near(x[some], matrix[which], low), mine[some], theirs[which], ids[some], held.ids[theirs[which]], found)
            sets.label = sets.label[:many + 1]  # a set is named by its first place, so visitors name none of the others
            return celltree.record(schema, *(np.concatenate([f[j] for f in found]) if found else np.empty(0, dtype=np.int64) for j in range(2)))

        return visit, None

    return _meet(groups, held, visitors, schema, start, few=True)


def _joined(sets: _Sets, near: np.ndarray, mine: np.ndarray, theirs: np.ndarray, ids: np.ndarray, names: np.ndarray, found: list) -> None:
    """Joins the sets of near pairs and appends the pairs that joined two. ``mine`` and ``theirs`` are the places of rows and columns."""
    for step in ("rows", "columns", "rest"):
        # A partner for each vector first: it leaves few pairs of different sets.
        if step == "rest":
            r, c = np.nonzero(near & (sets.label[mine][:, None] != sets.label[theirs][None, :]))
        elif step == "rows":
            r, c = np.arange(len(mine)), near.argmax(axis=1)
        else:
            r, c = near.argmax(axis=0), np.arange(len(theirs))
        hit = near[r, c]
        r, c = r[hit], c[hit]
        new = sets.join(mine[r], theirs[c])
        found.append((ids[r[new]], names[c[new]]))


def _all_edges(groups: Groups, eps: float) -> DataFrame:
    """The links of all vectors with each other.

    Vectors that a task knows to be connected are not compared again: the largest set of the held block is
    left out for its own members."""
    schema, width, low = "a bigint, b bigint", groups.width, round(1.0 - eps, _DIGITS)

    def start(held: _Held, alone: bool):
        sets, many = _Sets(len(held.ids)), len(held.ids)
        seen = 0

        def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal seen
            x, ids = celltree.matrix(batch, width), batch["id"].to_numpy()
            at = slice(seen, seen + len(ids)) if alone else sets.add(len(ids))
            seen += len(ids)
            reach, found = held.reach(x, low), []
            mine = np.arange(at.start, at.stop)
            of_crowd = (sets.label[:many] == np.bincount(sets.label[:many]).argmax()).argmax()
            for k, part in enumerate(held.parts):
                theirs, matrix = np.arange(part.at.start, part.at.stop), None
                for outside in (True, False):  # those outside of the crowd meet all, its members only the others
                    crowd = sets.label[of_crowd]
                    crowded = sets.label[theirs] == crowd
                    some = np.flatnonzero(reach[:, k] & ((sets.label[mine] != crowd) == outside))
                    which = np.arange(len(theirs)) if outside else np.flatnonzero(~crowded)
                    if not len(some) or not len(which):
                        continue
                    matrix = part.matrix() if matrix is None else matrix
                    near = _near(x[some], matrix[which], low)
                    _joined(sets, near, mine[some], theirs[which], ids[some], held.ids[theirs[which]], found)
            left, right = (np.concatenate([f[j] for f in found]) if found else np.empty(0, dtype=np.int64) for j in range(2))
            return celltree.record(schema, left, right)

        return visit, None

    return _meet(groups, groups.members, None, schema, start)


def lowest_core_label(groups: Groups, labels: DataFrame, eps: float) -> DataFrame:
    """(point, root): for points that are not core, the lowest label among their core neighbours.

    ``labels`` holds (point, root) of the core points."""
    schema, width, low = "point bigint, root bigint", groups.width, round(1.0 - eps, _DIGITS)
    named = labels.select(F.col("point").alias("id"), F.col("root").alias("label"))
    core = groups.members.join(named, "id").withColumn("a", F.col("label")).drop("label")
    border = groups.members.join(named, "id", "left_anti").withColumn("a", F.lit(0).cast("bigint"))  # not used there
    none = np.iinfo(np.int64).max

    def start(held: _Held, alone: bool):
        def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, ids = celltree.matrix(batch, width), batch["id"].to_numpy()
            best, reach = np.full(len(ids), none), held.reach(x, low)
            for k, part in enumerate(held.parts):
                label = held.a[part.at]
                some = np.flatnonzero(reach[:, k] & (best > label.min()))
                if len(some):
                    near = _near(x[some], part.matrix(), low)
                    best[some] = np.minimum(best[some], np.where(near, label[None, :], none).min(axis=1))
            return celltree.record(schema, ids[best < none], best[best < none])

        return visit, None

    return _meet(groups, core, border, schema, start).groupBy("point").agg(F.min("root").alias("root"))

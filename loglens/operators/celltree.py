"""Cells of vectors, and which of them a query has to visit.

Vectors are split into cells around pivots, and every cell of more than ``LEAF`` vectors is split again,
until all are small. A cell keeps three bounds on the product of a query with its vectors: the distance of its
farthest vector from the pivot (a ball), and for each dimension the largest and the least weight. A query
goes down from cell to cell and enters only those in which the lower of both bounds reaches the score that it
asks for, so cells without a chance are left before any product is formed.

Each step is a meeting: the few rows of a cell are held by a task, and the queries stream past them. Cells with
many queries are repeated over several tasks. Where only the leaves are wanted, the pivots go to the vectors instead,
so that no vector moves and each is written once (``place``). A vector is (id, a, idx, w): sparse with its dimensions in
``idx``, or dense with an empty one; ``a`` is a whole number that the caller needs later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.session import python_width, stage

#: Vectors of a cell that isn't split, pivots of one that is, queries of a cell for each task, and levels at most.
LEAF, FAN, VISITORS, DEEPEST = 4096, 32, 20_000, 24
#: Queries that meet a cell together.
TOGETHER = 1024
#: Bytes of pivots that ``place`` sends to every task; cells that would need more are split by meetings.
PIVOTS = 32 << 20
_SLACK = 1e-6
_VECTOR = "id bigint, a bigint, low double, idx array<int>, w array<double>"
_BOUND = "cell string, r double, hi array<double>, lo array<double>"


def matrix(batch: pa.RecordBatch, width: int | np.ndarray) -> np.ndarray:
    """The vectors of a batch, one in a row. ``width`` may be a scale for each dimension: then ``w`` holds
    counts, and a row is made of scaled counts and brought to length 1."""
    idx, w = batch["idx"], batch["w"]
    scale = width if isinstance(width, np.ndarray) else None
    out = np.zeros((batch.num_rows, max(width if scale is None else len(scale), 1)))
    lengths = np.diff(w.offsets.to_numpy())
    rows, flat = np.repeat(np.arange(batch.num_rows), lengths), w.flatten().to_numpy(zero_copy_only=False)
    if len(idx.flatten()):
        at = idx.flatten().to_numpy()
        if scale is not None:
            flat = flat * scale[at]
            flat = flat / np.sqrt(np.bincount(rows, flat * flat, batch.num_rows))[rows]
        out[rows, at] = flat
    else:
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def meet(held: DataFrame, visitors: DataFrame, schema: str, start: Callable, many: int | None = None) -> DataFrame:
    """Rows of ``visitors`` past the rows of ``held`` with the same ``cell``, in tasks.

    ``start(held rows)`` gives a function from a batch of visitors to a batch of the result, and one for the
    end, which may be None. ``many`` is the number of visitors if it is known."""
    spark = held.sparkSession
    width = python_width(spark)
    if (visitors.count() if many is None else many) > VISITORS:
        counts = stage(visitors.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("salts")), "salts")
        counts = F.broadcast(counts)  # a row for each cell
        visitors = visitors.join(counts, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
        held = held.join(counts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    else:
        visitors, held = visitors.withColumn("salt", F.lit(0)), held.withColumn("salt", F.lit(0))
    columns = {f.name: f.dataType for f in [*held.schema, *visitors.schema]}

    def filled(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()], F.lit(kind).alias("kind"))

    both = filled(held, 0).unionByName(filled(visitors, 1)).repartition(width, "cell", "salt")
    order = [c for c in ("cell", "salt", "kind", "id") if c in columns or c == "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, going = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, salts, kinds = (batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "salt", "kind"))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if (keys[a], salts[a]) != now:
                    if going and going[1]:
                        yield going[1]()
                    now, rows, going = (keys[a], salts[a]), [], None
                if not kinds[a]:
                    rows.append(batch.slice(a, b - a))
                elif rows or going:
                    if going is None:
                        going = start(pa.Table.from_batches(rows).combine_chunks().to_batches()[0])
                        rows = []
                    for c in range(a, b, TOGETHER):
                        yield going[0](batch.slice(c, min(TOGETHER, b - c)))
        if going and going[1]:
            yield going[1]()

    return both.sortWithinPartitions(*order).mapInArrow(run, schema)


def record(schema: str, *columns) -> pa.RecordBatch:
    """A batch of simple columns."""
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(),
             "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_()}
    named = [part.split(" ") for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for (_, k), c in zip(named, columns)], [n for n, _ in named])


@dataclass(frozen=True)
class Tree:
    #: (cell, id, a, idx, w): every vector with its leaf.
    leaves: DataFrame
    #: For each level (cell, child, inner, idx, w, r, hi, lo): the children of the cells that were split.
    levels: list[DataFrame]
    #: (cell, pieces): leaves that could not be split by distance are cut into equal pieces.
    pieces: DataFrame
    #: What ``matrix`` makes vectors of the leaves with.
    width: int | np.ndarray


def _extent(items: DataFrame, scale: np.ndarray | None) -> tuple[int | np.ndarray, int]:
    """What ``matrix`` makes vectors of the items with, and how many there are."""
    width, many = items.agg(
        F.coalesce(F.max(F.greatest(F.array_max("idx") + 1, F.size("w"))), F.lit(1)), F.count(F.lit(1))).first()
    return (int(width) if scale is None else scale), many


def build(items: DataFrame, leaf: int | None = None, scale: np.ndarray | None = None) -> Tree:
    """A tree over vectors (id, a, idx, w); a written table. With a ``scale``, ``w`` holds counts (see ``matrix``)."""
    leaf = leaf or LEAF
    width, many = _extent(items, scale)
    current = items.select(F.lit("").alias("cell"), "id", "a", F.lit(0.0).alias("low"), "idx", "w")
    raw: list[DataFrame] = []
    if many > leaf:
        counts = stage(current.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell_counts")
        current, raw = _split(current, counts, counts.where(F.col("n") > leaf).select("cell"), leaf, width, 0)
    pieces = stage(current.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("pieces")), "pieces")
    leaves = stage(_in_pieces(current, pieces), "leaves")
    levels = []
    for k, rows in enumerate(raw):
        split = raw[k + 1].select(F.col("cell").alias("child")).distinct() if k + 1 < len(raw) else rows.select("child").limit(0)
        levels.append(stage(rows.join(split.withColumn("inner", F.lit(True)), "child", "left").select(
            "cell", "child", F.coalesce("inner", F.lit(False)).alias("inner"), "idx", "w", "r", "hi", "lo"), "level"))
    return Tree(leaves, levels, pieces, width)


def _in_pieces(current: DataFrame, pieces: DataFrame) -> DataFrame:
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("string")
    return current.join(F.broadcast(pieces), "cell").select(F.concat("cell", F.lit("#"), piece).alias("cell"), "id", "a", "idx", "w")


def _chosen(members: DataFrame, depth: int) -> DataFrame:
    """The pivots of every cell among its members (cell, id, ..)."""
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(depth)), "id"))
    return members.withColumn("place", place).where(F.col("place") <= FAN).drop("place")


def _split(current: DataFrame, counts: DataFrame, big: DataFrame, leaf: int, width: int | np.ndarray, depth: int
           ) -> tuple[DataFrame, list[DataFrame]]:
    """``current`` with the ``big`` cells split until all are small, and the bounds of each level. Every level sends the
    vectors of its cells to meet the pivots. ``counts`` has the size of each cell, ``depth`` is the level of the big ones."""
    raw: list[DataFrame] = []
    while depth < DEEPEST and not big.isEmpty():
        # A row for each cell is broadcast, so vectors move only to meet the pivots.
        crowded = current.join(F.broadcast(big), "cell", "left_semi")
        small = current.join(F.broadcast(big), "cell", "left_anti")
        pivots = stage(_chosen(crowded, depth), "pivots")
        dealt = stage(_deal(pivots, crowded, width), "dealt")
        moved = dealt.where("r IS NULL").select("cell", "id", "a", "low", "idx", "w")
        raw.append(stage(_bounds(dealt.where("r IS NOT NULL"), pivots), "bounds"))
        current, depth = small.unionByName(moved), depth + 1  # of written tables
        parents = counts.select(F.col("cell").alias("parent"), F.col("n").alias("before"))
        counts = stage(current.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell_counts")
        # A cell whose vectors all went to one pivot can't be split by distance.
        grown = counts.withColumn("parent", F.regexp_replace("cell", "/[^/]*$", "")).join(parents, "parent")
        big = stage(grown.where((F.col("n") > leaf) & (F.col("n") < F.col("before"))).select("cell"), "big")
    return current, raw


def place(items: DataFrame, leaf: int | None = None, scale: np.ndarray | None = None) -> tuple[DataFrame, int | np.ndarray]:
    """The leaves of ``build`` (cell, id, a, idx, w) and its width, without the bounds of its cells.

    Vectors walk down the tree in the tasks that read them: a level writes only the ids and cells of what it has split,
    and ``items``, which should be a written table, is written once more, as leaves. Deep levels of large data, whose
    pivots together would take more than ``PIVOTS`` bytes, are split as ``build`` does it."""
    leaf = leaf or LEAF
    width, many = _extent(items, scale)
    walked = items.select(F.lit("").alias("cell"), "id", "a", F.lit(0.0).alias("low"), "idx", "w")
    held: list[pa.RecordBatch] = []
    narrow, before, size = walked.select("cell", "id"), {"": many} if many > leaf else {}, 0
    while before and len(held) < DEEPEST:
        ids = stage(_chosen(narrow.where(F.col("cell").isin(*before)), len(held)), "pivot_ids")
        pivots = stage(items.join(F.broadcast(ids), "id").select("cell", "id", "idx", "w"), "pivots")
        size += pivots.agg(F.sum(12 * F.size("w") + 64)).first()[0]
        if size > PIVOTS:
            break
        held.append(pa.Table.from_batches(pivots.toArrow().to_batches()).sort_by([("cell", "ascending"), ("id", "ascending")]).combine_chunks().to_batches()[0])
        walked = _walk(items, held, width)
        fresh = F.size(F.split("cell", "/")) == len(held) + 1
        narrow = stage(walked.where(fresh).select("cell", "id"), "dealt")
        grown = narrow.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf).collect()  # at most rows / leaf
        # A cell whose vectors all went to one pivot can't be split by distance.
        before = {r["cell"]: r["n"] for r in grown if r["n"] < before[r["cell"].rpartition("/")[0]]}
    whole = stage(walked, "leaves")
    if before and len(held) < DEEPEST:
        counts = stage(whole.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell_counts")
        whole, _ = _split(whole, counts, counts.where(F.col("cell").isin(*before)).select("cell"), leaf, width, len(held))
    pieces = stage(whole.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("pieces")), "pieces")
    return _in_pieces(whole, pieces), width


def _walk(items: DataFrame, held: list[pa.RecordBatch], width: int | np.ndarray) -> DataFrame:
    """(cell, id, a, low, idx, w): every vector with the cell that it reaches by the pivots ``held``, a batch for each level."""
    schema = f"cell string, {_VECTOR}"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[str, pa.RecordBatch] = {}
        for level in held:
            cells = np.array(level["cell"].to_pylist(), dtype=object)
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            pivots |= {cells[a]: level.slice(a, b - a) for a, b in zip(cuts, cuts[1:])}
        for whole in batches:
            for c in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(c, min(TOGETHER, whole.num_rows - c))
                x, ids, cell = matrix(batch, width), batch["id"].to_numpy(), np.full(batch.num_rows, "", dtype=object)
                todo = [("", np.arange(batch.num_rows))]
                while todo:
                    name, at = todo.pop()
                    cell[at] = name
                    if name in pivots:
                        home, _ = _home(x[at], ids[at], matrix(pivots[name], width), pivots[name]["id"].to_numpy())
                        todo += [(f"{name}/{k}", at[home == k]) for k in np.unique(home).tolist()]
                yield record(schema, cell.tolist(), *(batch[k] for k in ("id", "a", "low", "idx", "w")))

    return items.select("id", "a", F.lit(0.0).alias("low"), "idx", "w").mapInArrow(walk, schema)


def _home(x: np.ndarray, ids: np.ndarray, at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the pivots ``at`` for each vector, and its squared distance. A pivot is in its own cell."""
    square = (x * x).sum(axis=1)[:, None] + (at * at).sum(axis=1)[None, :] - 2 * (x @ at.T)
    square[names[None, :] == ids[:, None]] = -1.0
    home = square.argmin(axis=1)
    return home, square[np.arange(len(home)), home]


_DEALT = f"cell string, {_VECTOR}, r double, hi array<double>, lo array<double>"


def _deal(pivots: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Every row with its new cell, and rows with what a task knows of the bounds of a cell."""
    def start(held: pa.RecordBatch):
        at, cell, names = matrix(held, width), held["cell"][0].as_py(), held["id"].to_numpy()
        known: dict[int, list] = {}

        def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = matrix(batch, width)
            home, square = _home(x, batch["id"].to_numpy(), at, names)
            far = np.sqrt(np.maximum(square, 0.0))
            for k in np.unique(home).tolist():
                own = home == k
                r, hi, lo = far[own].max(), x[own].max(axis=0), x[own].min(axis=0)
                if k in known:
                    r, hi, lo = max(r, known[k][0]), np.maximum(hi, known[k][1]), np.minimum(lo, known[k][2])
                known[k] = [r, hi, lo]
            n, none = batch.num_rows, [None] * batch.num_rows
            return record(_DEALT, [f"{cell}/{k}" for k in home.tolist()], *(batch[c] for c in ("id", "a")), [0.0] * n,
                          batch["idx"], batch["w"], none, none, none)

        def end() -> pa.RecordBatch:
            ks = sorted(known)
            none = [None] * len(ks)
            return record(_DEALT, [f"{cell}/{k}" for k in ks], none, none, none, none, none, *[
                [known[k][j] if j == 0 else known[k][j].tolist() for k in ks] for j in range(3)])

        return deal, end

    return meet(pivots, rows, _DEALT, start)


def _bounds(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """(cell, child, idx, w, r, hi, lo) of the new cells, merged from what the tasks know."""
    def merge(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": part["cell"].iloc[:1], "r": [part["r"].max()], "hi": [np.vstack(part["hi"]).max(axis=0)],
                             "lo": [np.vstack(part["lo"]).min(axis=0)]})

    merged = rows.select("cell", "r", "hi", "lo").groupBy("cell").applyInPandas(merge, _BOUND)
    # The tasks number the pivots of a cell by id.
    order = F.row_number().over(Window.partitionBy("cell").orderBy("id")) - 1
    named = pivots.select("cell", F.concat("cell", F.lit("/"), order.cast("string")).alias("child"), "idx", "w")
    return merged.withColumnRenamed("cell", "child").join(named, "child").select("cell", "child", "idx", "w", "r", "hi", "lo")


_STEP = f"cell string, {_VECTOR}, inner boolean"


def visits(tree: Tree, queries: DataFrame, greedy: bool = False, scale: np.ndarray | None = None) -> DataFrame:
    """(cell, id, a, low, idx, w): the leaves in which a query (id, a, low, idx, w) may reach a product of ``low``; with
    ``greedy`` only the one that promises most. A written table. With a ``scale`` the queries hold counts."""
    width = tree.width
    asked = width if scale is None else scale

    def start(held: pa.RecordBatch):
        pivot, r = matrix(held, width), held["r"].to_numpy()
        hi, lo = (np.array(held[c].to_pylist(), dtype=float).reshape(held.num_rows, -1) for c in ("hi", "lo"))
        names, inner = np.array(held["child"].to_pylist(), dtype=object), held["inner"].to_numpy(zero_copy_only=False)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = matrix(batch, asked)
            ball = x @ pivot.T + np.sqrt((x * x).sum(axis=1))[:, None] * r[None, :]
            box = np.maximum(x, 0) @ hi.T + np.minimum(x, 0) @ lo.T
            most = np.minimum(ball, box)
            if greedy:
                at = (np.arange(len(x)), most.argmax(axis=1))
            else:
                at = np.nonzero(most >= batch["low"].to_numpy()[:, None] - _SLACK)
            taken = batch.take(pa.array(at[0]))
            return record(_STEP, names[at[1]].tolist(), *(taken[c] for c in ("id", "a", "low", "idx", "w")), pa.array(inner[at[1]]))

        return step, None

    named = queries.select(F.lit("").alias("cell"), "id", "a", "low", "idx", "w")
    found = []
    for bounds in tree.levels:
        stepped = stage(meet(bounds, named, _STEP, start), "visits")
        found.append(stepped.where("NOT inner").drop("inner"))
        named = stepped.where("inner").drop("inner")
    if not tree.levels:
        found = [named]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    cut = whole.join(tree.pieces, "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return stage(cut.select(F.concat("cell", F.lit("#"), F.col("piece").cast("string")).alias("cell"), "id", "a", "low", "idx", "w"), "visits")

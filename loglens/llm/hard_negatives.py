"""Hard negatives by inner product, with pruning on lengths and coordinates.

Vectors are cut into buckets by descending length. A search asks, for each query, for the first few
rows by score inside given intervals of scores. Its lowest interesting score turns into a bound on the
angle: against a bucket whose longest vector has length l, a row can only reach score t if its cosine
to the query q is at least t / (|q| l). So

* buckets in which no cosine is large enough are not visited;
* in a bucket, rows that are too short are cut off, as rows are in order of length;
* the angle bounds each coordinate of the row's direction. A bucket holds sorted lists of the
  values of every coordinate; for the query's largest coordinates, the focus, the feasible range of
  values is looked up there, and the candidates are what lies in all ranges that exclude enough;
* candidates are verified by their exact integer scores.

The bucket of the longest vectors is searched first; what it gives raises the lowest interesting scores.
A bucket is one task's memory; the queries stream past it. Two searches make the result: the
positives of every anchor, then negatives whose scores lie between 80 % and 100 % of a positive's.

Defined cases: rows with a null id, label or vector, with a null or non-finite component, or with one of
``LARGEST`` or more after scaling take no part; rows equal in id, label and vector count once; an anchor's
positives have another id than its own; missing components count as zero where vectors differ in length; with fewer
rows than asked for, all are returned; a negative positive score has no negatives; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.memory import claim
from loglens.session import stage

#: Every anchor's id is divisible by this; components are multiplied by ``SCALE`` and floored.
ANCHORS, SCALE = 100, 256
POSITIVES = NEGATIVES = 5
#: A negative's score is at least this many hundredths of the positive's.
LEAST_PART = 80
#: Rows of a bucket, about; queries that are verified together; the query's coordinates in focus.
BUCKET, TOGETHER, FOCUS = 4096, 256, 6
#: Magnitude of a scaled component from which a row takes no part, so that scores stay in 64 bits.
LARGEST = 1 << 24
#: A range of values is used if it leaves at most this share of the bucket.
_EXCLUDES = 0.5
_SLACK = 1e-9


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v, norm) of the rows that take part: whole numbers, changed labels, lengths."""
    whole = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    scaled = lambda x: F.floor(x.cast("double") * SCALE)
    fits = lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < LARGEST, F.lit(False))
    numbers = whole.where(F.forall("v", fits)).withColumn("v", F.transform("v", lambda x: scaled(x).cast("int")))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return numbers.select("vec_id", changed.cast("int").alias("label"), "v", F.sqrt(squares).alias("norm"))


def buckets(numbers: DataFrame) -> DataFrame:
    """Rows by descending length with ``part``, the number of their bucket. A written table."""
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal rows follow each other."""
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            now, keep = list(zip(*(batch.column(k).to_pylist() for k in range(3)))), []
            for row in now:
                keep.append(row != before)
                before = row
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([part] * kept.num_rows, pa.int32())], [*kept.schema.names, "part"])

    many = numbers.count()
    ranged = numbers.repartitionByRange(max(1, -(-many // BUCKET)), F.desc("norm"), "vec_id")
    return stage(ranged.sortWithinPartitions(F.desc("norm"), "vec_id", "label", "v").mapInArrow(
        once, "vec_id bigint, label int, v array<int>, norm double, part int"), "buckets")


def _matrix(column: pa.ListArray, wide: int | None = None) -> np.ndarray:
    """The vectors of a column, the short ones with zeros behind, ``wide`` columns."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    wide = int(max(lengths, default=0)) if wide is None else wide
    if len(lengths) and (lengths == wide).all():
        return flat.reshape(len(lengths), wide).astype(np.int64)
    out, at = np.zeros((len(lengths), wide), dtype=np.int64), 0
    for k, n in enumerate(lengths):
        out[k, : min(n, wide)] = flat[at : at + min(n, wide)]
        at += n
    return out


class Bucket:
    """Vectors in descending order of length, and the sorted lists of the coordinates of their directions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        self.ids, self.labels, self.vectors, self.norms = ids, labels, vectors, norms
        self.units = vectors / np.where(norms > 0, norms, 1)[:, None]
        self.order = np.argsort(self.units, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.units, self.order, axis=0)
        self.most = int(np.abs(vectors).max(initial=0))
        self.wide = vectors.shape[1]

    def reach(self, norm: float, low: int) -> int:
        """How many rows, from the longest on, are long enough for a score of ``low``."""
        if low <= 0:
            return len(self.ids)
        if norm == 0:
            return 0
        return int(np.searchsorted(-self.norms, -low / norm * (1 - _SLACK), side="right"))

    def feasible(self, unit: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose coordinates allow this cosine to a direction; None if the lists exclude little."""
        angle = np.arccos(min(cosine, 1.0))
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            off = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, off + angle)) - _SLACK, np.cos(max(0.0, off - angle)) + _SLACK
            a = np.searchsorted(self.lists[:, f], low, side="left")
            b = np.searchsorted(self.lists[:, f], high, side="right")
            if b - a <= _EXCLUDES * len(self.ids):
                ranges.append((b - a, a, b, f, low, high))
        if not ranges:
            return None
        ranges.sort()
        _, a, b, f, *_ = ranges[0]
        found = self.order[a:b, f]
        for _, _, _, f, low, high in ranges[1:]:
            values = self.units[found, f]
            found = found[(values >= low) & (values <= high)]
        return found

    def scores(self, rows: slice | np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Exact scores of some rows (down) with some queries (across)."""
        largest = self.most * int(np.abs(queries).max(initial=0)) * max(1, self.wide)
        kind = np.float64 if largest < 1 << 53 else np.int64  # the first is faster and exact as well
        return (self.vectors[rows].astype(kind) @ queries.T.astype(kind)).astype(np.int64)

    def search(self, vectors: np.ndarray, norms: np.ndarray, lows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores) for a few queries and their lowest interesting scores."""
        together: list[tuple[int, int]] = []
        for k, low in enumerate(lows.tolist()):
            reach = self.reach(norms[k], low)
            if not reach:
                continue
            cosine = low / (norms[k] * self.norms[0]) * (1 - _SLACK) if low > 0 else 0.0
            found = self.feasible(vectors[k] / norms[k], cosine) if 0 < cosine else None
            if found is None:
                together.append((k, reach))
            else:
                found = found[found < reach]
                if len(found):
                    yield k, found, self.scores(found, vectors[k : k + 1])[:, 0]
        if together:
            upto = max(reach for _, reach in together)
            every = self.scores(slice(upto), vectors[[k for k, _ in together]])
            for at, (k, reach) in enumerate(together):
                yield k, np.arange(reach), every[:reach, at]


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, smaller ids first among equal ones."""
    places = np.arange(len(ids))
    if len(ids) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(ids) - k)[len(ids) - k])
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _visits(rows: DataFrame, lengths: DataFrame, queries: DataFrame, wanted: DataFrame, k: int, same: bool, parts: int) -> DataFrame:
    """(q, slot, vec_id, score): for every bucket, query and slot the first ``k`` rows in the interval."""
    slots = wanted.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("slots"))
    asked = queries.join(slots, "q").withColumn("lowest", F.array_min(F.transform("slots", lambda s: s["low"])))
    # Stated queries against all buckets, but for those that are too short.
    sent = asked.join(F.broadcast(lengths), F.expr("lowest <= 0 OR lowest <= norm * longest * (1 + 1e-9)"))
    columns = ["part", "kind", "q", "vec_id", "label", "v", "norm", "lowest", "slots"]
    both = rows.select("part", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("q"), "vec_id", "label", "v", "norm",
                       F.lit(0).cast("bigint").alias("lowest"), F.array().cast("array<struct<slot:int,low:bigint,high:bigint>>").alias("slots"),
                       ).unionByName(sent.withColumn("kind", F.lit(1)).select(*columns))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("negatives")
        part, held, bucket = None, [], None
        for batch in batches:
            at, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                if a == b:
                    continue
                if at[a] != part:
                    part, held, bucket = at[a], [], None
                if not kinds[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if bucket is None:
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    bucket, held = Bucket(table["vec_id"].to_numpy(), table["label"].to_numpy(), _matrix(table["v"]), table["norm"].to_numpy()), []
                for c in range(a, b, TOGETHER):
                    yield answered(bucket, batch.slice(c, min(TOGETHER, b - c)))

    def answered(bucket: Bucket, some: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, names = some["vec_id"].to_numpy(), some["label"].to_numpy(), some["q"].to_numpy()
        asked, out = some["slots"].to_pylist(), [[], [], [], []]
        for j, found, scores in bucket.search(_matrix(some["v"], bucket.wide), some["norm"].to_numpy(), some["lowest"].to_numpy()):
            alike = bucket.labels[found] == labels[j]
            open_ = (alike & (bucket.ids[found] != ids[j]) if same else ~alike) & (scores >= some["lowest"][j].as_py())
            found, scores = found[open_], scores[open_]
            for slot in asked[j]:
                inside = np.flatnonzero((scores >= slot["low"]) & (scores <= slot["high"]))
                inside = inside[_first(bucket.ids[found[inside]], scores[inside], k)]
                for column, values in zip(out, ([names[j]] * len(inside), [slot["slot"]] * len(inside), bucket.ids[found[inside]], scores[inside])):
                    column.extend(values)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["q", "slot", "vec_id", "score"])

    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", F.desc("norm"))
    return dealt.mapInArrow(visit, "q bigint, slot int, vec_id bigint, score bigint")


def first_in_intervals(rows: DataFrame, queries: DataFrame, wanted: DataFrame, k: int, same: bool) -> DataFrame:
    """(q, slot, rank, vec_id, score): the first ``k`` rows for each interval of ``wanted`` (q, slot, low, high).

    ``rows`` are buckets, ``queries`` (q, vec_id, label, v, norm); ``same`` asks for rows of the query's label
    and another id, otherwise for rows of another label."""
    # One row for each bucket of some thousand vectors.
    lengths = stage(rows.groupBy("part").agg(F.max("norm").alias("longest")), "lengths")
    parts = (lengths.agg(F.max("part")).first()[0] or 0) + 1
    longest = lengths.where("part = 0")
    seeds = _ranked(_visits(rows.where("part = 0"), longest, queries, wanted, k, same, 1)).where(F.col("rank") == k).select(
        "q", "slot", F.col("score").alias("reached"))
    raised = stage(wanted.join(seeds, ["q", "slot"], "left").select(
        "q", "slot", F.greatest("low", "reached").alias("low"), "high"), "wanted")
    return _ranked(_visits(rows, lengths, queries, raised, k, same, parts)).where(F.col("rank") <= k)


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("q", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order))


def mined(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    held = buckets(quantised(rows, vec_id, vector, label))
    anchors = stage(held.where(F.col("vec_id") % ANCHORS == 0).select(
        F.monotonically_increasing_id().alias("q"), "vec_id", "label", "v", "norm"), "anchors")
    all_scores = anchors.select("q", F.lit(0).alias("slot"), F.lit(-(1 << 63)).alias("low"), F.lit((1 << 63) - 1).alias("high"))
    positives = stage(first_in_intervals(held, anchors, all_scores, POSITIVES, True), "positives")
    intervals = positives.where("score >= 0").select(
        "q", F.col("rank").alias("slot"), F.expr(f"({LEAST_PART} * score + 99) div 100").alias("low"), F.col("score").alias("high"))
    negatives = first_in_intervals(held, anchors, intervals, NEGATIVES, False)
    named = positives.select("q", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(named, ["q", "slot"]).join(anchors.select("q", F.col("vec_id").alias("anchor_id")), "q").select(
        "anchor_id", "positive_id", F.col("rank").cast("bigint").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % {ANCHORS} = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND {LEAST_PART} * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= {NEGATIVES}
"""

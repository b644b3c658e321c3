"""Density clustering over cosine distance, its statistics and its silhouette."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions.values import reduction_pct
from loglens.operators import celltree, neighbours, vectors
from loglens.operators.joins import hot_keys, spread_join
from loglens.operators.ranking import dense_ids
from loglens.schemas import NOISE
from loglens.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(point, root) for every point with an edge, root being the smallest point reached.

    Each round moves every vertex to its least neighbour, follows that pointer once more and
    contracts the edges. "Least" is by id in the first round, which finishes stars at once,
    and by a hash from then on, so that a long chain shrinks by a constant factor per round.
    Every round writes its moves and its remaining edges; no lineage builds up. The joins have one
    row per key on one side and nothing behind them that needs their keys together, so the planner
    can split a crowded vertex.
    """
    live = stage(edges.where("a <> b").select("a", "b"), "edges")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        by_id = not moves

        def ranked(column: str, by_id: bool = by_id) -> Column:
            key = F.col(column) if by_id else F.xxhash64(column)
            return F.struct(key.alias("key"), F.col(column).alias("to"))

        near = both.groupBy("a").agg(F.min(ranked("b")).alias("near"))
        step = near.select(F.col("a").alias("v"), F.least("near", ranked("a"))["to"].alias("to"))
        ahead = step.select(F.col("v").alias("to"), F.col("to").alias("next"))
        jump = stage(step.join(ahead, "to").select("v", F.col("next").alias("to")), "moves")
        moves.append(jump)
        left = live.join(jump.select(F.col("v").alias("a"), F.col("to").alias("a2")), "a")
        right = left.join(jump.select(F.col("v").alias("b"), F.col("to").alias("b2")), "b")
        live = stage(
            right.where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(),
            "edges",
        )
    if not moves:
        return edges.select(F.col("a").alias("point"), F.col("b").alias("root")).limit(0)
    labels = moves[0].select(F.col("v").alias("point"), F.col("to").alias("rep"))
    for jump in moves[1:]:
        moved = labels.join(jump.select(F.col("v").alias("rep"), "to"), "rep", "left")
        labels = moved.select("point", F.coalesce("to", "rep").alias("rep"))
    roots = labels.groupBy("rep").agg(F.min("point").alias("root"))
    return labels.join(roots, "rep").select("point", "root")


def dbscan(points: DataFrame, groups: neighbours.Groups, eps: float, min_samples: int = 2) -> DataFrame:
    """(point, copies, cluster_id) for every point; -1 is noise, ids follow the first core row.

    A point is core if it, its copies and its neighbours make ``min_samples`` rows. Only
    vectors of non-zero length appear in ``groups``; a zero vector is noise whatever its copies.
    With ``min_samples <= 2`` any point with a neighbour is core, so counting is skipped.
    """
    if min_samples <= 2:
        core_groups = groups
        alone = groups.points.where(F.col("copies") >= min_samples).select("point", F.col("point").alias("root"))
    else:
        core = stage(neighbours.core_points(groups, eps, min_samples), "core")
        core_groups = groups.only(core)
        alone = core.select("point", F.col("point").alias("root"))
    linked = connected_components(neighbours.component_edges(core_groups, eps))
    roots = stage(
        alone.unionByName(linked).groupBy("point").agg(F.min("root").alias("root")), "roots"
    )
    if min_samples > 2:
        roots = stage(roots.unionByName(neighbours.lowest_core_label(groups, roots, eps)), "roots")
    numbered = dense_ids(roots, "root", "cluster_id")
    crowded = hot_keys(numbered, ["root"], "n")
    placed_roots = spread_join(roots, numbered, ["root"], by="point", hot=crowded).select("point", "cluster_id")
    return points.select("point", "copies").join(placed_roots, "point", "left").select(
        "point", "copies", F.coalesce(F.col("cluster_id").cast("int"), F.lit(NOISE)).alias("cluster_id")
    )


def cluster_texts(rows: DataFrame, row_id: str, text: str, eps: float = 0.5, min_samples: int = 2
                  ) -> tuple[DataFrame, DataFrame, vectors.TextVectors]:
    """Cluster rows by the TF-IDF vector of a text column; ``row_id`` is a key.

    Returns the rows with ``cluster_id``, the clustered points and the vectors."""
    model = vectors.tfidf(rows, row_id, text)
    found = stage(dbscan(model.points, neighbours.model_groups(model, eps), eps, min_samples), "clusters")
    ids = found.select("point", "cluster_id")
    by_row = spread_join(model.members, ids, ["point"], by="doc", hot=model.hot_points.select("point"))
    return rows.join(by_row.select(F.col("doc").alias(row_id), "cluster_id"), row_id), found, model


def cluster_vectors(rows: DataFrame, row_id: str, vector: str, eps: float = 0.4, min_samples: int = 2
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cluster rows by a dense vector column. Returns (row id, cluster_id), points, unit vectors."""
    points = stage(vectors.unit_vectors(rows, row_id, vector), "vectors")
    nonzero = points.where(F.exists("vec", lambda x: x != 0))
    found = stage(dbscan(points, neighbours.dense_groups(nonzero, eps), eps, min_samples), "clusters")
    keyed = vectors.unit_rows(rows, row_id, vector)
    by_vector = points.select("vec", "point").join(found.select("point", "cluster_id"), "point")
    joined = spread_join(
        keyed, by_vector.select("vec", "cluster_id"), ["vec"], by=row_id, hot=hot_keys(points, ["vec"], "copies"))
    return joined.drop("vec"), found, points


def _centres(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """Means of the clusters as vectors (id, a, idx, w); ``a`` is the cluster as well."""
    mean = sums.join(sizes, "cluster_id").select("cluster_id", "idx", (F.col("s") / F.col("size")).alias("w"))
    return mean.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("e")).select(
        F.col("cluster_id").cast("bigint").alias("id"), F.col("cluster_id").cast("bigint").alias("a"),
        F.col("e.idx").alias("idx"), F.col("e.w").alias("w"))


def _best_centre(tree: celltree.Tree, places: DataFrame, scale: np.ndarray | None) -> DataFrame:
    """(point, best): the largest product of a point with the mean of a cluster other than its own."""
    schema, width, asked = "point bigint, best double", tree.width, tree.width if scale is None else scale

    def start(held: pa.RecordBatch):
        centres, names = celltree.matrix(held, width), held["id"].to_numpy()

        def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
            products = celltree.matrix(batch, asked) @ centres.T
            products[batch["a"].to_numpy()[:, None] == names[None, :]] = -np.inf
            best = products.max(axis=1)
            known = np.isfinite(best)
            return celltree.record(schema, batch["id"].to_numpy()[known], best[known])

        return visit, None

    return celltree.meet(tree.leaves, places, schema, start).groupBy("point").agg(F.max("best").alias("best"))


def nearest_other(points: DataFrame, centres: DataFrame, width: int, scale: np.ndarray | None) -> DataFrame:
    """(point, best) for vectors (id, a, idx, w), ``a`` being the cluster. The means of the clusters are kept in a
    tree; a point goes to the most promising leaf first, and then only where more than what it found there can be."""
    tree = replace(celltree.build(centres), width=width)
    if not tree.levels:
        return _best_centre(tree, celltree.visits(tree, points.withColumn("low", F.lit(float("-inf"))), scale=scale), scale)
    asked = points.withColumn("low", F.lit(0.0))
    seeds = stage(_best_centre(tree, celltree.visits(tree, asked, greedy=True, scale=scale), scale), "seeds")
    raised = points.join(seeds.select(F.col("point").alias("id"), "best"), "id", "left").withColumn(
        "low", F.coalesce("best", F.lit(float("-inf")))).drop("best")
    return _best_centre(tree, celltree.visits(tree, raised, scale=scale), scale)


def _own_products(points: DataFrame, centres: DataFrame, width: int, scale: np.ndarray | None) -> DataFrame:
    """(point, mean): the product of a point with the mean of its own cluster."""
    schema = "point bigint, mean double"

    def start(held: pa.RecordBatch):
        centre = celltree.matrix(held, width)[0]

        def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
            return celltree.record(schema, batch["id"], celltree.matrix(batch, width if scale is None else scale) @ centre)

        return visit, None

    cell = F.col("a").cast("string").alias("cell")
    return celltree.meet(centres.select(cell, "id", "a", "idx", "w"), points.select(cell, "id", "a", "idx", "w"), schema, start)


def silhouette(found: DataFrame, weights: DataFrame, model: vectors.TextVectors | None = None) -> DataFrame:
    """One row: mean cosine silhouette of clustered rows, noise left out; 0 unless there are two
    clusters and two rows. Distances to a cluster come from the mean of its vectors, and the nearest
    other cluster from a search over the clusters' means, so neither pairs of points nor all pairs of
    a point and a cluster are formed. With the ``model`` of the weights, points travel as counts."""
    kept = stage(found.where(F.col("cluster_id") != NOISE).select("point", "copies", "cluster_id"), "clustered")
    if model is None:
        own = weights.join(kept, "point")
        packed = own.groupBy("point").agg(
            F.max("cluster_id").cast("bigint").alias("a"), F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("e")).select(
            F.col("point").alias("id"), "a", F.col("e.idx").alias("idx"), F.col("e.w").alias("w"))
    else:
        counted = stage(model.vectors.drop("copies").where(F.size("idx") > 0).join(kept, "point"), "clustered_counts")
        own = model.unit(counted).select("copies", "cluster_id", F.inline("unit"))
        packed = counted.select(F.col("point").alias("id"), F.col("cluster_id").cast("bigint").alias("a"), "idx",
                                F.col("tf").cast("array<double>").alias("w"))
    scale = None if model is None else model.scale
    sums = own.groupBy("cluster_id", "idx").agg(F.sum(F.col("w") * F.col("copies")).alias("s"))
    sizes = stage(kept.groupBy("cluster_id").agg(F.sum("copies").alias("size")), "sizes")
    k = sizes.agg(F.count(F.lit(1))).scalar()
    packed = stage(packed, "clustered_vectors")
    centres = stage(_centres(sums, sizes), "centres")
    width = int(centres.agg(F.coalesce(F.max(F.array_max("idx")) + 1, F.lit(1))).first()[0]) if scale is None else max(len(scale), 1)
    dots = _own_products(packed, centres, width, scale)
    best = nearest_other(packed, centres, width, scale)
    sized = spread_join(kept, sizes, ["cluster_id"], by="point", salts=8)
    per_point = sized.join(dots, "point").join(best, "point", "left")
    a = F.col("size") * (1 - F.col("mean")) / F.nullif(F.col("size") - 1, F.lit(0))
    b = 1 - F.col("best")
    value = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)))
    mean = F.sum(value * F.col("copies")) / F.nullif(F.sum("copies"), F.lit(0))
    rows = F.sum("copies")
    return per_point.withColumn("k", k).agg(
        F.when((rows > 1) & (F.max("k") > 1), F.round(mean, 9)).otherwise(F.lit(0.0)).alias("silhouette")
    ).select(F.coalesce("silhouette", F.lit(0.0)).alias("silhouette"))


def cluster_statistics(alerts: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Rows, clusters, noise, groups and percentage reduction."""
    c = F.col(cluster)
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.when(c >= 0, c)).alias("clusters"),
        F.count_if(c == NOISE).alias("unique_rows"),
    ).select(
        "*",
        (F.col("clusters") + F.col("unique_rows")).alias("distinct_groups"),
        reduction_pct(F.col("clusters") + F.col("unique_rows"), F.col("total")).alias("noise_reduction_pct"),
    )


def compare_methods(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two one-row method summaries (method, clusters, unique_rows, distinct_groups,
    noise_reduction_pct, silhouette) under each other, with the winner by silhouette; a tie
    goes to the first."""
    a, b = first.select("silhouette").scalar(), second.select("silhouette").scalar()
    return first.withColumn("winner", a >= b).unionByName(second.withColumn("winner", b > a))

"""Isolation forest: trees are fitted in parallel, one group per tree, and scoring is a
vectorised pass over the windows. The model is a table of at most trees x (2 psi - 1) rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.session import python_width

TREES = 200
SAMPLE = 256
SEED = 42
MODEL_SCHEMA = (
    "tree int, node int, feature string, threshold double, left int, right int, size int, depth int, psi int"
)
_CELLS = 4_000_000  # dense cells held at once while scoring


def tree_samples(ids: DataFrame, rows: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(tree, window_id): ``sample`` windows per tree without replacement.

    A hash below a threshold pre-selects about twice the need, so only those few are ranked;
    the choice depends on ids and seed alone, never on partitioning or retries.
    """
    span = 1 << 31
    limit = span if rows <= 2 * sample else int(span * 2.0 * sample / rows)
    draw = F.pmod(F.xxhash64("window_id", "tree", F.lit(seed)), F.lit(span))
    candidates = (
        ids.select("window_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        .withColumn("draw", draw).where(F.col("draw") < limit)
    )
    place = F.row_number().over(Window.partitionBy("tree").orderBy("draw", "window_id"))
    return candidates.withColumn("place", place).where(F.col("place") <= sample).select("tree", "window_id")


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, names: list[str], tree: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng([seed, tree])
    psi = len(x)
    deepest = math.ceil(math.log2(max(psi, 2)))
    nodes, todo, made = [], [(0, 0, np.arange(psi))], 1
    while todo:
        node, depth, rows = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth == deepest or len(rows) <= 1 or len(open_features) == 0:
            nodes.append((tree, node, None, None, None, None, len(rows), depth, psi))
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = part[:, f] <= cut
        left, right = made, made + 1
        made += 2
        nodes.append((tree, node, names[f], cut, left, right, len(rows), depth, psi))
        todo += [(left, depth + 1, rows[goes_left]), (right, depth + 1, rows[~goes_left])]
    columns = [part.split()[0] for part in MODEL_SCHEMA.split(", ")]
    return pd.DataFrame(nodes, columns=columns)


def fit_isolation_forest(features: DataFrame, ids: DataFrame, trees: int = TREES, sample: int = SAMPLE,
                         seed: int = SEED) -> DataFrame:
    """Fit on long features (window_id, feature, x; absent = 0). ``ids`` lists all windows."""
    picked = tree_samples(ids, ids.count(), trees, sample, seed)
    # At most trees x sample rows.
    rows = features.join(F.broadcast(picked), "window_id").select("tree", "window_id", "feature", "x")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        at, windows = pd.factorize(part["window_id"], sort=True)
        on, names = pd.factorize(part["feature"], sort=True)
        x = np.zeros((len(windows), len(names)))
        x[at, on] = part["x"].to_numpy()
        return _grow(x, list(names), int(part["tree"].iat[0]), seed)

    spread = rows.repartition(python_width(features.sparkSession), "tree")
    return spread.groupBy("tree").applyInPandas(fit, MODEL_SCHEMA)


def tree_facts(model: DataFrame) -> DataFrame:
    """(tree, psi, leaf_rows, bounded, binary_tree): the sample of each tree, the rows in its leaves,
    whether it is no deeper than allowed, and whether every node has two children or none."""
    leaf = F.col("feature").isNull()
    return model.groupBy("tree").agg(
        F.max("psi").cast("bigint").alias("psi"), F.sum(F.when(leaf, F.col("size")).otherwise(0)).alias("leaf_rows"),
        (F.max("depth") <= F.max(F.ceil(F.log2(F.greatest("psi", F.lit(2)))))).alias("bounded"),
        (F.count(F.lit(1)) == 2 * F.count_if(leaf) - 1).alias("binary_tree"))


def score_windows(features: DataFrame, model: DataFrame) -> DataFrame:
    """(window_id, anomaly_score in (0, 1]): 2 ^ (-mean path / expected path)."""
    table = model.toPandas().sort_values(["tree", "node"])  # bounded, see the module comment
    names = sorted(table["feature"].dropna().unique())
    place = {name: i for i, name in enumerate(names)}
    expected = float(average_path(np.array([table["psi"].max()]))[0]) or 1.0
    trees = []
    for _, t in table.groupby("tree", sort=True):
        inner = t["feature"].notna().to_numpy()
        trees.append((
            np.where(inner, t["feature"].map(place).fillna(0), 0).astype(int),
            t["threshold"].fillna(0).to_numpy(float),
            np.where(inner, t["left"].fillna(0), t["node"]).astype(int),
            np.where(inner, t["right"].fillna(0), t["node"]).astype(int),
            t["depth"].to_numpy(float) + average_path(t["size"].to_numpy()),
            int(t["depth"].max()),
        ))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, _CELLS // max(1, len(names)))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start:start + step]
                x = np.zeros((len(part), max(1, len(names))))
                rows = np.repeat(np.arange(len(part)), part["places"].map(len))
                x[rows, np.concatenate(part["places"].to_list())] = np.concatenate(part["xs"].to_list())
                each, total = np.arange(len(part)), np.zeros(len(part))
                for feature, cut, left, right, path, deepest in trees:
                    at = np.zeros(len(part), dtype=int)
                    for _ in range(deepest):
                        at = np.where(x[each, feature[at]] <= cut[at], left[at], right[at])
                    total += path[at]
                yield pd.DataFrame({
                    "window_id": part["window_id"].to_numpy(),
                    "anomaly_score": 2.0 ** (-(total / len(trees)) / expected),
                })

    # One row per feature of the model, which is bounded; a window has at most one cell for each.
    known = model.sparkSession.createDataFrame(list(place.items()), "feature string, place int")
    used = features.join(F.broadcast(known), "feature").groupBy("window_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "x"))).alias("cells"))
    cells = features.select("window_id").distinct().join(used, "window_id", "left").select(
        "window_id", F.coalesce("cells.place", F.array().cast("array<int>")).alias("places"),
        F.coalesce("cells.x", F.array().cast("array<double>")).alias("xs"))
    return cells.mapInPandas(score, "window_id bigint, anomaly_score double")


def score_external(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """Score vectors that are no windows, given as (name, feature, x)."""
    names = vectors.select("name").distinct().withColumn("window_id", F.xxhash64("name"))
    scored = score_windows(vectors.withColumn("window_id", F.xxhash64("name")), model)
    return names.join(scored, "window_id").select("name", "anomaly_score")


def class_medians(features: DataFrame, meta: DataFrame, truth: int = 0) -> DataFrame:
    """(feature, median) over the windows of one class, absent rows counting as 0."""
    members = meta.where(F.col("is_anomaly") == truth).select("window_id")
    total = members.agg(F.count(F.lit(1))).scalar()
    present = features.join(members, "window_id").select("feature", "x", F.lit(1).cast("bigint").alias("rows"))
    zeros = (
        features.select("feature").distinct()
        .join(present.groupBy("feature").agg(F.sum("rows").alias("seen")), "feature", "left")
        .select("feature", F.lit(0.0).alias("x"), (total - F.coalesce("seen", F.lit(0))).alias("rows"))
        .where("rows > 0")
    )
    return present.unionByName(zeros).groupBy("feature").agg(
        F.percentile("x", F.lit(0.5), F.col("rows")).alias("median")
    )


def probe_vectors(features: DataFrame, meta: DataFrame, stats: DataFrame) -> DataFrame:
    """Two vectors a good model must tell apart: the median normal window, and one three
    deviations above the mean in every feature."""
    normal = class_medians(features, meta, 0).select(
        F.lit("median_normal").alias("name"), "feature", F.col("median").alias("x"))
    extreme = stats.select(
        F.lit("extreme").alias("name"), "feature", (F.col("mean") + 3 * (F.col("std") + 1e-8)).alias("x"))
    return normal.unionByName(extreme)

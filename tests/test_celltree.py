"""The tree of cells: nothing in reach is left out, and little else is visited."""

import numpy as np
import pytest

from loglens.operators import celltree, cluster, neighbours
from loglens.session import stage

SCHEMA = "id bigint, a bigint, idx array<int>, w array<double>"


def rows_of(x, sparse):
    out = []
    for i, row in enumerate(x):
        at = np.flatnonzero(row) if sparse else range(len(row))
        out.append((i, i, [int(k) for k in at] if sparse else [], [float(row[k]) for k in at]))
    return out


def topics(n, each, words, rng):
    """Unit vectors of texts on ``n // each`` topics; a topic has a few words, and every word is in many topics."""
    x = np.zeros((n, words))
    for i in range(n):
        mine = np.random.default_rng(i // each).choice(words, 12, replace=False)
        x[i, mine] = 1 + 0.3 * rng.random(12)
        x[i, rng.integers(words)] += 0.3
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("sparse", [True, False])
@pytest.mark.parametrize("unit", [True, False])
def test_visits_leave_out_nothing(spark, monkeypatch, sparse, unit):
    monkeypatch.setattr(celltree, "LEAF", 16)
    monkeypatch.setattr(celltree, "VISITORS", 100)
    rng = np.random.default_rng(2)
    x = topics(300, 15, 60, rng) if sparse else rng.normal(size=(300, 6)) + rng.normal(size=(10, 6))[rng.integers(10, size=300)] * 3
    if unit:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    else:
        x = x * rng.choice([0.2, 1.0, 3.0], size=(300, 1))
    items = spark.createDataFrame(rows_of(x, sparse), SCHEMA)
    tree = celltree.build(items)
    leaf = {r.id: r.cell for r in tree.leaves.collect()}
    assert len(leaf) == 300 and len(set(leaf.values())) > 10 and tree.levels
    products = x @ x.T
    lows = np.quantile(products, 0.97, axis=1)
    queries = spark.createDataFrame([(*r, float(low)) for r, low in zip(rows_of(x, sparse), lows)], SCHEMA + ", low double")
    seen = {}
    for r in celltree.visits(tree, queries).collect():
        seen.setdefault(r.id, set()).add(r.cell)
    for i in range(300):
        assert {leaf[j] for j in np.flatnonzero(products[i] >= lows[i])} <= seen[i]
    greedy = celltree.visits(tree, queries, greedy=True).collect()
    assert sorted({r.id for r in greedy}) == list(range(300))


def test_equal_vectors_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(celltree, "LEAF", 10)
    x = np.ones((100, 3))
    tree = celltree.build(spark.createDataFrame(rows_of(x, False), SCHEMA))
    sizes = [r["count"] for r in tree.leaves.groupBy("cell").count().collect()]
    assert sum(sizes) == 100 and max(sizes) < 40
    queries = spark.createDataFrame([(7, 0, [], [1.0, 0.0, 0.0], 1.0)], SCHEMA + ", low double")
    assert len({r.cell for r in celltree.visits(tree, queries).collect()}) == len(sizes)


@pytest.mark.parametrize("pivots", [32 << 20, 30_000])
def test_placing_gives_the_leaves_of_the_tree(spark, monkeypatch, pivots):
    """Also where the pivots of deep levels are too many to be sent; else no vector is sent to meet them."""
    monkeypatch.setattr(celltree, "LEAF", 16)
    monkeypatch.setattr(celltree, "PIVOTS", pivots)
    items = stage(spark.createDataFrame(rows_of(topics(900, 30, 80, np.random.default_rng(7)), True), SCHEMA), "items")
    want = {r.id: r.cell for r in celltree.build(items).leaves.collect()}
    met, meet = [], celltree.meet
    monkeypatch.setattr(celltree, "meet", lambda *a, **b: met.append(1) or meet(*a, **b))
    leaves, width = celltree.place(items)
    assert {r.id: r.cell for r in leaves.collect()} == want and width == 80
    assert bool(met) == (pivots < 32 << 20) and max(c.count("/") for c in want.values()) > 1


def test_pairs_grow_with_near_pairs(spark, monkeypatch):
    """Texts of common words: four times the texts on four times the topics take little over four times the products."""
    monkeypatch.setattr(celltree, "LEAF", 40)
    work = {}
    for n in (1000, 4000):
        x = topics(n, 25, 300, np.random.default_rng(3))
        rows = spark.createDataFrame(rows_of(x, True), SCHEMA)
        weights = rows.selectExpr("id AS point", "inline(arrays_zip(idx, w))")
        groups = neighbours.text_groups(weights, rows.selectExpr("id AS point", "1L AS copies"), 0.3)
        work[n] = groups.pairs_computed()
        near = (np.round(x @ x.T, 9) >= 0.7).sum() - n
        assert sum(r.near for r in neighbours.neighbour_counts(groups, 0.3).collect()) == near
    assert work[4000] < 7 * work[1000] and work[4000] < 0.2 * 4000**2


def test_dense_vectors_visit_few_cells(spark, monkeypatch):
    monkeypatch.setattr(celltree, "LEAF", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(60, size=3000)] + 0.25 * rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, 1, [float(v) for v in row]) for i, row in enumerate(x)], "point bigint, copies bigint, vec array<double>")
    groups = neighbours.dense_groups(points, 0.4)
    cells = groups.members.select("cell").distinct().count()
    assert groups.members.groupBy("cell").count().agg({"count": "max"}).first()[0] <= 50
    visited = groups.visits.count() / (3000 * cells)
    assert visited < 0.25
    assert sum(r.near for r in neighbours.neighbour_counts(groups, 0.4).collect()) == (np.round(x @ x.T, 9) >= 0.6).sum() - 3000


def test_silhouette_with_many_clusters(spark, monkeypatch):
    """The textbook's value, and far fewer visits than points times clusters."""
    monkeypatch.setattr(celltree, "LEAF", 8)
    x = topics(900, 10, 200, np.random.default_rng(5))
    label = np.arange(900) // 10
    label[-30:] = -1
    weights = spark.createDataFrame(rows_of(x, True), SCHEMA).selectExpr("id AS point", "inline(arrays_zip(idx, w))")
    found = spark.createDataFrame([(i, 1, int(c)) for i, c in enumerate(label)], "point bigint, copies bigint, cluster_id int")
    got = cluster.silhouette(found, weights).first().silhouette
    kept = label >= 0
    far, own = 1 - x[kept] @ x[kept].T, label[kept]
    values = []
    for i, c in enumerate(own):
        a = far[i][own == c].sum() / ((own == c).sum() - 1)
        b = min(far[i][own == k].mean() for k in set(own) - {c})
        values.append((b - a) / max(a, b))
    assert abs(got - np.mean(values)) < 1e-8


def test_spread_vectors_are_sent_once_for_each_block(spark, monkeypatch):
    """Bounds exclude nothing among evenly spread vectors; what is written must not grow with the leaves then."""
    monkeypatch.setattr(celltree, "LEAF", 16)
    written = []

    def counted(df, label):
        out = stage(df, label)
        written.append(out.count())
        return out

    for module in (celltree, neighbours):
        monkeypatch.setattr(module, "stage", counted)
    x = np.random.default_rng(6).normal(size=(800, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, 1, [float(v) for v in row]) for i, row in enumerate(x)], "point bigint, copies bigint, vec array<double>")
    groups = neighbours.dense_groups(points, 0.6)
    counts = {r.point: r.near for r in neighbours.neighbour_counts(groups, 0.6).collect()}
    near = np.round(x @ x.T, 9) >= 0.4
    assert counts == {i: near[i].sum() - 1 for i in range(800)}
    assert groups.members.select("cell").distinct().count() > 50 and sum(written) < 20 * 800
    links = cluster.connected_components(neighbours.component_edges(groups, 0.6)).collect()
    reach = near.astype(float)
    for _ in range(10):
        reach = (reach @ reach > 0).astype(float)
    assert {r.point: r.root for r in links} == {i: int(reach[i].argmax()) for i in range(800) if near[i].sum() > 1}

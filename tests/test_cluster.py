import os
import random

import numpy as np
import pyarrow as pa
import pytest

from loglens import session
from loglens.operators import celltree, cluster, neighbours, vectors


def _dbscan(x: np.ndarray, eps: float, min_samples: int) -> list[int]:
    """Textbook density clustering in row order over cosine distance; zero rows are noise."""
    alive = np.abs(x).sum(axis=1) > 0
    near = (np.round(x @ x.T, 9) >= round(1 - eps, 9)) & alive[:, None] & alive[None, :]
    core = near.sum(axis=1) >= min_samples
    label, found = [-1] * len(x), 0
    for start in range(len(x)):
        if label[start] != -1 or not core[start]:
            continue
        todo = [start]
        label[start] = found
        while todo:
            at = todo.pop()
            if core[at]:
                for other in np.flatnonzero(near[at]):
                    if label[other] == -1:
                        label[other] = found
                        todo.append(int(other))
        found += 1
    return label


def _tfidf(texts: list[str]) -> np.ndarray:
    import re

    docs = [re.findall("[a-z]+", t.lower()) for t in texts]
    words = sorted({w for d in docs for w in d})
    tf = np.array([[d.count(w) for w in words] for d in docs], dtype=float).reshape(len(texts), -1)
    idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0))) + 1
    out = tf * idf
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


@pytest.fixture
def texts():
    rnd = random.Random(5)
    kinds = [["disk", "read", "error", "retry"], ["link", "down", "port"], ["cache", "parity", "error", "fixed"],
             ["job", "done"], ["user", "login", "ok"]]
    made = []
    for i in range(120):
        words = list(rnd.choice(kinds))
        if rnd.random() < 0.6:
            words[rnd.randrange(len(words))] = rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"])
        if rnd.random() < 0.2:
            words = [rnd.choice("qwxyz") * 3 for _ in range(3)]
        made.append(" ".join(words))
    return made + ["17 42", "17 42", "<*>"]


@pytest.mark.parametrize("min_samples", [2, 4, 7])
@pytest.mark.parametrize("leaf", [1024, 5])
def test_text_clusters_match_the_textbook(spark, texts, monkeypatch, min_samples, leaf):
    monkeypatch.setattr(celltree, "LEAF", leaf)
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    found, _, _ = cluster.cluster_texts(rows, "id", "text", eps=0.4, min_samples=min_samples)
    got = {r.id: r.cluster_id for r in found.collect()}
    want = _dbscan(_tfidf(texts), 0.4, min_samples)
    core_like = [i for i in range(len(texts))]
    assert [got[i] for i in core_like] == want


@pytest.mark.parametrize("leaf", [1024, 8])
def test_vector_clusters_match_the_textbook(spark, monkeypatch, leaf):
    """A small leaf means several levels of cells."""
    monkeypatch.setattr(celltree, "LEAF", leaf)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    x = np.vstack([centres[i % 6] + rng.normal(scale=0.35, size=8) for i in range(90)] + [np.zeros(8), np.zeros(8)])
    x[7] = x[1]
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, v array<double>")
    for min_samples in (2, 5):
        found, _, _ = cluster.cluster_vectors(rows, "id", "v", eps=0.06, min_samples=min_samples)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        assert [r.cluster_id for r in found.orderBy("id").collect()] == _dbscan(unit, 0.06, min_samples)


@pytest.mark.parametrize("leaf", [1024, 8])
def test_each_pair_counts_once(spark, texts, monkeypatch, leaf):
    monkeypatch.setattr(celltree, "LEAF", leaf)
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    model = vectors.tfidf(rows, "id", "text")
    x = _tfidf(texts)
    near = np.round(x @ x.T, 9) >= 0.6
    groups = neighbours.text_groups(model.weights, model.points, 0.4)
    counts = {r.point: r.near for r in neighbours.neighbour_counts(groups, 0.4).collect()}
    copies = {r.point: r.copies for r in model.points.collect()}
    for point, n in counts.items():
        assert n == near[point].sum() - copies[point]


def test_long_chain_is_one_component(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(299)] + [(1000, 1001)]
    found = cluster.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.point: r.root for r in found} == {**{i: 0 for i in range(300)}, 1000: 1000, 1001: 1000}


def test_no_vocabulary_at_all(spark):
    rows = spark.createDataFrame([(1, "12 34"), (2, "12 34"), (3, "#")], "id bigint, text string")
    found, points, model = cluster.cluster_texts(rows, "id", "text")
    assert sorted((r.id, r.cluster_id) for r in found.collect()) == [(1, -1), (2, -1), (3, -1)]
    assert cluster.silhouette(points, model.weights).first().silhouette == 0.0


def test_texts_are_neither_moved_nor_written(spark, monkeypatch):
    """Long texts of rare words: what clustering writes is their few vocabulary words, a small part of the texts."""
    rnd = random.Random(8)
    common = ["disk", "read", "error", "retry", "link", "down", "port", "cache"]
    texts = [" ".join(rnd.sample(common, 3) * 40 + ["".join(rnd.choices("abcdefghij", k=9)) for _ in range(400)]) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    written = []

    def staged(df, label):
        made = session.stage(df, label)
        written.append(sum(os.path.getsize(f.removeprefix("file:")) for f in made.inputFiles()))
        return made

    for module in (vectors, celltree, neighbours, cluster):
        monkeypatch.setattr(module, "stage", staged)
    found, points, model = cluster.cluster_texts(rows, "id", "text")
    assert found.count() == 300 and sum(written) < 0.2 * sum(map(len, texts))
    assert abs(cluster.silhouette(points, model.weights).first()[0] - cluster.silhouette(points, model.weights, model).first()[0]) < 1e-8


def test_word_counts_in_portions(spark, monkeypatch):
    """A task that gives its words out in many portions counts the same."""
    rows = spark.createDataFrame([(i, f"a b{'cde'[i % 3]} a {chr(102 + i % 11) * 3} X") for i in range(60)], "id bigint, text string")
    whole = sorted(map(tuple, vectors.word_counts(rows, "text").collect()))
    monkeypatch.setattr(vectors, "HELD_WORDS", 3)
    assert sorted(map(tuple, vectors.word_counts(rows, "text").collect())) == whole
    assert ("a", 120, 60) in whole and ("x", 60, 60) in whole


def _sent(df) -> int:
    """Bytes that a query wrote to its shuffles."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if kind == "ShuffleExchangeExec":
            total += node.metrics().get("shuffleBytesWritten").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_vectors_are_sent_in_packs(spark):
    """Every vector is sent once for each block, in a compressed pack; as a row of the shuffle it took twice the room."""
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(300)]
    texts = [" ".join(rnd.choices(words, k=90)) for _ in range(1500)]
    model = vectors.tfidf(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text")
    groups = neighbours.model_groups(model, 0.4)
    raw = groups.members.selectExpr("sum(12 * size(w))").first()[0]
    for found in (neighbours.neighbour_counts(groups, 0.4), neighbours.component_edges(groups, 0.4)):
        assert 0 < _sent(found) < 0.22 * raw


def test_little_is_written_for_each_level_and_block(spark, monkeypatch):
    """The tree writes a vector once, whatever its levels, and a vector's trip to a block takes a few bits for each number."""
    monkeypatch.setattr(celltree, "LEAF", 40)
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(300)]
    texts = [" ".join(rnd.choices(words[(i % 50) * 5:(i % 50) * 5 + 50], k=90)) for i in range(2500)]
    model = vectors.tfidf(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text")
    written = []

    def staged(df, label):
        made = session.stage(df, label)
        if "w" in made.columns:
            written.append(made.count())
        return made

    monkeypatch.setattr(celltree, "stage", staged)
    groups = neighbours.model_groups(model, 0.4)
    assert sum(written) < 1.8 * 2500 and groups.members.select("cell").distinct().count() > 60
    monkeypatch.undo()
    groups = neighbours.model_groups(model, 0.4)
    raw = groups.members.selectExpr("sum(12 * size(w))").first()[0]
    assert 0 < _sent(neighbours.component_edges(groups, 0.4)) < 0.1 * raw


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("sparse", [True, False])
def test_packs_give_back_their_vectors(whole, sparse):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(50):
        idx = np.sort(rng.choice(700, rng.integers(0, 9), replace=False)).tolist() if sparse else []
        w = rng.integers(-3, 70_000, len(idx) if sparse else 6).astype(float) + (0.0 if whole else 0.25)
        rows.append((f"/{i // 7}#0", int(rng.integers(-2**60, 2**60)), i, idx, w.tolist()))
    batch = celltree.record("cell string, id bigint, a bigint, idx array<int>, w array<double>", *zip(*rows))
    for part in (batch, batch.slice(13, 20), batch.slice(49, 1)):
        assert neighbours._unpack(pa.scalar(neighbours._pack(part))).to_pylist() == part.to_pylist()


def test_words_are_sent_in_packs(spark):
    """New words are most of what is sent to count; as rows they took 12.7 bytes each."""
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(60_000)]
    rows = spark.createDataFrame([(" ".join(words[i:i + 400]),) for i in range(0, 60_000, 200)], "text string")
    counts = vectors.word_counts(rows, "text")
    assert 0 < _sent(counts) < 10 * 60_000
    assert counts.selectExpr("sum(n)", "sum(df)", "count(word)", "count(distinct word)").first() == (119_800, 119_800, 60_000, 60_000)


def test_what_hubs_settle_is_not_sent_to_be_compared(spark, monkeypatch):
    """A crowd, a ring, small groups and lone vectors: links and core points are those of all pairs, and a vector goes to a fraction of the blocks."""
    rng = np.random.default_rng(6)
    middle = np.eye(12)[0] + 0.16 * rng.normal(size=(1500, 12))
    turns = np.linspace(0, 2 * np.pi, 60)
    ring = np.zeros((60, 12))
    ring[:, 5], ring[:, 6] = np.cos(turns), np.sin(turns)
    x = np.vstack([middle, ring, rng.normal(size=(140, 12))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    copies = rng.integers(1, 4, len(x))
    points = spark.createDataFrame([(10 * i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(copies, x))], "point bigint, copies bigint, vec array<double>")
    near = np.round(x @ x.T, 9) >= 0.7
    want = [int((near[i] * copies).sum()) for i in range(len(x))]
    label = np.arange(len(x))
    while (least := np.where(near, label[None, :], len(x)).min(axis=1)).tolist() != label.tolist():
        label = least
    monkeypatch.setattr(celltree, "LEAF", 64)
    groups = neighbours.dense_groups(points, 0.3)
    whole = neighbours.component_edges(groups, 0.3)
    for hubs in (1, 100):
        monkeypatch.setattr(neighbours, "MANY", 0)
        monkeypatch.setattr(neighbours, "HUBS", hubs)
        links = neighbours.component_edges(groups, 0.3)
        found = {r.point: r.root for r in cluster.connected_components(links).collect()}
        assert [found.get(10 * i, 10 * i) // 10 for i in range(len(x))] == label.tolist()
        for least in (4, 30, 300):
            core = {r.point for r in neighbours.core_points(groups, 0.3, least).collect()}
            assert core == {10 * i for i, n in enumerate(want) if n >= least}
    assert 0 < _sent(links) < 0.5 * _sent(whole)

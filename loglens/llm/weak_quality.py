"""Quality classifier from weak labels.

Overlapping heuristic labellers look at each whole text and say good, bad or nothing. Expectation
maximisation over the counts of their vote patterns, taken from all documents, estimates how often
each labeller is right about good texts and about each kind of bad ones, and so the probability that
a text with a given pattern is good. These posterior labels train a linear scorer on hashed features, which then
scores every document.

The pattern counts are at most 3 to the number of labellers rows. The scorer is fitted on a
bounded sample: about ``SAMPLE`` different texts of either class (the parameter ``sample``).

Defined cases: a null text is an empty one; texts are rejected if they have no word; repeated rows
are scored once each; a null id stays null; other columns are ignored by ``scored`` and kept by
``kept``; an empty table gives no rows, and where nothing can be learned every score is 0.5.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.memory import claim, trim
from loglens.llm.rules import STOP_WORDS

#: Texts of either class that the scorer learns from, about; hashed features; the fit's strength and steps.
SAMPLE, FEATURES, PENALTY, STEPS = 2000, 4096, 1e-5, 200
#: Documents with a lower score are rejected.
LEAST_SCORE = 0.3
ROUNDS = 50
SYMBOLS = "#*$%&|<>{}[]\\^~=_@"
FUNCTION_WORDS = frozenset(STOP_WORDS)


class Measures(NamedTuple):
    words: int
    word_length: float
    top_share: float
    symbols: float
    shouted: float
    capitals: float
    function_words: float
    repeated_lines: float
    letters: float
    echoes: float


def measures(text: str) -> Measures:
    words = text.split()
    n = max(1, len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    packed = "".join(words)
    size = max(1, len(packed))
    top = max(Counter(words).values(), default=0)
    return Measures(
        len(words), size / n, top / n, sum(map(text.count, SYMBOLS)) / n, (text.count("!") + text.count("?")) / n,
        sum(map(str.isupper, words)) / n, sum(map(FUNCTION_WORDS.__contains__, map(str.lower, words))) / n,
        1 - len(set(lines)) / max(1, len(lines)), sum(map(str.isalpha, words)) / n,
        sum(map(operator.eq, words, words[1:])) / n)


def _band(bad_below: float, good_from: float, good_to: float, bad_above: float) -> Callable[[float], int]:
    return lambda x: -1 if x < bad_below or x > bad_above else 1 if good_from <= x <= good_to else 0


_INF = float("inf")
#: The labellers: a measure, and where it says bad (-1), good (1) or nothing (0).
LABELLERS: list[tuple[str, Callable[[float], int]]] = [
    ("words", _band(4, 30, _INF, _INF)),
    ("word_length", _band(2.2, 3.0, 9.0, 14.0)),
    ("top_share", _band(-1, 0, 0.15, 0.3)),
    ("symbols", _band(-1, 0, 0.05, 0.25)),
    ("shouted", _band(-1, 0, 0.05, 0.4)),
    ("capitals", _band(-1, 0, 0.1, 0.5)),
    ("function_words", _band(0.01, 0.06, 0.7, 0.9)),
    ("repeated_lines", _band(-1, 0, 0.1, 0.35)),
    ("letters", _band(0.3, 0.6, 1, 2)),
    ("echoes", _band(-1, 0, 0.05, 0.15)),
]


#: Labellers that notice the same way of being bad.
KINDS = [("words",), ("symbols",), ("shouted", "capitals"), ("top_share", "repeated_lines", "echoes"),
         ("word_length", "function_words", "letters")]


def votes(m: Measures) -> str:
    """One character for each labeller: ``-``, ``0`` or ``+``."""
    return "".join("-0+"[label(getattr(m, name)) + 1] for name, label in LABELLERS)


class LabelModel(NamedTuple):
    """A latent kind for each text: good, or bad in one of several ways, since one way of being bad
    says nothing about the others. ``prior`` has the share of each kind and ``said`` how often each
    labeller says bad, nothing or good of a text of that kind; given the kind they are independent."""

    prior: np.ndarray
    said: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of each kind for rows of votes (-1, 0, 1); the first is good."""
        each = np.log(self.said)[:, np.arange(patterns.shape[1]), patterns + 1]
        logs = np.log(self.prior) + each.sum(axis=2).T
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def accuracies(self) -> list[tuple[str, float, float]]:
        """(labeller, chance that it says bad of a bad text, chance that it doesn't of a good one)."""
        bad = self.prior[1:] / self.prior[1:].sum()
        return [(name, float(bad @ self.said[1:, j, 0]), float(1 - self.said[0, j, 0]))
                for j, (name, _) in enumerate(LABELLERS)]


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation. At first a text is good if no labeller says bad, else shared among
    the kinds of those that do. A few made-up votes keep the estimates off 0 and 1."""
    kinds = np.zeros((len(patterns), 1 + len(KINDS)))
    for k, names in enumerate(KINDS, 1):
        own = [j for j, (name, _) in enumerate(LABELLERS) if name in names]
        kinds[:, k] = (patterns[:, own] < 0).sum(axis=1)
    kinds[:, 0] = kinds.sum(axis=1) == 0
    kinds /= kinds.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = kinds * counts[:, None]
        votes_by_kind = np.stack([weight.T @ (patterns == v) for v in (-1, 0, 1)], axis=2)
        model = LabelModel(
            (weight.sum(axis=0) + 1) / (counts.sum() + weight.shape[1]),
            (votes_by_kind + 0.1) / (weight.sum(axis=0)[:, None, None] + 0.3))
        kinds = model.posterior(patterns)
    return model


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """A small number for every code point: its own for punctuation and digits of ASCII, one each
    for lower case, capitals, other letters, white space and the rest."""
    table = np.full(0x3000, 4, dtype=np.uint32)
    for code in range(len(table)):
        c = chr(code)
        table[code] = (
            0 if c.isspace() else 1 if c.islower() else 2 if c.isupper() else 3 if c.isalpha()
            else 5 if c.isdigit() else code if code < 128 else 4)
    return table


def features(text: str, width: int = FEATURES, m: Measures | None = None) -> np.ndarray:
    """Hashed features: runs of one to three character classes (equal neighbours count as one), of
    unit length together, and the steps of every measure."""
    m = m or measures(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.where(codes < 0x3000, _classes()[np.minimum(codes, 0x2FFF)], 3).astype(np.uint32)
    kinds = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])] if len(kinds) else kinds
    x = np.zeros(width)
    one = (kinds + np.uint32(1)) * np.uint32(0x9E3779B1)
    runs = one
    for order in range(3):
        if order:
            runs = (runs[:-1] ^ (runs[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[order:]
        if not len(runs):
            break
        mixed = (runs ^ (runs >> np.uint32(16))) * np.uint32(0xC2B2AE3D)
        x += np.bincount((mixed >> np.uint32(8)) % np.uint32(width), minlength=width)
    x = np.sqrt(x)
    x /= max(1e-9, np.linalg.norm(x))
    steps = [("words", int(np.log2(m.words + 1)))] + [
        (name, int(np.ceil(10 * getattr(m, name)))) for name in m._fields if name not in ("words", "word_length")]
    steps.append(("word_length", int(m.word_length)))
    for name, step in steps:
        x[_slot(f"{name} {min(step, 40)}", width)] += 0.3
    return x


@lru_cache(maxsize=4096)
def _slot(name: str, width: int) -> int:
    import zlib

    return zlib.crc32(name.encode()) % width


def fit_scorer(x: np.ndarray, good: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Logistic regression on soft labels, both classes weighing the same; the last weight is the
    bias. Accelerated gradient steps from zero."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    share = good / max(1e-9, 2 * good.sum()) + (1 - good) / max(1e-9, 2 * (1 - good).sum())
    share, good = (share / share.sum()).astype(x.dtype), good.astype(x.dtype)
    w = np.zeros(x.shape[1], dtype=x.dtype)
    ahead, momentum, rate = w, 1.0, 1.0
    for _ in range(steps):
        said = 1 / (1 + np.exp(-np.clip(x @ ahead, -50, 50)))
        new = ahead - rate * ((share * (said - good)) @ x + penalty * ahead)
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return w


class Model(NamedTuple):
    labels: LabelModel | None
    weights: np.ndarray | None
    width: int


def _decoded(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in p] for p in patterns]).reshape(len(patterns), len(LABELLERS))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, width: int = FEATURES) -> Model:
    """Label model over all documents, then the scorer on a bounded sample."""
    texts = docs.select(F.coalesce(text, F.lit("")).alias("text"))

    def vote(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("quality")
        for batch in column:
            yield pd.Series([votes(measures(t)) for t in batch], dtype=object)
        trim()

    # At most 3 ** len(LABELLERS) rows.
    seen = texts.select(F.pandas_udf(vote, "string")("text").alias("votes"), F.xxhash64("text").alias("hash")).groupBy(
        "votes").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("different")).orderBy("votes").collect()
    if not seen:
        return Model(None, None, width)
    patterns, counts = _decoded([r["votes"] for r in seen]), np.array([r["n"] for r in seen], dtype=float)
    labels = fit_labels(patterns, counts)
    good = dict(zip((r["votes"] for r in seen), labels.posterior(patterns)[:, 0].tolist()))
    # The sample is of different texts, so copies must not lower its share.
    different = {k: sum(r["different"] for r in seen if (good[r["votes"]] >= 0.5) == k) for k in (True, False)}
    shares = {k: min(1.0, sample / max(1, n)) for k, n in different.items()}
    draw = F.pmod(F.xxhash64("text", F.lit("quality")), F.lit(1 << 30)) / (1 << 30)

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("quality")
        for batch in batches:
            rows = []
            for value, at in zip(batch["text"], batch["draw"]):
                m = measures(value)
                p = good.get(votes(m), 0.5)
                if at < shares[p >= 0.5]:
                    rows.append((0, p, features(value, width, m).astype("<f2").tobytes()))
            yield pd.DataFrame(rows, columns=["machine", "good", "x"]).astype({"machine": "int32", "good": "float64"})
        trim()

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["good", "x"])  # sums in the same order each time
        x = np.frombuffer(b"".join(group["x"]), dtype="<f2").reshape(len(group), width).astype(np.float32)
        w = fit_scorer(x, group["good"].to_numpy())
        return pd.DataFrame({"w": [w.astype("<f8").tobytes()]})

    chosen = texts.withColumn("draw", draw).where(F.col("draw") < max(shares.values())).dropDuplicates(["text"])
    made = chosen.mapInPandas(examples, "machine int, good double, x binary").groupBy("machine").applyInPandas(learn, "w binary")
    found = [np.frombuffer(r["w"], dtype="<f8") for r in made.collect()]
    return Model(labels, found[0] if found else None, width)


def _score(model: Model, text: str) -> float:
    m = measures(text)
    if model.weights is None:
        return 0.5
    if not m.words:
        return 0.0
    margin = float(features(text, model.width, m) @ model.weights[:-1] + model.weights[-1])
    return 1 / (1 + float(np.exp(-np.clip(margin, -50, 50))))


def _scores(model: Model, spark):
    sent = spark.sparkContext.broadcast(model)  # one weight for each hashed feature

    def read(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("quality")
        for batch in column:
            yield pd.Series([_score(sent.value, t or "") for t in batch], dtype=float)
        trim()

    return F.pandas_udf(read, "double")


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
           least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, score, kept) for every document."""
    said = docs.select(F.col(doc_id).alias("doc_id"), _scores(model, docs.sparkSession)(F.col(text)).alias("score"))
    return said.select("doc_id", "score", (F.col("score") >= least).alias("kept"))


def kept(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rejected ones."""
    return docs.where(_scores(model, docs.sparkSession)(F.col(text)) >= least)

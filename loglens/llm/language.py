"""Language identification in two steps: the family, then the language within it.

Features are hashed runs of one to three letters, counted over the whole text (letters in lower
case, everything else a space) and scaled to unit length of their square roots. The family comes
from one-versus-rest linear support vector machines; within a family, every two languages have a
machine of their own and the language with most votes wins, ties by the sum of margins.

The machines are fitted on a bounded sample: about ``SAMPLE`` different texts of each language (the
parameter ``sample``), chosen by a hash, and about ten times as many for a family's machine. Each
machine is a task of its own, so nothing grows with the corpus; the language of every document is
predicted in one narrow pass.

Defined cases: a text that is null or has no letter is ``und`` with score 0; documents without a
language or an id are not learned from; a null id is not held out; with one family, or one language
in a family, there is nothing to separate and its score is 1; nothing to learn from makes every
prediction ``und``; repeated rows are predicted once each; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.memory import claim, trim

UNKNOWN = "und"
#: Documents of each language that machines learn from, about; features; the fit's strength and steps.
SAMPLE, FEATURES, PENALTY, STEPS = 800, 4096, 1e-4, 150
#: Documents under this score are rejected by ``kept``: the first language is hardly ahead of the second.
LEAST_SCORE = 0.55
_LETTERS = 0x33480  # behind it there are no letters
# Languages of a family, by ISO 639-1 code. Any other language is its own family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "lb", "nl", "no", "nb", "nn", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "finnic": ["et", "fi"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "sa", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "malayic": ["id", "jv", "ms", "su", "tl"],
}


def family(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def held_out(doc_id: Column) -> Column:
    """True for a third of the documents, which are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """For every code point the lower-case letter, or 0 where it is no letter."""
    table = np.zeros(_LETTERS + 1, dtype=np.uint32)
    for code in range(_LETTERS):
        letter = chr(code)
        if unicodedata.category(letter)[0] == "L":
            table[code] = ord(letter.lower()[0])
    return table


def features(text: str, width: int = FEATURES) -> np.ndarray | None:
    """The unit vector of a text; None if it has no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _lower()[np.minimum(codes, _LETTERS)]
    if not letters.any():
        return None
    letters = np.concatenate([[0], letters[(letters != 0) | (np.concatenate([[1], letters[:-1]]) != 0)], [0]]).astype(np.uint32)
    counts = np.zeros(width)
    one = letters * np.uint32(0x9E3779B1)
    runs = one
    for order in range(3):
        if order:
            runs = (runs[:-1] ^ (runs[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[order:]
        mixed = (runs ^ (runs >> np.uint32(16))) * np.uint32(0xC2B2AE3D)
        counts += np.bincount((mixed >> np.uint32(8)) % np.uint32(width), minlength=width)
    roots = np.sqrt(counts)
    return roots / np.linalg.norm(roots)


def fit_machine(x: np.ndarray, sign: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss, both classes
    weighing the same; accelerated gradient steps from zero, so the fit has no random part."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(x.dtype)
    w = np.zeros(x.shape[1], dtype=x.dtype)
    pull, ahead, momentum, rate = share * sign, w, 1.0, 1 / (4 + penalty)
    for _ in range(steps):
        slack = np.maximum(0, 1 - sign * (x @ ahead))
        new = ahead - rate * (penalty * ahead - 2 * ((pull * slack) @ x))
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return w


class Model(NamedTuple):
    """Machines by name: a family, or two languages."""

    families: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray]
    languages: dict[str, list[str]]
    width: int


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
        width: int = FEATURES) -> Model:
    """Learn from documents that are not held out."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # Different texts, since the sample has no copies.
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    languages: dict[str, list[str]] = {}
    for name in sorted(sizes):
        languages.setdefault(family(name), []).append(name)
    pairs = [(a, b) for members in languages.values() for i, a in enumerate(members) for b in members[i + 1 :]]
    if not sizes:
        return Model({}, {}, {}, width)
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))).otherwise(share)
    draw = lambda salt: F.pmod(F.xxhash64("text", F.lit(salt)), F.lit(1 << 30)) / (1 << 30)
    for_family = min(1.0, 10 * sample / sum(min(sample, n) for n in sizes.values()))
    chosen = (
        known.where(draw("sample") < share).dropDuplicates(["lang", "text"])
        .withColumn("families", draw("families") < for_family))
    kinds = {name: family(name) for name in sizes}

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each machine that learns from the document."""
        claim("language")
        for batch in batches:
            rows = []
            for key, value, name, general in zip(batch["doc_id"], batch["text"], batch["lang"], batch["families"]):
                x = features(value, width)
                if x is None:
                    continue
                packed = x.astype("<f2").tobytes()
                if len(languages) > 1 and general:
                    rows += [(f, 1 if f == kinds[name] else -1, key, packed) for f in languages]
                rows += [(f"{a} {b}", 1 if name == a else -1, key, packed) for a, b in pairs if name in (a, b)]
            yield pd.DataFrame(rows, columns=["machine", "sign", "doc_id", "x"]).astype({"doc_id": "int64"})
        trim()

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "sign"])  # sums in the same order each time
        x = np.frombuffer(b"".join(group["x"]), dtype="<f2").reshape(len(group), width).astype(np.float32)
        w = fit_machine(x, group["sign"].to_numpy(dtype=np.float32))
        return pd.DataFrame({"machine": [group["machine"].iloc[0]], "w": [w.astype("<f8").tobytes()]})

    made = chosen.mapInPandas(examples, "machine string, sign int, doc_id bigint, x binary").groupBy("machine").applyInPandas(
        learn, "machine string, w binary").collect()
    w = {r["machine"]: np.frombuffer(r["w"], dtype="<f8") for r in made}
    return Model({f: w[f] for f in languages if f in w}, {p: w[" ".join(p)] for p in pairs if " ".join(p) in w}, languages, width)


def _share(margin: float) -> float:
    """The margin as a share between 0 and 1."""
    return 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))


def predict(model: Model, x: np.ndarray) -> tuple[str, float]:
    if not model.languages:
        return UNKNOWN, 0.0
    x = np.append(x, 1.0)
    margins = {name: float(w @ x) for name, w in model.families.items()}
    kind = max(sorted(margins), key=margins.get) if margins else next(iter(model.languages))
    score = _share(margins[kind] - max([m for f, m in margins.items() if f != kind], default=-50.0)) if margins else 1.0
    members = model.languages[kind]
    votes = {name: [0, 0.0] for name in members}
    for (a, b), w in model.pairs.items():
        if a in votes:
            margin = float(w @ x)
            votes[a if margin >= 0 else b][0] += 1
            votes[a][1] += margin
            votes[b][1] -= margin
    best = max(members, key=lambda name: (*votes[name], name))
    closest = min((float(w @ x) * (1 if a == best else -1) for (a, b), w in model.pairs.items() if best in (a, b)), default=50.0)
    return best, float(min(score, _share(closest)))


def identified(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the machines, not the corpus

    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("language")
        for batch in texts:
            rows = []
            for value in batch:
                x = features(value or "", sent.value.width)
                rows.append((UNKNOWN, 0.0) if x is None else predict(sent.value, x))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])
        trim()

    said = F.pandas_udf(read, "lang_pred string, score double")(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), said.alias("said")).select(
        "doc_id", "held_out", "said.*")


def kept(docs: DataFrame, model: Model, least: float = LEAST_SCORE, text: str = "text") -> DataFrame:
    """``docs`` without those whose language is not known: no letters, or a score under ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("language")
        for batch in texts:
            found = (features(value or "", sent.value.width) for value in batch)
            yield pd.Series([x is not None and predict(sent.value, x)[1] >= least for x in found], dtype=bool)
        trim()

    return docs.where(F.pandas_udf(read, "boolean")(F.col(text)))

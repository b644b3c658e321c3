"""Exact order statistics in a few passes, whatever the values.

A mergeable sketch (KLL) tells between which two values the wanted ranks lie. A second pass counts what is
below and inside each bracket; where a bracket holds few values they are read and the rank is selected
exactly, else it is bracketed again by a sketch of its inside. Nothing holds all values, and a few
outliers don't matter, as brackets are made of ranks and not of the range of values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter of the sketches, and different values of a bracket that are read.
SKETCH, FEW = 2048, 50_000


def _sketched(rows: DataFrame, ranks: list[int], total: int) -> list[tuple[float, float]]:
    """A bracket for every rank (from 0) of ``rows`` (x), of which there are ``total``."""
    # Well over the sketch's error of rank; a bracket that misses is found out by counting.
    error = 4 / SKETCH**0.9
    sides = [(max(0.0, r / total - error), min(1.0, (r + 1) / total + error)) for r in ranks]
    sketch = rows.agg(F.kll_sketch_agg_double("x", F.lit(SKETCH)).alias("s"))
    found = sketch.select(*[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(f"q{i}_{j}") for i, pair in enumerate(sides)
                            for j, q in enumerate(pair)]).first()
    return [(found[f"q{i}_0"], found[f"q{i}_1"]) for i in range(len(sides))]


def at_ranks(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at some ranks, from 0, of the values that are not null; not a number comes last."""
    x = F.col(column).cast("double")
    rows = df.where(F.col(column).isNotNull()).select(F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x).alias("x"))
    facts = rows.agg(F.count("x"), F.min("x"), F.max("x")).first()
    total, out = facts[0], {}
    if not total:
        return {}
    wanted = sorted({r for r in ranks if 0 <= r < total})
    brackets: dict[int, tuple[float, float]] = {r: (facts[1], facts[2]) for r in wanted}
    first = True
    while brackets:
        open_ = list(brackets)
        # The first pass is a count over everything anyway.
        counts = rows.agg(*[c for i, r in enumerate(open_) for c in (
            F.count_if(F.col("x") < brackets[r][0]).alias(f"b{i}"), F.count_if(F.col("x").between(*brackets[r])).alias(f"i{i}"))]).first() if not first else None
        for i, r in enumerate(open_):
            low, high = brackets[r]
            below, inside = (counts[f"b{i}"], counts[f"i{i}"]) if counts else (0, total)
            if low == high and below <= r < below + inside:
                out[r] = low
                del brackets[r]
                continue
            if not below <= r < below + inside:  # the sketch was unlucky
                brackets[r] = (facts[1], low) if r < below else (high, facts[2])
                continue
            held = rows.where(F.col("x").between(low, high))
            values = held.groupBy("x").agg(F.count(F.lit(1)).alias("n")).limit(FEW + 1).collect() if inside <= 4 * FEW or not first else None
            if values is not None and len(values) <= FEW:
                at = below
                for x_, n in sorted((v["x"], v["n"]) for v in values):
                    at += n
                    if r < at:
                        out[r] = x_
                        break
                del brackets[r]
            else:
                brackets[r] = _sketched(held, [r - below], inside)[0]
                if brackets[r] == (low, high):  # most values are at its two ends
                    ends = held.agg(F.count_if(F.col("x") == low).alias("low"), F.count_if(F.col("x") == high).alias("high"),
                                    F.min(F.when(F.col("x") > low, F.col("x"))).alias("next"),
                                    F.max(F.when(F.col("x") < high, F.col("x"))).alias("last")).first()
                    at = r - below
                    brackets[r] = (low, low) if at < ends["low"] else (high, high) if at >= inside - ends["high"] else (ends["next"], ends["last"])
        first = False
    return out


def exact(df: DataFrame, column: str, levels: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles; null where there are no values."""
    total = df.agg(F.count(column)).first()[0]
    if not total:
        return [None] * len(levels)
    places = [q * (total - 1) for q in levels]
    known = at_ranks(df, column, [r for p in places for r in (math.floor(p), math.ceil(p))])
    out = []
    for p in places:
        a, b = math.floor(p), math.ceil(p)
        low, high = known[a], known[b]
        out.append(low if low == high else (b - p) * low + (p - a) * high)
    return out


def row(df: DataFrame, column: str, levels: dict[str, float]) -> DataFrame:
    """Quantiles as one row."""
    found = exact(df, column, list(levels.values()))
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(name) for name, v in zip(levels, found)])

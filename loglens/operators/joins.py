"""A join for keys that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
#: A key with more than this share of the rows is hot, or half of a task's even share if less.
HOT_SHARE = 1 / 256


def hot_keys(counts: DataFrame, on: list[str], n: str) -> DataFrame:
    """Hot keys, from a table of counts per key: at most 256, or twice the shuffle's width."""
    width = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum(n)).scalar()
    return counts.where(F.col(n) > total * min(HOT_SHARE, 0.5 / width)).select(*on)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner",
                salts: int = SALTS, hot: DataFrame | None = None) -> DataFrame:
    """Join ``big`` with ``small`` on ``on``; rows of one key are spread by column ``by``.

    ``small`` (few rows per key) is repeated once per salt, so a hot key of ``big`` is shared
    by ``salts`` join partitions, and an aggregation behind the join cannot inherit a
    partitioning that puts the hot key into one task. When the planner sees that ``small`` is
    small enough it broadcasts it and nothing is shuffled.

    Where ``small`` may be as large as ``big``, the caller passes the ``hot`` keys (few, see
    ``hot_keys``) and only those are repeated.
    """
    last = F.lit(salts - 1)
    salt = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    if hot is not None:
        marks = F.broadcast(hot.withColumn("_hot", F.lit(True)))
        big, small = big.join(marks, on, "left"), small.join(marks, on, "left")
        last = F.when(F.col("_hot"), last).otherwise(F.lit(0))
        salt = F.when(F.col("_hot"), salt).otherwise(F.lit(0))
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    spread = big.withColumn("_salt", salt).drop("_hot")
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")

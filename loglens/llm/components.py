"""Connected components of verified links, by contraction.

In every round each point finds its least neighbour, looks one step further along that pointer, and
the links are drawn between the points arrived at. By id this finishes stars in one round; from the
second round on "least" goes by a hash, so that a long chain shrinks by a constant factor a round.
What is left is written after each round, so a lost executor repeats one round, and nothing is
gathered for a point but the minimum over its links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.session import stage


def _rank(column: str, by_id: bool) -> Column:
    order = F.col(column) if by_id else F.xxhash64(column)
    return F.struct(order.alias("order"), F.col(column).alias("point"))


def _pointers(links: DataFrame, by_id: bool) -> DataFrame:
    """(point, to): two steps towards the least neighbour. Every point of ``links`` is there."""
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ways.groupBy("a").agg(F.min(_rank("b", by_id)).alias("least"))
    one = least.select(F.col("a").alias("point"), F.least("least", _rank("a", by_id))["point"].alias("mid"))
    return one.join(one.select(F.col("point").alias("mid"), F.col("mid").alias("to")), "mid").select("point", "to")


def connected(links: DataFrame) -> DataFrame:
    """(point, root) for every point that has a link (a, b) to another; equal roots in a component."""
    left = stage(links.select("a", "b").where("a <> b"), "links_left")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        rounds.append(stage(_pointers(left, not rounds), "pointers"))
        for end in ("a", "b"):
            left = left.join(rounds[-1].select(F.col("point").alias(end), F.col("to").alias(f"{end}_to")), end)
        left = stage(
            left.where("a_to <> b_to")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links_left")
    if not rounds:
        return links.select(F.col("a").alias("point"), F.col("b").alias("root")).limit(0)
    found = rounds[0].withColumnRenamed("to", "root")
    for moved in rounds[1:]:
        found = found.join(moved.withColumnRenamed("point", "root"), "root", "left").select(
            "point", F.coalesce("to", "root").alias("root"))
    return found

"""Modes, first values, ranks and running sums that never need a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.operators import quantiles
from loglens.session import stage

_SLICES = 1024


def mode_of(counts: DataFrame, keys: list[str], value: str, n: str = "n", prefer: str | None = None) -> DataFrame:
    """Most frequent ``value`` per key from a table of counts; ties go to the smaller value.

    ``prefer`` names a 0/1 column: rows with 1 win over all rows with 0. The choice is a
    plain ``min`` of a struct, so it is combined before the shuffle.
    """
    order = ([-F.col(prefer)] if prefer else []) + [-F.col(n), F.col(value)]
    named = [c.alias(f"o{i}") for i, c in enumerate(order)]
    best = F.min(F.struct(*named)).alias("best")
    return counts.groupBy(*keys).agg(best).select(
        *keys, F.col(f"best.o{len(order) - 1}").alias(value), (-F.col(f"best.o{len(order) - 2}")).alias(n)
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return (
        df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), *columns)
    )


def first_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value on the first row of each key in ``order``."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def best_row(df: DataFrame, keys: dict[str, Column], by: str, tie: str) -> DataFrame:
    """(keys, tie, by) of the row with the largest ``by`` of each group, the smallest ``tie`` among equal ones. A minimum of
    structs, so it is combined before the shuffle."""
    best = F.min(F.struct((-F.col(by)).alias("rank"), F.col(tie).alias("tie"))).alias("best")
    return df.groupBy(*[c.alias(name) for name, c in keys.items()]).agg(best).select(
        *keys, F.col("best.tie").alias(tie), (-F.col("best.rank")).alias(by))


def in_time_order(df: DataFrame) -> DataFrame:
    """Lines by time; windows need no order, so this is for outputs only."""
    return df.orderBy("timestamp", "line_id")


def head(df: DataFrame, n: int, *columns: str, order: str = "line_id") -> DataFrame:
    """The first rows in file order; each task keeps ``n`` of them."""
    return df.orderBy(order).limit(n).select(*columns)


def places_in_groups(df: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """Add ``place``, from 1: by descending ``by`` and then ``tie`` inside each group. Rows are cut into ranges, so a group of
    any size is ranked by many tasks; what earlier ranges hold of a group is added."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key), F.desc(by), F.col(tie)]
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "places")
    inside = F.row_number().over(Window.partitionBy("_part", key).orderBy(F.desc(by), tie))
    # A row for each range that a group reaches into.
    counts = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), before.alias("_before")).where("_before > 0")
    local = ranged.withColumn("_place", inside)
    met = local.join(offsets, local[key].eqNullSafe(offsets["_key"]) & (local["_part"] == offsets["_at"]), "left")
    return met.select(*df.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("bigint").alias("place"))


def top_n(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


def running_sums(df: DataFrame, value: str, sums: dict[str, Column]) -> DataFrame:
    """Per distinct ``value``: each sum, and its running total over all smaller-or-equal values.

    Distinct values are aggregated first and cut into ranges with about as many of them each, so that
    outliers don't matter; running sums inside a range are windows per range, and the offsets come
    from one row per range. The ranges are written once, so they can't move if a task is repeated.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = stage(
        df.groupBy(value).agg(*[c.alias(name) for name, c in sums.items()]).repartitionByRange(parts, value)
        .withColumn("slice", F.spark_partition_id()),
        "slices",
    )
    inside = Window.partitionBy("slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    # One row per range: bounded by the shuffle width, safe in one task and safe to broadcast.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy("slice").agg(*[F.sum(name).alias(name) for name in sums])
        .select("slice", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"off_{name}") for name in sums])
    )
    local = cells.select("*", *[F.sum(name).over(inside).alias(f"run_{name}") for name in sums])
    return local.join(F.broadcast(offsets), "slice").select(
        value, *sums, *[(F.col(f"run_{name}") + F.col(f"off_{name}")).alias(f"cum_{name}") for name in sums]
    )


def quantile_at(df: DataFrame, value: str, q: Column) -> DataFrame:
    """One row, ``quantile``: the linearly interpolated quantile at a level that may itself
    be computed from data (the built-in takes literals only)."""
    level = df.sparkSession.range(1).select(q.alias("q")).first()["q"]
    return quantiles.row(df, value, {"quantile": level}) if level is not None else df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("quantile"))


def dense_ids(values: DataFrame, key: str, out: str, start: int = 0) -> DataFrame:
    """Number the distinct keys 0, 1, 2 ... in ascending order without one global sort task.

    The keys are range-partitioned and written once with their partition number, so that the
    numbering cannot move if a task is repeated; offsets come from one row per partition.
    Column ``n`` counts the rows of each key.
    """
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        values.groupBy(key).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(parts, key)
        .withColumn("part", F.spark_partition_id()),
        "ids",
    )
    # One row per partition: bounded by the shuffle width.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return ranged.withColumn("place", place).join(F.broadcast(offsets), "part").select(
        key, (F.col("offset") + F.col("place") - 1 + start).alias(out), "n"
    )


#: Offsets from which a page is found by counting; a shallow page keeps the first rows of each task.
DEEP = 20_000


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def key_page(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order of ``key``, a unique whole number. Behind ``DEEP`` rows the
    key range of the page is found by counting, so its cost doesn't grow with the offset."""
    if offset < DEEP:
        return page(df, [F.col(key)], limit, offset)
    return _narrowed(df, key, offset, offset + limit)


def ranked_page(df: DataFrame, by: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by descending ``by``, then ``tie``, a unique whole number. Behind ``DEEP``
    rows the value at the offset is selected first, and only rows from there on are sorted."""
    order = [F.desc(by), F.col(tie)]
    if offset < DEEP:
        return page(df, order, limit, offset)
    rows = df.where(F.col(by).isNotNull())
    known = rows.count()
    if offset >= known:  # nulls are last
        return key_page(df.where(F.col(by).isNull()), tie, limit, offset - known)
    first = quantiles.at_ranks(rows, by, [known - 1 - offset])[known - 1 - offset]
    above = rows.where(F.col(by) > first).count()
    equal = rows.where(F.col(by) == first)
    inside = equal.count()
    held = key_page(equal, tie, limit, offset - above)
    short = offset - above + limit - inside
    if short <= 0:
        return held
    # The page goes on behind the rows of equal value.
    rest = page(df.where((F.col(by) < first) | F.col(by).isNull()), order, short)
    return held.unionByName(rest).orderBy(*order)


def keyset_page(df: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """The next page behind a known key: its cost does not grow with the page number."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)


def page_facts(df: DataFrame, page_number: int, size: int = 500) -> DataFrame:
    """Row count, page count and the row numbers a page shows."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total_rows"),
        F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint").alias("total_pages"),
        F.lit((page_number - 1) * size + 1).cast("bigint").alias("start_row"),
        F.least(F.lit(page_number * size), total).cast("bigint").alias("end_row"),
    )


def numbered_page(df: DataFrame, key: str, page_number: int, size: int = 500, small: int = 100_000) -> DataFrame:
    """Page ``page_number`` (from 1) of the rows in ``key`` order, ``key`` being a unique integer."""
    return _narrowed(df, key, (page_number - 1) * size, page_number * size, small)


def _narrowed(df: DataFrame, key: str, first: int, last: int, small: int = 100_000) -> DataFrame:
    """Rows ``first`` to ``last`` in ``key`` order.

    The key range holding them is narrowed first by counting rows per slice (at most
    1,025 counts reach the driver per round; each round cuts the range about a thousandfold),
    so a deep page sorts a few rows instead of everything before it.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.limit(0)
    skipped = 0
    while True:
        width = max(-(-(high - low + 1) // _SLICES), 1)
        near = df.where(F.col(key).between(low, high))
        counts = near.groupBy(F.floor((F.col(key) - low) / width).alias("slice")).count().collect()
        seen, hit = skipped, []
        for row in sorted(counts):
            if seen < last and seen + row["count"] > first:
                hit.append((row["slice"], seen, row["count"]))
            seen += row["count"]
        if not hit:
            return df.limit(0)
        low, high, skipped = low + hit[0][0] * width, low + (hit[-1][0] + 1) * width - 1, hit[0][1]
        if width == 1 or sum(h[2] for h in hit) <= small or len(counts) == len(hit):
            rows = df.where(F.col(key).between(low, high))
            return rows.orderBy(key).offset(first - skipped).limit(last - first)

"""Log-shaped inputs derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions import text

# The five event types of the ``events`` table, in alphabetical order. With
# seven shards each they give the 35 templates whose rank is the event id.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``parsed`` table: one row per event, everything computed in one projection."""
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    kind, user, value = F.col("event_type"), F.col("user_id"), F.col("value")
    shard = F.element_at(F.array(*[F.lit(c) for c in "abcdefg"]), (k % 7 + 1).cast("int"))
    level = (
        F.when(kind == "error",
               F.when(value >= 100, "FATAL").when(value >= 50, "SEVERE").when(value >= 20, "ERROR")
               .otherwise("FAILURE"))
        .when(kind == "purchase", "WARNING")
        .otherwise("INFO")
    )
    node = F.when(user % 50 == 0, "SYSTEM").otherwise(
        F.concat(F.lit("R"), (user % 16).cast("string"), F.lit("-N"), (user % 4).cast("string"))
    )
    content = F.concat_ws(" ", kind, F.lit("on shard"), shard, F.lit("code"), k.cast("string"))
    rank = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), kind)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_id"),
        F.when((kind == "error") & (value >= 150), 1).otherwise(0).alias("is_anomaly"),
        F.unix_timestamp(ts).alias("timestamp"),
        F.date_format(ts, "yyyy.MM.dd").alias("date"),
        node.alias("node"),
        level.alias("level"),
        F.when(user % 2 == 0, "KERNEL").otherwise("APP").alias("component"),
        content.alias("content"),
        ((rank - 1) * 7 + k % 7 + 1).cast("bigint").alias("event_id"),
        text.mask_digits(content).alias("template"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unparsed lines (line_id, value): the log table rendered as text, with every kind of
    flaw mixed in (blank, garbage, unknown level, bad time, level word inside a short line)."""
    code = F.substring_index("content", " ", -1).cast("int") % 25
    label = F.when(F.col("is_anomaly") == 1, "APPFAIL").otherwise("-")
    stamp = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd-HH.mm.ss")
    full = F.concat_ws(
        " ", label, F.col("timestamp").cast("string"), "date", "node", stamp, "node",
        F.lit("RAS"), "component", "level", "content",
    )
    short = F.concat_ws(
        " ", label, F.col("timestamp").cast("string"), "date", F.lit("-"), stamp,
        F.lit("RAS"), "component", "level", "content",
    )
    value = (
        F.when(code == 11, "")
        .when(code == 12, F.concat(F.lit("garbage "), "content"))
        .when(code == 13, F.concat_ws(" ", label, F.col("timestamp").cast("string"), "date", "node",
                                      stamp, "node", F.lit("RAS"), "component", F.lit("DEBUG"), "content"))
        .when(code == 14, F.concat_ws(" ", label, F.lit("12x"), "date", "node", stamp, "node",
                                      F.lit("RAS"), "component", "level", "content"))
        .when(code == 15, F.concat_ws(" ", label, F.lit("99999999999999999999"), "date", "node", stamp,
                                      "node", F.lit("RAS"), "component", "level", "content"))
        .when(code == 16, F.concat_ws(" ", label, F.col("timestamp").cast("string"), "date", F.lit("-"),
                                      stamp, F.lit("RAS"), "component", F.lit("WARNING WARN"), "content"))
        .when(code == 17, F.concat(F.lit("  "), full, F.lit("\t ")))
        .when(F.col("node") == "SYSTEM", short)
        .otherwise(full)
    )
    return logs(spark, sf_dir).select("line_id", value.alias("value"))

"""Raw log text with physical line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.functions.text import strip
from loglens.session import stage

#: A block table up to this many rows (some 200 MB) is broadcast; beyond it is shuffled.
_BROADCAST_BLOCKS = 1_000_000


def text_blocks(reader, path: str) -> DataFrame:
    """(value, file, block): the lines of a text path, batch or stream, with the block that each comes from."""
    return reader.text(path).select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def count_blocks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines with ``place``, and a written table of the lines of each block and those before it."""
    placed = lines.withColumn("place", F.monotonically_increasing_id())
    counted = stage(
        placed.groupBy("file", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows")), "blocks"
    )
    # One row per file block: input bytes / split size, whatever the lines hold.
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    return placed, counted.select(
        "file", "block", "first", "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("skip"))


def number_lines(placed: DataFrame, blocks: DataFrame, start: int = 0) -> DataFrame:
    """(line_id, value): lines numbered from ``start`` in file and position order."""
    if blocks.count() <= _BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    inside = F.col("place") - F.col("first")
    fits = (inside >= 0) & (inside < F.col("rows"))
    changed = F.raise_error(F.lit("file blocks changed between the two passes over the log")).cast("bigint")
    return placed.join(blocks, ["file", "block"], "left").select(
        F.when(F.coalesce(fits, F.lit(False)), F.col("skip") + inside + start).otherwise(changed).alias("line_id"), "value"
    )


def pin_splits(spark: SparkSession) -> None:
    """Two passes over the same files must see the same blocks."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, value): every physical line, numbered from 0 in file and position order.

    A line's number is its place in its file block plus the lines of all earlier blocks, so
    nothing is sorted or shuffled by line. A first pass counts lines per block; the split size
    is pinned so that the second pass sees the same blocks, and a mismatch stops the query.
    """
    pin_splits(spark)
    return number_lines(*count_blocks(text_blocks(spark.read, path)))


def read_raw_log(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines, white space stripped at both ends; blank lines still use up a number."""
    return numbered_lines(spark, path).select("line_id", strip(F.col("value")).alias("value")).where("value <> ''")

"""Raw lines to typed columns.

Both line layouts are sequences of blank-free tokens followed by free text, so one ``split``
with a limit finds every field; no regular expression is run once per field.

full:  label ts date node time node2 type component level content
short: label ts date  -   time       type component level content
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions import text
from loglens.schemas import NO_NODE, VALID_LEVELS

_GAP = text.SPACE + "+"


def _field(parts: Column, position: int) -> Column:
    return F.get(parts, F.lit(position))


def _digits(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^[0-9]+$"), F.lit(False))


def _known_level(token: Column) -> Column:
    return F.coalesce(token.isin(VALID_LEVELS), F.lit(False))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose expression runs once per row. A plain projection would be merged
    into every later use, and the splitting below would then be repeated for each field."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _split(lines: DataFrame) -> DataFrame:
    stripped = _once(lines, "line", text.strip(F.col("value"))).select("line_id", "line")
    return _once(stripped, "parts", F.split("line", _GAP, 10))


def split_lines(lines: DataFrame) -> DataFrame:
    """(line_id, line, parts, fmt): fmt is full, short, reject or blank; parts are its fields."""
    stamp = _field(F.col("parts"), 1)
    readable = _digits(stamp) & stamp.try_cast("bigint").isNotNull()
    is_full = (F.size("parts") == 10) & _known_level(_field(F.col("parts"), 8))
    is_short = (
        (F.size("parts") >= 9)
        & (_field(F.col("parts"), 3) == "-")
        & _known_level(_field(F.col("parts"), 7))
    )
    fmt = (
        F.when(F.col("line") == "", "blank")
        .when(~readable, "reject")
        .when(is_full, "full")
        .when(is_short, "short")
        .otherwise("reject")
    )
    classed = _once(_split(lines), "fmt", fmt).withColumnRenamed("parts", "first_parts")
    return _once(
        classed, "parts", F.when(F.col("fmt") == "short", F.split("line", _GAP, 9)).otherwise(F.col("first_parts"))
    ).select("line_id", "line", "parts", "fmt")


def parse_full(lines: DataFrame) -> DataFrame:
    """The ten fields of every line in the full layout."""
    names = ["label", "ts", "date", "node", "time", "node2", "type", "component", "level", "content"]
    hits = split_lines(lines).where(F.col("fmt") == "full")
    return hits.select("line_id", *[_field(F.col("parts"), i).alias(n) for i, n in enumerate(names)])


def parse_short(lines: DataFrame) -> DataFrame:
    """The nine fields of every line in the short layout that is not also a full one."""
    names = ["label", "ts", "date", "node", "time", "type", "component", "level", "content"]
    hits = split_lines(lines).where(F.col("fmt") == "short")
    return hits.select("line_id", *[_field(F.col("parts"), i).alias(n) for i, n in enumerate(names)])


def node_name(node: Column, fmt: Column) -> Column:
    return F.when((fmt == "short") | (node == "-"), NO_NODE).otherwise(node)


def anomaly_flag(label: Column) -> Column:
    return (label != "-").cast("int")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Accepted lines as typed columns; templates are added by ``operators.templates``."""
    short = F.col("fmt") == "short"
    parts = F.col("parts")

    def either(in_full: int, in_short: int) -> Column:
        return F.when(short, _field(parts, in_short)).otherwise(_field(parts, in_full))

    return (
        split_lines(lines)
        .where(F.col("fmt").isin("full", "short"))
        .select(
            "line_id",
            anomaly_flag(_field(parts, 0)).alias("is_anomaly"),
            _field(parts, 1).cast("bigint").alias("timestamp"),
            _field(parts, 2).alias("date"),
            node_name(_field(parts, 3), F.col("fmt")).alias("node"),
            either(8, 7).alias("level"),
            either(7, 6).alias("component"),
            either(9, 8).alias("content"),
        )
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    return split_lines(lines).where(F.col("fmt") == "reject").select("line_id", "line")


def line_formats(lines: DataFrame) -> DataFrame:
    """Which layout each non-blank line was read with (full is tried before short)."""
    return split_lines(lines).where(F.col("fmt") != "blank").select("line_id", "fmt")


def parse_report(lines: DataFrame) -> DataFrame:
    """One row: accepted and skipped lines, anomaly rate, distinct masked templates."""
    split = split_lines(lines)
    kept = F.col("fmt").isin("full", "short")
    content = F.when(F.col("fmt") == "short", _field(F.col("parts"), 8)).otherwise(_field(F.col("parts"), 9))
    flag = anomaly_flag(_field(F.col("parts"), 0))
    return split.agg(
        F.count_if(kept).alias("total_parsed"),
        F.count_if(F.col("fmt") == "reject").alias("skipped"),
        F.avg(F.when(kept, flag)).alias("anomaly_rate"),
        F.count_distinct(F.when(kept, text.mask_digits(content))).alias("unique_templates"),
    )


def bad_level_lines(lines: DataFrame, limit: int = 20, last_line: int | None = None) -> DataFrame:
    """First lines with ten fields whose level is unknown, for diagnosis.

    The listing shows the first ``limit`` offenders of the whole log, or up to ``last_line``.
    """
    searched = lines if last_line is None else lines.where(F.col("line_id") <= last_line + 1)
    parts = F.col("parts")
    level = _field(parts, 8)
    return (
        _split(searched)
        .where((F.size("parts") == 10) & _digits(_field(parts, 1)) & ~level.isin(VALID_LEVELS))
        .orderBy("line_id")
        .limit(limit)
        .select(
            F.col("line_id").alias("line_num"),
            text.truncate(F.col("line"), 200).alias("raw"),
            level.alias("captured_level"),
            text.truncate(_field(parts, 9), 80).alias("captured_content"),
        )
    )

"""A growing log as a stream of files: numbered, parsed and measured batch by batch.

Every micro-batch adds a part to the ``parsed`` table and a part to ``cells``, the state of all windows:
counts per second and template and per second and node. Cells merge, so the features of any window, also
of windows anchored at the first line or overlapping ones, are those of a batch run over the whole log,
however the log was split and however late a line comes.

A part counts once its batch has a commit record. The record says how many lines all batches up to it have,
so numbering goes on where it ended. A batch that Spark repeats finds its record and is skipped; one
that died before it overwrites what it left. The record also carries the watermark, the latest
time seen less the allowed delay, and the number of lines that came behind it: windows that end before
the watermark are final unless such lines come.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loglens.functions import text
from loglens.operators import panes, windows
from loglens.operators.joins import hot_keys, spread_join
from loglens.operators.parse import parse_lines
from loglens.operators.ranking import dense_ids
from loglens.schemas import RATIO_LEVELS, WINDOW_SECONDS
from loglens.session import stage
from loglens.sources import commits, raw

#: Seconds that a line may be behind the latest one before it counts as late.
DELAY = 3600
_PARSED = ("line_id bigint, is_anomaly int, timestamp bigint, date string, node string, level string, component string, "
           "content string, template string")
_CELLS = ("second bigint, template string, node string, by_event boolean, n bigint, first_ts bigint, last_ts bigint, "
          "anomalous bigint, errors bigint, fatal bigint, severe bigint")


@dataclass(frozen=True)
class Ingested:
    """The tables of one stream, in a folder that every executor reaches."""

    spark: SparkSession
    root: str
    delay: int = DELAY

    def _at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def state(self) -> dict:
        """What the last committed batch says: ``batch`` (-1: none), ``lines``, ``watermark``, ``late``."""
        found = commits.last(self.spark, self._at("commits"))
        return found[1] if found else {"batch": -1, "lines": 0, "latest": None, "watermark": None, "late": 0, "files": None}

    def add(self, lines: DataFrame, batch: int) -> bool:
        """Commit one batch of (value, file, block); False if it is there already."""
        spark, before = self.spark, self.state()
        raw.pin_splits(spark)
        placed, blocks = raw.count_blocks(lines)
        # What the batch consists of, whatever the order of its blocks.
        found = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("lines"), F.coalesce(
            F.bit_xor(F.xxhash64("file", "block", "rows")), F.lit(0)).alias("files")).first()
        if batch <= before["batch"]:
            if commits.get(spark, self._at("commits"), batch)["files"] != found["files"]:
                raise ValueError(f"batch {batch} was committed with other files: use the stream's own checkpoint")
            return False
        if batch != before["batch"] + 1:
            raise ValueError(f"batch {batch} follows {before['batch']}: use the stream's own checkpoint")
        numbered = raw.number_lines(placed, blocks, before["lines"])
        parsed = parse_lines(numbered.where(text.strip(F.col("value")) != "")).withColumn("template", text.mask_digits(F.col("content")))
        self._part("parsed", parsed, batch)
        written = self.spark.read.schema(_PARSED).parquet(self._part_path("parsed", batch))
        cells = panes.pane_cells(written, F.lit(0), 1, "template", "second").select(*[f.split()[0] for f in _CELLS.split(", ")])
        self._part("cells", cells, batch)
        behind = F.col("timestamp") < F.lit(before["watermark"]) if before["watermark"] is not None else F.lit(False)
        seen = written.agg(F.max("timestamp").alias("latest"), F.count_if(behind).alias("late")).first()
        latest = max([t for t in (before["latest"], seen["latest"]) if t is not None], default=None)
        return commits.put_once(spark, self._at("commits"), batch, {
            "batch": batch, "lines": before["lines"] + found["lines"], "files": found["files"], "latest": latest,
            "watermark": None if latest is None else latest - self.delay, "late": before["late"] + seen["late"]})

    def _part_path(self, name: str, batch: int) -> str:
        return self._at(f"{name}/batch={batch}")

    def _part(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self._part_path(name, batch))

    def _read(self, name: str, schema: str, behind: int = -1) -> DataFrame:
        """Parts of committed batches behind one."""
        upto = self.state()["batch"]
        if upto <= behind:
            return self.spark.createDataFrame([], schema)
        whole = self.spark.read.schema(f"{schema}, batch int").option("basePath", self._at(name))
        return whole.parquet(self._at(name)).where((F.col("batch") > behind) & (F.col("batch") <= upto)).drop("batch")

    def lines(self) -> DataFrame:
        """Accepted lines of all committed batches with their masked template."""
        return self._read("parsed", _PARSED)

    def cells(self) -> DataFrame:
        """The state: cells of one second; those of one second and template or node merge."""
        base = commits.current(self.spark, self._at("cells_base"))
        if base is None:
            return self._read("cells", _CELLS)
        upto = commits.made_from(self.spark, self._at("cells_base"))["batch"]
        return self.spark.read.schema(_CELLS).parquet(base).unionByName(self._read("cells", _CELLS, upto))

    def compact(self) -> int:
        """Merge the cells of all committed batches into one table, from which ``cells`` goes on, so that the state
        grows with seconds and templates and not with batches; the last batch in it. Parts stay where they are."""
        upto = self.state()["batch"]
        merged = panes.merge_cells(self.cells(), "second", "template").select(*[f.split()[0] for f in _CELLS.split(", ")])
        commits.publish(self.spark, self._at("cells_base"), lambda place: merged.write.parquet(place), {"batch": upto})
        return upto

    def event_ids(self) -> DataFrame:
        """(template, event_id, n): templates numbered from 1 in their order, read from the state."""
        return stage(dense_ids(self.cells().where("by_event"), "template", "event_id", start=1), "event_ids")

    def parsed(self) -> DataFrame:
        """The ``parsed`` table of a batch run over all committed lines."""
        ids = self.event_ids()
        return spread_join(self.lines(), ids.drop("n"), ["template"], by="line_id", hot=hot_keys(ids, ["template"], "n"))

    def window_cells(self, width: int = WINDOW_SECONDS, step: int | None = None, start: Column | None = None) -> DataFrame:
        """Cells of the windows, from which ``windows.event_counts`` and ``windows.window_meta`` read on."""
        ids = self.event_ids().drop("n")
        cells = panes.regroup(self.cells(), width, step, start, "template")
        by_event = spread_join(cells.where("by_event"), ids, ["template"], by="window_id").drop("template")
        return by_event.unionByName(cells.where("NOT by_event").withColumn("event_id", F.lit(None).cast("bigint")).drop("template"))

    def window_features(self, width: int = WINDOW_SECONDS, step: int | None = None, start: Column | None = None) -> DataFrame:
        """One row for each window, as ``windows.window_features`` gives for the whole log. ``final`` says
        that the watermark has passed its end."""
        begin = start if start is not None else self.cells().agg(F.min("second")).scalar()
        mark = self.state()["watermark"]
        end = begin + F.col("window_id") * (step or width) + width
        final = end <= F.lit(mark) if mark is not None else F.lit(False)
        return windows.window_meta(self.window_cells(width, step, start)).withColumn("final", final)


def stream_log(spark: SparkSession, folder: str, out: Ingested, checkpoint: str, files_per_batch: int | None = None,
               trigger: dict | None = None) -> StreamingQuery:
    """Start a stream from the text files of ``folder`` to the tables of ``out``.

    Files are taken in order of their time of change; within a batch lines are numbered in order of path and
    place, so numbers are those of a batch run if files appear in order of their names. ``trigger``
    is what ``DataStreamWriter.trigger`` takes; by default all that is there is read and the stream ends.
    """
    raw.pin_splits(spark)
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    lines = raw.text_blocks(reader.option("recursiveFileLookup", True), folder)
    return (
        lines.writeStream.foreachBatch(lambda batch, number: out.add(batch, number) and None)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def live_windows(lines: DataFrame, width: int = WINDOW_SECONDS, delay: int = DELAY) -> DataFrame:
    """Windows of a stream of parsed lines, each given out once the watermark passes its end.

    Windows are aligned with the epoch, as a stream has no first line to count from. Spark keeps one
    state row for an open window; lines behind the watermark are left out here, and counted in the
    tables of ``Ingested``.
    """
    level, time = F.col("level"), F.timestamp_seconds("timestamp")
    held = lines.withColumn("time", time).withWatermark("time", f"{delay} seconds").groupBy(F.window("time", f"{width} seconds"))
    return held.agg(
        F.min("timestamp").alias("window_start"), F.max("timestamp").alias("window_end"), F.count(F.lit(1)).alias("total_logs"),
        F.sum("is_anomaly").alias("anomaly_count"), (F.count_if(level.isin(RATIO_LEVELS)) / F.count(F.lit(1))).alias("error_ratio"),
        F.count_if(level == "FATAL").alias("fatal_count"), F.count_if(level == "SEVERE").alias("severe_count"),
        # Nodes and templates are bounded in number; sets merge exactly.
        F.size(F.collect_set("node")).cast("bigint").alias("unique_nodes"),
        F.size(F.collect_set("template")).cast("bigint").alias("unique_templates"),
        (F.sum("is_anomaly") > 0).cast("int").alias("is_anomaly"),
    ).select((F.unix_timestamp(F.col("window.start")) / width).cast("bigint").alias("window_id"), "*").drop("window")


def parsed_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Parsed lines of a folder as a stream without line numbers, for ``live_windows``."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    lines = reader.option("recursiveFileLookup", True).text(folder).select(
        F.lit(0).cast("bigint").alias("line_id"), F.make_valid_utf8("value").alias("value"))
    return parse_lines(lines).drop("line_id").withColumn("template", text.mask_digits(F.col("content")))

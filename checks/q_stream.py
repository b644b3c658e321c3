"""Checks on incremental ingestion: the log arrives in pieces, and one piece is offered twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.context import Inputs
from checks.registry import check
from loglens.operators import windows
from loglens.session import scratch_path
from loglens.sources import raw
from loglens.streaming.ingest import Ingested, stream_log

_PIECES = 4
_DONE: dict[tuple[str, str], Ingested] = {}


def _in_order(lines: DataFrame, low: int, high: int) -> DataFrame:
    """(value) of the lines with numbers from ``low`` to under ``high``, in order. Ranges of
    numbers go to the partitions by arithmetic, so lines are made once: a sort would make them a second time for its sample."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor((F.col("line_id") - low) * parts / max(high - low, 1)).cast("int")
    some = lines.where((F.col("line_id") >= low) & (F.col("line_id") < high))
    return some.repartitionById(parts, place).sortWithinPartitions("line_id").select("value")


def _ingested(x: Inputs) -> Ingested:
    key = (x.spark.sparkContext.applicationId, x.sf_dir)
    if key not in _DONE:
        path = scratch_path(x.spark, "stream")
        out = Ingested(x.spark, f"{path}/out")
        end = x.raw.agg(F.max("line_id")).first()[0] + 1
        for k in range(_PIECES):
            _in_order(x.raw, -(-k * end // _PIECES), -(-(k + 1) * end // _PIECES)).write.text(f"{path}/in/{k}")
            stream_log(x.spark, f"{path}/in", out, f"{path}/checkpoint").awaitTermination()
        out.add(raw.text_blocks(x.spark.read, f"{path}/in/{_PIECES - 1}"), _PIECES - 1)
        _DONE[key] = out
    return _DONE[key]


_PARSED = r"""ingested AS (SELECT *, dense_rank() OVER (ORDER BY template) AS event_id FROM
  (SELECT *, regexp_replace(content, '\S*[0-9]\S*', '<*>', 'g') AS template FROM parsed))"""
_OFFSET = "SELECT *, timestamp - (SELECT min(timestamp) FROM ingested) AS off FROM ingested"
_MEASURES = """min(timestamp) AS window_start, max(timestamp) AS window_end, count(*) AS total_logs,
CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count, count(*) FILTER (level IN ('SEVERE','ERROR','FAILURE','FATAL')) / count(*) AS error_ratio,
count(*) FILTER (level = 'FATAL') AS fatal_count, count(*) FILTER (level = 'SEVERE') AS severe_count,
count(DISTINCT node) AS unique_nodes, count(DISTINCT event_id) AS unique_templates, CAST(sum(is_anomaly) > 0 AS INTEGER) AS is_anomaly"""


@check("S1_incremental_parsed", f"SELECT * FROM (WITH {_PARSED} SELECT * FROM ingested)", "parsed")
def _(x: Inputs):
    return _ingested(x).parsed()


@check("S2_incremental_windows", f"""SELECT * FROM (WITH {_PARSED}
SELECT off // 3600 AS window_id, {_MEASURES} FROM ({_OFFSET}) GROUP BY 1)""", "parsed")
def _(x: Inputs):
    return _ingested(x).window_features().drop("final")


@check("S3_incremental_sliding", f"""SELECT * FROM (WITH {_PARSED}, timed AS ({_OFFSET})
SELECT w.id AS window_id, {_MEASURES} FROM (SELECT unnest(range(0, (SELECT max(off) // 2700 + 1 FROM timed))) AS id) w
JOIN timed ON off >= w.id * 2700 AND off < w.id * 2700 + 5400 GROUP BY 1)""", "parsed")
def _(x: Inputs):
    return _ingested(x).window_features(5400, 2700).drop("final")


@check("S4_incremental_counts", f"""SELECT * FROM (WITH {_PARSED}
SELECT off // 3600 AS window_id, event_id, count(*) AS n FROM ({_OFFSET}) GROUP BY 1, 2)""", "parsed")
def _(x: Inputs):
    return windows.event_counts(_ingested(x).window_cells())

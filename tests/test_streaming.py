"""Incremental ingestion against a batch run over the same log."""

import os

import pytest
from pyspark.sql import functions as F

from checks import inputs
from loglens.operators import panes, templates, windows
from loglens.operators.parse import parse_lines
from loglens.session import stage
from loglens.sources import commits, raw
from loglens.sources.raw import read_raw_log
from loglens.streaming import ingest


@pytest.fixture(scope="module")
def values(spark, sf_dir):
    return [r.value for r in inputs.raw_lines(spark, sf_dir).orderBy("line_id").collect()]


def write(folder, number, lines):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/part-{number:03d}.log"
    with open(path, "w") as out:
        out.writelines(line + "\n" for line in lines)
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
    return path


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def batch_run(spark, folder):
    return stage(templates.mask_templates(parse_lines(read_raw_log(spark, folder))), "batch_run")


def run(spark, folder, out, checkpoint, **more):
    query = ingest.stream_log(spark, folder, out, checkpoint, **more)
    query.awaitTermination()
    assert query.exception() is None


@pytest.mark.parametrize("cuts", [[], [100, 400, 401, 402], [0, 999]])
def test_any_split_gives_the_batch_run(spark, values, tmp_path, cuts):
    """Pieces of any size, empty ones too, with lines out of order in time: the last piece holds the earliest."""
    late = values[:50]
    pieces = [values[a:b] for a, b in zip([50, *[50 + c for c in cuts]], [*[50 + c for c in cuts], len(values)])] + [late]
    folder, out = str(tmp_path / "in"), ingest.Ingested(spark, str(tmp_path / "out"))
    for k, piece in enumerate(pieces):
        write(folder, k, piece)
    run(spark, folder, out, str(tmp_path / "check"), files_per_batch=1)
    parsed = batch_run(spark, folder)
    assert rows(out.parsed()) == rows(parsed)
    assert out.state()["lines"] == len(values)
    for width, step in ((3600, None), (3600, 1800), (5400, 3600)):
        assert rows(out.window_features(width, step).drop("final")) == rows(windows.window_features(parsed, width, step))
    assert rows(windows.event_counts(out.window_cells())) == rows(windows.event_counts(windows.window_cells(parsed)))


def test_restart_goes_on_numbering_and_counts_late_lines(spark, values, tmp_path):
    folder, out = str(tmp_path / "in"), ingest.Ingested(spark, str(tmp_path / "out"), delay=600)
    write(folder, 0, values[300:600])
    run(spark, folder, out, str(tmp_path / "check"))
    first = out.state()
    assert first["batch"] == 0 and first["lines"] == 300 and first["late"] == 0
    assert out.window_features().where("final").count() < out.window_features().count()
    write(folder, 1, values[600:])
    write(folder, 2, values[:300])
    run(spark, folder, out, str(tmp_path / "check"), files_per_batch=1)
    assert out.state()["batch"] == 2 and out.state()["late"] > 0
    assert rows(out.parsed()) == rows(batch_run(spark, folder))


def blocks(spark, path):
    return raw.text_blocks(spark.read, path)


def test_repeated_and_broken_batches(spark, values, tmp_path, monkeypatch):
    folder, out = str(tmp_path / "in"), ingest.Ingested(spark, str(tmp_path / "out"))
    one, two = write(folder, 0, values[:500]), write(folder, 1, values[500:])
    assert out.add(blocks(spark, one), 0)
    # It dies between the tables and the record: the batch isn't there.
    with monkeypatch.context() as broken:
        broken.setattr(commits, "put_once", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            out.add(blocks(spark, two), 1)
    assert out.state()["batch"] == 0 and rows(out.parsed()) == rows(batch_run(spark, one))
    assert out.add(blocks(spark, two), 1)
    # Spark repeats a batch whose end it didn't write down.
    assert not out.add(blocks(spark, two), 1) and not out.add(blocks(spark, one), 0)
    assert rows(out.parsed()) == rows(batch_run(spark, folder))
    with pytest.raises(ValueError, match="other files"):
        out.add(blocks(spark, two), 0)
    with pytest.raises(ValueError, match="follows"):
        out.add(blocks(spark, two), 7)


def test_compacted_state_goes_on(spark, values, tmp_path):
    folder, out = str(tmp_path / "in"), ingest.Ingested(spark, str(tmp_path / "out"))
    paths = [write(folder, k, values[k * 200 : (k + 1) * 200]) for k in range(5)]
    for k, path in enumerate(paths):
        assert out.add(blocks(spark, path), k)
        if k in (1, 2):
            before = rows(out.window_features())
            assert out.compact() == k and rows(out.window_features()) == before
    parsed = batch_run(spark, folder)
    assert rows(out.parsed()) == rows(parsed)
    assert rows(out.window_features(3600, 1800).drop("final")) == rows(windows.window_features(parsed, 3600, 1800))
    plain = out._read("cells", ingest._CELLS)
    assert out.cells().count() <= plain.count()


def test_nothing_yet(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    out = ingest.Ingested(spark, str(tmp_path / "out"))
    assert out.parsed().collect() == [] and out.window_features().collect() == []
    write(str(tmp_path / "in"), 0, ["", "garbage", "  "])
    run(spark, str(tmp_path / "in"), out, str(tmp_path / "check"))
    assert out.state()["lines"] == 3 and out.state()["watermark"] is None
    assert out.parsed().collect() == [] and out.window_features().collect() == []


def test_live_windows_come_out_once(spark, values, tmp_path):
    """Lines in order of time: every window behind the watermark equals the batch run's."""
    folder = str(tmp_path / "in")
    parsed = batch_run(spark, write(folder, 0, values))
    ordered = [r.value for r in read_raw_log(spark, folder).join(parsed.select("line_id", "timestamp"), "line_id").orderBy("timestamp", "line_id").collect()]
    for k in range(5):
        write(folder, k, ordered[k * len(ordered) // 5 : (k + 1) * len(ordered) // 5])
    live = ingest.live_windows(ingest.parsed_stream(spark, folder, files_per_batch=1), delay=7200)
    query = live.writeStream.format("parquet").option("path", str(tmp_path / "windows")).option(
        "checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "windows"))
    want = windows.window_meta(panes.window_cells(parsed, 3600, start=F.lit(0)))
    mark = parsed.agg(F.max("timestamp")).first()[0] - 7200
    closed = want.where((F.col("window_id") + 1) * 3600 <= mark)
    assert rows(got) == rows(closed.select(*got.columns)) and got.count() > 10


def test_records_are_given_out_once(spark, tmp_path):
    folder = str(tmp_path / "records")
    assert commits.last(spark, folder) is None
    assert commits.put_once(spark, folder, 3, {"a": "é"}) and not commits.put_once(spark, folder, 3, {"a": "other"})
    assert commits.put_once(spark, folder, 11, {"a": 2})
    assert commits.numbers(spark, folder) == [3, 11] and commits.get(spark, folder, 3) == {"a": "é"}
    assert commits.last(spark, folder) == (11, {"a": 2})


def test_pieces_are_written_in_order_without_a_sample(spark, tmp_path):
    """A sort by ranges makes every line twice, once for its sample."""
    from checks.q_stream import _in_order

    lines = spark.range(0, 5000, 3).selectExpr("id AS line_id", "string(id) AS value").orderBy(F.xxhash64("line_id"))
    whole = []
    for low, high in ((0, 1250), (1250, 2500), (2500, 3750), (3750, 5001)):
        piece = _in_order(lines, low, high)
        assert "rangepartitioning(line_id" not in piece._jdf.queryExecution().executedPlan().toString()
        piece.write.text(f"{tmp_path}/{low}")
        for part in sorted((tmp_path / str(low)).glob("part-*")):
            whole.extend(int(line) for line in part.read_text().split())
    assert whole == list(range(0, 5000, 3))

import pytest
from pyspark.sql import functions as F

from loglens.functions import text
from loglens.operators import parse
from loglens.sources.raw import numbered_lines, read_raw_log

GOLDEN = [
    ("- 1117838570 2005.06.03 R02-M1 2005-06-03-15.42 R02-M1 RAS KERNEL INFO cache parity error corrected", "full"),
    ("APPREAD 1117869872 2005.06.04 - 2005-06-04-00.24 RAS APP FATAL ciod: failed to read", "short"),
    ("- 1 d - t n2 RAS KERNEL INFO x", "full"),
    ("- 1 d - t RAS KERNEL WARNING WARN y", "full"),
    ("- 1 d n t n2 RAS KERNEL WARNING z z", "full"),
    ("garbage", "reject"),
    ("", "blank"),
    ("- 12x d n t n RAS K INFO a", "reject"),
    ("- 1 d n t n2 RAS K DEBUG a", "reject"),
    ("- 1 d n t n2 RAS K INFO", "reject"),
    ("- 99999999999999999999 d n t n2 RAS K INFO a", "reject"),
    ("- 1 d n t n2 RAS K INFO a", "full"),
    ("  - 1 d n t n2 RAS K INFO a  b \t", "full"),
    ("\u3000- 1 d n t n2\u00a0RAS K INFO\u2003a\x1c", "full"),
]


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([(i, line) for i, (line, _) in enumerate(GOLDEN)], "line_id bigint, value string")


def test_golden_classes(lines):
    got = {r.line_id: r.fmt for r in parse.split_lines(lines).collect()}
    assert got == {i: fmt for i, (_, fmt) in enumerate(GOLDEN)}


def test_golden_fields(lines):
    rows = {r.line_id: r for r in parse.parse_lines(lines).collect()}
    assert rows[0].node == "R02-M1" and rows[0].is_anomaly == 0 and rows[0].content == "cache parity error corrected"
    assert rows[1].node == "SYSTEM" and rows[1].is_anomaly == 1 and rows[1].level == "FATAL"
    assert rows[2].node == "SYSTEM"
    assert (rows[3].level, rows[3].content) == ("WARN", "y")
    assert rows[4].level == "WARNING" and rows[4].content == "z z"
    assert rows[12].content == "a  b"
    assert rows[13].content == "a"


def test_white_space_is_that_of_python(spark):
    chars = [chr(c) for c in range(1, 0x3100)]
    df = spark.createDataFrame([(ord(c), f"{c}x{c}", f"a{c}b") for c in chars], "c int, s string, t string")
    got = df.select("c", (F.length(text.strip(F.col("s"))) == 1).alias("s"),
                    (F.size(F.split("t", text.SPACE)) == 2).alias("t")).collect()
    assert {r.c for r in got if r.s} == {r.c for r in got if r.t} == {ord(c) for c in chars if c.isspace()}


def test_report_and_bad_levels(lines):
    report = parse.parse_report(lines).first()
    assert (report.total_parsed, report.skipped) == (8, 5)
    # A short line also has ten tokens; the listing then shows its first content word as level.
    bad = parse.bad_level_lines(lines).collect()
    assert [(r.line_num, r.captured_level) for r in bad] == [(1, "ciod:"), (8, "DEBUG")]


@pytest.mark.parametrize("split", ["134217728", "300"])
def test_line_numbers_survive_splits(spark, tmp_path, split):
    """Several files, blank lines, bad bytes; also with blocks of a few lines each."""
    expected, at = [], 0
    for f in range(3):
        body = b""
        for i in range(57):
            text = b"" if i % 9 == 4 else b"file %d line %d \xff\xfe tail" % (f, i)
            body += text + b"\n"
            if text:
                expected.append((at, text.decode("utf-8", "replace")))
            at += 1
        (tmp_path / f"part-{f}.log").write_bytes(body)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((r.line_id, r.value) for r in read_raw_log(spark, str(tmp_path)).collect())
        total = numbered_lines(spark, str(tmp_path)).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == expected and total == at


def test_plan_splits_each_line_once(spark, lines, capsys):
    parse.parse_lines(lines).explain()
    plan = capsys.readouterr().out
    assert plan.count("split(") <= 3

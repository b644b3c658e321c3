"""Search with an index of trigrams against a scan."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from loglens.operators import filters, search_index
from loglens.sources import tables


def bitmap(text):
    held = np.zeros(search_index.BITS, dtype=np.uint8)
    low = text.translate(str.maketrans(search_index._ODD)).lower()
    held[search_index._places(search_index._codes(low.encode()))] = 1
    return np.packbits(held, bitorder="little")


PIECES = ["err", "or", "disk", "[0-9]+", "(fan|pump) on", "a{2,}", "x?", "\\d", "\\bnode", "(?:up|down)+", "colou?r", ".*", "^start", "é", "[abc]d", "(?i:Mix)", "k"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=4).map("".join), st.lists(st.sampled_from(
    ["err", "or", "disk", "123", "fan on", "pump on", "aa", "x", "7", " node", "up", "downup", "color", "colour", "start", "é", "bd", "MIX", "K", "k"]), max_size=8).map("".join))
def test_every_match_has_what_its_pattern_needs(pattern, text):
    if re.search(pattern, text, re.IGNORECASE):
        assert search_index.holds(search_index.needed_by_regex(pattern), bitmap(text))


@pytest.mark.parametrize("pattern", ["", "ab", "a.b", "(abc|)", "abc|de", "(?x) a b c", "\\Qabc\\E", "[a[b]]cde", "abc&&def", "\\p{L}bcd", "(abc)*", "(", "\\0101bc"])
def test_nothing_is_needed_where_nothing_is_certain(pattern):
    assert search_index.needed_by_regex(pattern) is None


def test_alternatives_and_wildcards():
    need = search_index.needed_by_regex("(panic|fatal) at")
    assert search_index.holds(need, bitmap("kernel PANIC at 3")) and search_index.holds(need, bitmap("fatal at"))
    assert not search_index.holds(need, bitmap("error at"))
    assert search_index.needed_by_substring("ab%cd_e") is None and search_index.needed_by_substring(None) is None
    assert not search_index.holds(search_index.needed_by_substring("disk%full"), bitmap("disk empty"))


@pytest.fixture
def table(spark, tmp_path):
    """40 files of lines; a few words are in one file only."""
    draw, rows = random.Random(8), []
    for f in range(40):
        for k in range(30):
            words = [draw.choice(["disk", "read", "retry", "ok", "FAN", "node"]) for _ in range(5)]
            if k == 7 and f in (3, 21):
                words.append("Kernel panic ſpeed İstanbul 100% done")
            rows.append((f, " ".join(words) if k % 13 else None))
    path = str(tmp_path / "logs")
    lines = spark.createDataFrame([(f * 100 + k, f, t) for k, (f, t) in enumerate(rows)], "line_id bigint, f int, content string")
    tables.write_table(lines.repartitionByRange(40, "f"), path)
    return path, str(tmp_path / "index")


def rows_of(df):
    return sorted(r.line_id for r in df.collect())


def test_search_equals_the_scan_and_skips_files(spark, table):
    path, place = table
    index, whole = search_index.Index(spark, path, place), tables.read_table(spark, path)
    assert rows_of(index.substring("panic")) == rows_of(whole.where(filters.search_substring("panic")))  # no index yet: a scan
    assert index.refresh() == 40 and index.refresh() == 0
    for needle in ("panic", "KERNEL", "100%", "a", "", None, "retry", "nothing here", "speed", "istanbul", "k%c", "İst"):
        assert rows_of(index.substring(needle)) == rows_of(whole.where(filters.all_of([filters.search_substring(needle)])))
    for pattern in ("panic|fatal", "kernel\\s+p.nic", "speed", "istanbul", "disk (read|ok)", "x", None, "no[ne] such", "pan[aeiou]c"):
        assert rows_of(index.regex(pattern)) == rows_of(whole.where(filters.all_of([filters.search_regex(pattern)])))
    assert len(index.files(search_index.needed_by_substring("panic"))) == 2 and len(index.substring("panic").inputFiles()) == 2
    assert len(index.files(search_index.needed_by_regex("kernel (panic|oops)"))) == 2
    assert len(index.files(search_index.needed_by_substring("ab"))) == 40
    assert index.files(search_index.needed_by_substring("zzzzzz")) == []


def test_newer_files_are_searched(spark, tmp_path):
    path, place = str(tmp_path / "logs"), str(tmp_path / "index")
    spark.createDataFrame([(1, "alpha beta")], "line_id bigint, content string").coalesce(1).write.parquet(path)
    index = search_index.Index(spark, path, place)
    index.refresh()
    spark.createDataFrame([(2, "alpha gamma")], "line_id bigint, content string").coalesce(1).write.mode("append").parquet(path)
    assert rows_of(index.substring("gamma")) == [2] and index.refresh() == 1 and rows_of(index.substring("gamma")) == [2]
    tables.write_table(spark.createDataFrame([(3, "delta")], "line_id bigint, content string").coalesce(1), str(tmp_path / "versioned"))
    other = search_index.Index(spark, str(tmp_path / "versioned"), str(tmp_path / "other"))
    assert other.refresh() == 1
    tables.write_table(spark.createDataFrame([(4, "epsilon")], "line_id bigint, content string").coalesce(1), str(tmp_path / "versioned"))
    assert rows_of(other.substring("epsilon")) == [4] and rows_of(other.substring("delta")) == []
    assert other.refresh() == 1 and len(tables.read_table(spark, str(tmp_path / "other")).collect()) == 1

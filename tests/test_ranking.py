from pyspark.sql import functions as F

from loglens.operators import ranking
from loglens.plans import endpoints


def test_dense_ids(spark):
    words = [f"k{i * 37 % 211:03d}" for i in range(211)] * 2
    df = spark.createDataFrame([(w,) for w in words], "k string")
    got = sorted((r.k, r.id) for r in ranking.dense_ids(df, "k", "id", start=1).collect())
    assert got == [(k, i + 1) for i, k in enumerate(sorted(set(words)))]


def test_numbered_pages_with_gaps_and_skew(spark):
    keys = list(range(1000)) + [10**12 + 3 * i for i in range(700)]
    df = spark.createDataFrame([(k,) for k in keys], "line_id bigint")
    for page in (1, 7, 18, 35):
        got = [r.line_id for r in ranking.numbered_page(df, "line_id", page, size=50, small=60).collect()]
        assert got == keys[(page - 1) * 50:page * 50]


def test_quantile_at(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 1, 8, 5, 9, 2]], "v double")
    for q in (0.0, 0.31, 0.5, 0.95, 1.0):
        want = df.agg(F.percentile("v", F.lit(q))).first()[0]
        assert abs(ranking.quantile_at(df, "v", F.lit(q)).first()[0] - want) < 1e-12


def test_quantile_of_one_value(spark):
    df = spark.createDataFrame([(2.5,), (2.5,)], "v double")
    assert ranking.quantile_at(df, "v", F.lit(0.7)).first()[0] == 2.5


def test_page_limits(spark):
    df = spark.range(1)
    for limit in (0, 1001):
        try:
            endpoints.logs_page(df, limit=limit)
        except ValueError:
            continue
        raise AssertionError("limit accepted")


def test_filters_and_columns_reach_the_scan(spark, sf_dir, tmp_path, capsys):
    from checks import inputs
    from loglens.schemas import PARSED
    from loglens.sources import tables

    path = str(tmp_path / "parsed")
    tables.write_table(inputs.logs(spark, sf_dir), path)
    parsed = tables.read_table(spark, path, PARSED)
    endpoints.logs_total(parsed, level="FATAL", anomaly_only=True).explain()
    plan = capsys.readouterr().out
    assert "EqualTo(level,FATAL)" in plan and "EqualTo(is_anomaly,1)" in plan
    assert "ReadSchema: struct<is_anomaly:int,level:string>" in plan
    endpoints.logs_page(parsed, level="FATAL").explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_exact_quantiles_with_an_outlier(spark, monkeypatch):
    """Brackets by rank: one value of 1e12 changes nothing but the last rank."""
    import random

    from loglens.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", 40)
    draw = random.Random(2)
    values = [draw.random() for _ in range(3000)] + [0.5] * 900 + [1e12, -1e9] + [draw.choice([0.1, 0.9]) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    ordered = sorted(values)
    ranks = [0, 1, 17, 1500, 2299, 2300, 4000, len(values) - 2, len(values) - 1, len(values)]
    assert quantiles.at_ranks(df, "v", ranks) == {r: ordered[r] for r in ranks[:-1]}
    levels = [0.0, 0.25, 0.7, 0.85, 0.95, 1.0]
    want = df.agg(*[F.percentile("v", F.lit(q)) for q in levels]).first()
    assert quantiles.exact(df, "v", levels) == list(want)


def test_exact_quantiles_of_two_values(spark, monkeypatch):
    from loglens.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", 1)
    df = spark.createDataFrame([(1.0,)] * 700 + [(2.0,)] * 300, "v double")
    assert quantiles.at_ranks(df, "v", [0, 699, 700, 999]) == {0: 1.0, 699: 1.0, 700: 2.0, 999: 2.0}


def test_exact_quantiles_between_two_frequent_values(spark, monkeypatch):
    from loglens.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", 2)
    values = [1.0] * 400 + [1.5, 1.75, 1.8, 1.9] + [2.0] * 300 + [float("inf")] * 20 + [float("nan")] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = quantiles.at_ranks(df, "v", [0, 399, 400, 402, 404, 703, 704, 728])
    assert got == {0: 1.0, 399: 1.0, 400: 1.5, 402: 1.8, 404: 2.0, 703: 2.0, 704: float("inf"), 728: float("inf")}


def test_exact_quantiles_of_nothing(spark):
    from loglens.operators import quantiles

    none = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact(none, "v", [0.5]) == [None] and quantiles.at_ranks(none, "v", [0]) == {}
    assert quantiles.row(none, "v", {"p": 0.5}).first().p is None


def test_running_sums_with_an_outlier(spark):
    rows = [(float(k % 400), 1) for k in range(2000)] + [(1e12, 5)]
    got = ranking.running_sums(spark.createDataFrame(rows, "v double, n int"), "v", {"n": F.sum("n")}).orderBy("v").collect()
    total = 0
    for r in got:
        total += 5
        assert (r.n, r.cum_n) == (5, total)
    assert len(got) == 401


def test_deep_pages(spark, monkeypatch):
    monkeypatch.setattr(ranking, "DEEP", 10)
    rows = [(k * 7 % 1000, [0.5, 0.25, None, 0.125 + k / 10_000][k % 4]) for k in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, score double")
    by_id = sorted(rows)
    by_score = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for offset in (0, 5, 10, 11, 240, 249, 251, 499, 505, 740, 752, 995, 1000, 2000):
        assert [tuple(r) for r in ranking.key_page(df, "id", 30, offset).collect()] == by_id[offset : offset + 30]
        assert [tuple(r) for r in ranking.ranked_page(df, "score", "id", 30, offset).collect()] == by_score[offset : offset + 30]

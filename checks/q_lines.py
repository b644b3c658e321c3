"""Checks on sources, parsing, filters, scalar functions and line-level queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.context import Inputs
from checks.registry import check
from loglens.functions import text, values
from loglens.operators import filters, parse, ranking, search_index, templates, windows
from loglens.plans import dashboard, endpoints
from loglens.schemas import PARSED
from loglens.session import scratch_path, stage
from loglens.sources import datasets, documents, models, raw, tables

# --- A: sources and sinks ----------------------------------------------------------------


def _raw_file(x: Inputs) -> str:
    path = scratch_path(x.spark, "rawlog")
    x.raw.orderBy("line_id").select("value").write.text(path)
    return path


@check("A1_read_raw_log", "SELECT line_id, line AS value FROM stripped WHERE line <> ''", "stripped")
def _(x: Inputs):
    return raw.read_raw_log(x.spark, _raw_file(x))


@check("A2_read_table", "SELECT level, component, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM logs GROUP BY 1, 2", "logs")
def _(x: Inputs):
    path = scratch_path(x.spark, "parsed")
    tables.write_table(x.logs, path)
    return tables.read_table(x.spark, path, PARSED).groupBy("level", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@check("A3_named_views", """SELECT l.level, count(*) AS n, (SELECT count(*) FROM meta) AS windows FROM logs l GROUP BY 1""",
       "logs", "meta")
def _(x: Inputs):
    tables.register_views(x.logs, x.meta)
    return x.spark.sql("SELECT level, count(*) AS n, (SELECT count(*) FROM wins) AS windows FROM logs GROUP BY level")


@check("A4_query_in_place", """SELECT count(*) AS total_logs, CAST(sum(is_anomaly) AS BIGINT) AS anomalous_lines,
round(avg(is_anomaly) * 100, 2) AS anomaly_rate_pct, count(DISTINCT event_id) AS unique_templates FROM logs""", "logs")
def _(x: Inputs):
    path = scratch_path(x.spark, "parsed")
    tables.write_table(x.logs, path)
    return tables.query_file(x.spark, path, """
        SELECT count(*) AS total_logs, sum(CAST(is_anomaly AS BIGINT)) AS anomalous_lines,
               round(avg(is_anomaly) * 100, 2) AS anomaly_rate_pct, count(DISTINCT event_id) AS unique_templates
        FROM {table}""")


@check("A5_write_table", "SELECT * FROM logs", "logs")
def _(x: Inputs):
    path = scratch_path(x.spark, "parsed")
    tables.write_table(x.logs.limit(0), path)
    tables.write_table(x.logs, path)
    return tables.read_table(x.spark, path, PARSED)


@check("A8_model_tables", """SELECT t.tree, CAST(least(256, n) AS BIGINT) AS psi, CAST(least(256, n) AS BIGINT) AS leaf_rows, true AS bounded,
true AS binary_tree FROM (SELECT unnest(range(0, 200)) AS tree) t, (SELECT count(*) AS n FROM meta)""", "meta")
def _(x: Inputs):
    from loglens.operators import forest

    n = x.meta.agg(F.count(F.lit(1))).scalar()
    stats = windows.scaler_stats(x.features, n)
    trees = forest.fit_isolation_forest(x.features, x.meta.select("window_id"))
    path = scratch_path(x.spark, "model")
    models.save_model(models.Model(trees, stats, stats.select("feature")), path)
    model = models.load_model(x.spark, path)
    return forest.tree_facts(model.trees)


@check("A9_stage_reuse", "SELECT window_id, event_id, n FROM counts", "counts")
def _(x: Inputs):
    path = scratch_path(x.spark, "features")
    tables.materialize(x.spark, path, lambda: x.counts)
    return tables.materialize(x.spark, path, lambda: x.counts.limit(0), "skip")


@check("A10_list_datasets", """SELECT 'logs' AS name, 'derived log table' AS description, 'ready' AS status,
['alerts', 'metrics', 'parsed', 'scores'] AS files FROM (SELECT 1 FROM logs LIMIT 1)""", "logs")
def _(x: Inputs):
    folder = scratch_path(x.spark, "dataset")
    tables.write_table(x.logs, f"{folder}/parsed.parquet")
    found = datasets.list_datasets(x.spark, {"logs": folder, "absent": folder + "-none"}, {"logs": "derived log table"})
    return found.withColumn("files", F.array_sort(F.map_keys("files")))


@check("A11_missing_input", "SELECT count(*) AS total_logs FROM logs", "logs")
def _(x: Inputs):
    path = scratch_path(x.spark, "parsed")
    try:
        tables.require(x.spark, path, "ingest")
    except FileNotFoundError:
        tables.write_table(x.logs, path)
    return tables.read_table(x.spark, tables.require(x.spark, path, "ingest")).agg(F.count(F.lit(1)).alias("total_logs"))


# --- B: parsing, projections, filters -----------------------------------------------------


@check("B1_parse_full", "SELECT line_id, unnest(p) FROM full_parts", "full_parts")
def _(x: Inputs):
    return parse.parse_full(x.raw)


@check("B2_parse_short", "SELECT line_id, '-' AS node, unnest(p) FROM short_parts", "short_parts")
def _(x: Inputs):
    return parse.parse_short(x.raw)


@check("B3_first_match_wins", "SELECT line_id, fmt FROM formats WHERE fmt <> 'blank'", "formats")
def _(x: Inputs):
    return parse.line_formats(x.raw)


@check("B4_normalise_node", "SELECT node, count(*) AS n FROM parsed GROUP BY 1", "parsed")
def _(x: Inputs):
    return parse.parse_lines(x.raw).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@check("B5_label_flag", "SELECT line_id, is_anomaly FROM parsed", "parsed")
def _(x: Inputs):
    return parse.parse_lines(x.raw).select("line_id", "is_anomaly")


@check("B6_timestamp_cast", "SELECT line_id, timestamp FROM parsed", "parsed")
def _(x: Inputs):
    return parse.parse_lines(x.raw).select("line_id", "timestamp")


@check("B6b_parse_lines", "SELECT * FROM parsed", "parsed")
def _(x: Inputs):
    return parse.parse_lines(x.raw)


@check("B7_parse_report", r"""SELECT (SELECT count(*) FROM parsed) AS total_parsed,
(SELECT count(*) FROM formats WHERE fmt = 'reject') AS skipped, (SELECT avg(is_anomaly) FROM parsed) AS anomaly_rate,
(SELECT count(DISTINCT regexp_replace(content, '\S*[0-9]\S*', '<*>', 'g')) FROM parsed) AS unique_templates""",
       "formats", "parsed")
def _(x: Inputs):
    return parse.parse_report(x.raw)


@check("B7b_rejected_lines", "SELECT line_id, line FROM formats WHERE fmt = 'reject'", "formats")
def _(x: Inputs):
    return parse.rejected_lines(x.raw)


@check("B8_bad_levels", """SELECT line_id AS line_num, left(line, 200) AS raw, p.level AS captured_level,
left(p.content, 80) AS captured_content FROM loose_parts WHERE line_id <= 4500001 AND p.level NOT IN
  ('INFO','WARN','WARNING','ERROR','FATAL','SEVERE','FAILURE','CRITICAL') ORDER BY line_id LIMIT 20""", "loose_parts")
def _(x: Inputs):
    return parse.bad_level_lines(x.raw)


@check("B9_level_equals", "SELECT line_id, level, content FROM logs WHERE level = 'FATAL'", "logs")
def _(x: Inputs):
    return x.logs.where(filters.level_is("FATAL")).select("line_id", "level", "content")


@check("B10_level_in", "SELECT line_id, level FROM logs WHERE level IN ('FATAL', 'SEVERE')", "logs")
def _(x: Inputs):
    return x.logs.where(filters.all_of([filters.level_in(["FATAL", "SEVERE"])])).select("line_id", "level")


@check("B11_show_flag", """SELECT 'all' AS which, count(*) AS n FROM logs UNION ALL SELECT 'anomalies', count(*) FROM logs
WHERE is_anomaly = 1 UNION ALL SELECT 'normal', count(*) FROM logs WHERE is_anomaly = 0""", "logs")
def _(x: Inputs):
    parts = [
        x.logs.where(filters.all_of([filters.show(w)])).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(w).alias("which"), "n") for w in ("all", "anomalies", "normal")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("B12_search_substring", "SELECT doc_id FROM documents WHERE text ILIKE '%THE%ER_%'")
def _(x: Inputs):
    return x.table("documents").where(filters.search_substring("THE%ER_", "text")).select("doc_id")


@check("B13_search_regex", "SELECT line_id, content FROM logs WHERE regexp_matches(content, '(?i)ERROR.*[ad] code [1-4]')", "logs")
def _(x: Inputs):
    return x.logs.where(filters.search_regex("ERROR.*[ad] code [1-4]")).select("line_id", "content")


@check("B16_window_slice", "SELECT line_id, timestamp FROM logs WHERE timestamp >= 1704153600 AND timestamp < 1704240000", "logs")
def _(x: Inputs):
    return x.logs.where(filters.between_times(1704153600, 1704240000)).select("line_id", "timestamp")


@check("B17_conjunction", """SELECT line_id, level, content FROM logs WHERE level = 'SEVERE' AND is_anomaly = 0
AND content ILIKE '%shard a%' AND timestamp < 1705000000""", "logs")
def _(x: Inputs):
    return x.logs.where(filters.all_of([
        filters.level_is("SEVERE"), filters.show("normal"), filters.search_substring("shard a"),
        F.col("timestamp") < 1705000000, filters.level_in(None),
    ])).select("line_id", "level", "content")


# --- D/F: line-level aggregates and pages ---------------------------------------------------


@check("D8_line_totals", """SELECT count(*) AS total_logs, CAST(sum(is_anomaly) AS BIGINT) AS anomalous_lines,
round(avg(is_anomaly) * 100, 2) AS anomaly_rate_pct, count(DISTINCT event_id) AS unique_templates FROM logs""", "logs")
def _(x: Inputs):
    return endpoints.line_totals(x.logs)


@check("D10_value_counts", "SELECT level, count(*) AS count FROM logs GROUP BY 1", "logs")
def _(x: Inputs):
    return ranking.value_counts(x.logs, "level")


@check("D11_top_templates", """SELECT event_id, template, count(*) AS count, left(template, 55) AS short FROM logs
GROUP BY 1, 2 ORDER BY count DESC, event_id LIMIT 15""", "logs")
def _(x: Inputs):
    return dashboard.top_templates(x.logs)


@check("D29_view_stats", """SELECT count(*) AS rows, count(*) FILTER (is_anomaly = 1) AS anomalous,
count(*) FILTER (is_anomaly = 0) AS normal, avg(is_anomaly) AS rate, printf('%.2f%%', avg(is_anomaly) * 100) AS rate_text
FROM logs WHERE level IN ('FATAL', 'SEVERE') AND regexp_matches(content, '(?i)SHARD [a-c]')""", "logs")
def _(x: Inputs):
    return dashboard.view_stats(dashboard.log_view(x.logs, "all", ["FATAL", "SEVERE"], "SHARD [a-c]"))


@check("D29b_view_stats_empty", """SELECT 0::BIGINT AS rows, 0::BIGINT AS anomalous, 0::BIGINT AS normal,
CAST(NULL AS DOUBLE) AS rate, 'N/A' AS rate_text""")
def _(x: Inputs):
    return dashboard.view_stats(dashboard.log_view(x.logs, "all", ["CRITICAL"], None))


@check("D31_first_value", "SELECT level, arg_min(template, line_id) AS template FROM logs GROUP BY 1", "logs")
def _(x: Inputs):
    return ranking.first_by(x.logs, ["level"], "template", "line_id")


@check("D32_distinct_sorted", "SELECT DISTINCT level FROM logs ORDER BY 1", "logs")
def _(x: Inputs):
    return filters.options(x.logs, "level")


@check("D32b_cluster_options", "SELECT DISTINCT cluster_id FROM placed ORDER BY 1", "placed")
def _(x: Inputs):
    return filters.options(x.placed, "cluster_id")


@check("D12_mode", """SELECT node, template, n FROM (SELECT node, template, count(*) AS n, row_number() OVER (PARTITION BY node
ORDER BY count(*) DESC, template) AS r FROM logs GROUP BY 1, 2) WHERE r = 1""", "logs")
def _(x: Inputs):
    counts = x.logs.groupBy("node", "template").agg(F.count(F.lit(1)).alias("n"))
    return ranking.mode_of(counts, ["node"], "template")


_PAGE = "line_id, date, node, level, is_anomaly, template, content"


@check("F1_sort_by_time", "SELECT timestamp, line_id, level FROM logs ORDER BY timestamp, line_id", "logs")
def _(x: Inputs):
    """Only as an explicit output: windowing itself needs no order."""
    return ranking.in_time_order(x.logs).select("timestamp", "line_id", "level")


@check("F2_logs_page", f"""SELECT {_PAGE} FROM logs WHERE level = 'SEVERE' AND content ILIKE '%error on shard%'
ORDER BY line_id LIMIT 100 OFFSET 40""", "logs")
def _(x: Inputs):
    return endpoints.logs_page(x.logs, level="SEVERE", search="error on shard", limit=100, offset=40)


@check("F2b_logs_total", "SELECT count(*) AS total FROM logs WHERE is_anomaly = 1 AND content ILIKE '%shard b%'", "logs")
def _(x: Inputs):
    return endpoints.logs_total(x.logs, anomaly_only=True, search="shard b")


@check("F5_window_logs", """SELECT node, level, is_anomaly, template, content, timestamp FROM logs
WHERE timestamp >= 1704153600 AND timestamp < 1704160800 ORDER BY timestamp, line_id LIMIT 50""", "logs")
def _(x: Inputs):
    return endpoints.window_logs(x.logs, 1704153600, 1704160800)


@check("F7_head", """SELECT node, level, is_anomaly, template, content FROM logs WHERE timestamp >= 1704153600
AND timestamp < 1704240000 ORDER BY line_id LIMIT 20""", "logs")
def _(x: Inputs):
    rows = x.logs.where(filters.between_times(1704153600, 1704240000))
    return ranking.head(rows, 20, "node", "level", "is_anomaly", "template", "content")


@check("F2b_logs_deep_page", f"SELECT {_PAGE} FROM logs WHERE is_anomaly = 0 ORDER BY line_id LIMIT 1000 OFFSET 8000", "logs")
def _(x: Inputs):
    """By counting, as offsets from 20,000 on."""
    rows = x.logs.where(filters.show("normal")).select(*_PAGE.split(", "))
    return ranking._narrowed(rows, "line_id", 8000, 9000, small=500)


_NEEDLES = ["error on shard c", "%b code 9_", "no such text", "de"]
_PATTERNS = ["(click|view) on shard [ab] code 1[0-9]$", "shard (x|y)", "sign"]


def _indexed(x: Inputs) -> search_index.Index:
    path = scratch_path(x.spark, "searched")
    tables.write_table(x.logs.repartitionByRange(16, "template", "line_id"), path)
    index = search_index.Index(x.spark, path, scratch_path(x.spark, "search_index"))
    index.refresh()
    return index


@check("B12i_indexed_substring", " UNION ALL ".join(
    f"SELECT {k} AS needle, line_id, content FROM logs WHERE content ILIKE '%{n}%'" for k, n in enumerate(_NEEDLES)), "logs")
def _(x: Inputs):
    index = _indexed(x)
    found = [index.substring(n).select(F.lit(k).alias("needle"), "line_id", "content") for k, n in enumerate(_NEEDLES)]
    return reduce(lambda a, b: a.unionByName(b), found)


@check("B13i_indexed_regex", " UNION ALL ".join(
    f"SELECT {k} AS pattern, line_id, content FROM logs WHERE regexp_matches(content, '{p}', 'i')" for k, p in enumerate(_PATTERNS)), "logs")
def _(x: Inputs):
    index = _indexed(x)
    found = [index.regex(p).select(F.lit(k).alias("pattern"), "line_id", "content") for k, p in enumerate(_PATTERNS)]
    return reduce(lambda a, b: a.unionByName(b), found)


@check("F8_numbered_page", f"SELECT {_PAGE} FROM logs WHERE is_anomaly = 0 ORDER BY line_id LIMIT 500 OFFSET 2500", "logs")
def _(x: Inputs):
    view = dashboard.log_view(x.logs, "normal").select(*_PAGE.split(", "))
    return ranking.numbered_page(view, "line_id", 6)


@check("F8b_page_facts", """SELECT count(*) AS total_rows, CAST(greatest(1, ceil(count(*) / 500.0)) AS BIGINT) AS total_pages,
2501::BIGINT AS start_row, least(3000, count(*)) AS end_row FROM logs WHERE is_anomaly = 0""", "logs")
def _(x: Inputs):
    return ranking.page_facts(dashboard.log_view(x.logs, "normal"), 6)


@check("F8c_keyset_page", f"SELECT {_PAGE} FROM logs WHERE line_id > 2999 ORDER BY line_id LIMIT 500", "logs")
def _(x: Inputs):
    return ranking.keyset_page(x.logs.select(*_PAGE.split(", ")), "line_id", 2999, 500)


# --- H: scalar functions --------------------------------------------------------------------


@check("H1_epoch_text", r"""SELECT line_id, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M') AS shown, 'n/a ' || node AS kept
FROM logs""", "logs")
def _(x: Inputs):
    return x.logs.select("line_id", values.epoch_text(F.col("timestamp")).alias("shown"),
                         values.epoch_text(F.concat(F.lit("n/a "), "node")).alias("kept"))


@check("H2_truncate", "SELECT doc_id, left(text, 40) AS a, left(text, 65) AS b, left(text, 200) AS c FROM documents")
def _(x: Inputs):
    t = F.col("text")
    return x.table("documents").select(
        "doc_id", text.truncate(t, 40).alias("a"), text.truncate(t, 65).alias("b"), text.truncate(t, 200).alias("c"))


@check("H3_ellipsize", """SELECT line_id, CASE WHEN length(content) > 24 THEN left(content, 24) || '...' ELSE content END AS short
FROM logs""", "logs")
def _(x: Inputs):
    return x.logs.select("line_id", text.ellipsize(F.col("content"), 24).alias("short"))


@check("H4_clean_caption", r"""SELECT line_id, left(trim(regexp_replace(regexp_replace('at 0x' || lower(to_hex(line_id)) || '  ' || content, '0x[0-9a-fA-F]+', '', 'g'), '\s+', ' ', 'g')), 65) AS caption
FROM logs""", "logs")
def _(x: Inputs):
    noisy = F.concat(F.lit("at 0x"), F.lower(F.hex("line_id")), F.lit("  "), F.col("content"))
    return x.logs.select("line_id", text.clean_caption(noisy).alias("caption"))


@check("H8_clamp", "SELECT line_id, greatest(0.01, least(timestamp % 100 / 100.0, 0.45))::DOUBLE AS share FROM logs", "logs")
def _(x: Inputs):
    return x.logs.select("line_id", values.clamp(F.col("timestamp") % 100 / 100.0, 0.01, 0.45).alias("share"))


@check("H9_rounding", """SELECT event_id, round(avg(value), 4) AS r4, round(avg(value), 3) AS r3, round(avg(value), 2) AS r2,
round(avg(value), 1) AS r1 FROM (SELECT user_id AS event_id, value FROM events) GROUP BY 1""")
def _(x: Inputs):
    mean = F.avg("value")
    return x.table("events").groupBy(F.col("user_id").alias("event_id")).agg(
        *[values.rounded(mean, d).alias(f"r{d}") for d in (4, 3, 2, 1)])


@check("H10_truth_text", "SELECT line_id, CASE is_anomaly WHEN 1 THEN 'Anomaly' ELSE 'Normal' END AS truth FROM logs", "logs")
def _(x: Inputs):
    return x.logs.select("line_id", values.truth_text(F.col("is_anomaly")).alias("truth"))


@check("H11_default", """SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(CAST(l.toxic AS VARCHAR), 'unknown') AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(x: Inputs):
    joined = x.table("documents").select("doc_id").join(x.table("labels"), "doc_id", "left")
    return joined.select("doc_id", values.or_default(F.col("quality"), 0).alias("quality"),
                         values.or_default(F.col("toxic"), "unknown").alias("toxic"))


@check("H12_words", """SELECT doc_id, count(w) AS n_words, count(DISTINCT w) AS n_distinct, min(w) AS first, max(w) AS last
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1""")
def _(x: Inputs):
    return (
        x.table("documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("w")).groupBy("doc_id")
        .agg(F.count("w").alias("n_words"), F.count_distinct("w").alias("n_distinct"), F.min("w").alias("first"),
             F.max("w").alias("last"))
    )


@check("H13_upper_parameter", "SELECT line_id, level FROM logs WHERE level = upper('severe')", "logs")
def _(x: Inputs):
    return x.logs.where(filters.level_named("severe")).select("line_id", "level")


@check("H14_number_text", r"""SELECT level, printf('%.2f%%', 100.0 * count(*) / (SELECT count(*) FROM logs)) AS share,
format('{:,}', CAST(sum(timestamp) AS BIGINT)) AS total FROM logs GROUP BY 1""", "logs")
def _(x: Inputs):
    n = x.logs.agg(F.count(F.lit(1))).scalar()
    return x.logs.groupBy("level").agg(F.count(F.lit(1)).alias("c"), F.sum("timestamp").alias("s")).select(
        "level", values.percent_text(F.col("c") / n, 2).alias("share"), values.thousands_text(F.col("s")).alias("total"))


# --- I1, I2: templates ----------------------------------------------------------------------


@check("I2_mask_template", r"""SELECT line_id, template, dense_rank() OVER (ORDER BY template) AS event_id FROM (
SELECT line_id, regexp_replace(content, '\S*[0-9]\S*', '<*>', 'g') AS template FROM parsed)""", "parsed")
def _(x: Inputs):
    return templates.mask_templates(parse.parse_lines(x.raw)).select("line_id", "template", "event_id")


@check("I1_mine_templates", """SELECT * FROM (WITH t AS (SELECT line_id, string_split(regexp_replace(content, '\\S*[0-9]\\S*', '<*>', 'g'), ' ') AS w FROM logs),
leaf AS (SELECT len(w) AS n, w[1] AS head, min(line_id) AS first_line FROM t GROUP BY 1, 2),
spots AS (SELECT n, head, place, CASE WHEN count(DISTINCT word) = 1 THEN min(word) ELSE '<*>' END AS word FROM
  (SELECT len(w) AS n, w[1] AS head, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM t) GROUP BY 1, 2, 3),
named AS (SELECT n, head, string_agg(word, ' ' ORDER BY place) AS template FROM spots GROUP BY 1, 2),
ids AS (SELECT n, head, dense_rank() OVER (ORDER BY first_line) AS event_id FROM leaf)
SELECT line_id, event_id, template FROM t JOIN named ON named.n = len(w) AND named.head = w[1] JOIN ids ON ids.n = len(w) AND ids.head = w[1])""", "logs")
def _(x: Inputs):
    """Four of six tokens of a leaf's patterns are equal, so every leaf becomes one template."""
    return templates.mine_templates(x.logs.select("line_id", "content"))


@check("I1b_mine_templates_prose")
def _(x: Inputs):
    """Every line of every document: hardly any repetition, long tails of leaves."""
    lines = x.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "content")).where(
        text.strip(F.col("content")) != "")
    keyed = lines.select((F.col("doc_id") * 1_000_000 + F.col("at")).alias("line_id"), "content")
    return templates.mine_templates(keyed).groupBy("event_id", "template").agg(F.count(F.lit(1)).alias("lines"))


@check("I1c_mined_facts", "SELECT count(*) AS lines, true AS all_fit, true AS ids_dense FROM logs", "logs")
def _(x: Inputs):
    """What mining must keep whatever it merges: every line, in a template that it fits, under dense ids."""
    mined = templates.with_mined_templates(x.logs.select("line_id", "content"))
    fits = F.forall(
        F.zip_with(F.split("pattern", " "), F.split("template", " "), lambda p, t: (t == "<*>") | p.eqNullSafe(t)),
        lambda same: same)
    return mined.withColumn("pattern", text.mask_digits(F.col("content"))).agg(
        F.count(F.lit(1)).alias("lines"), F.bool_and(fits).alias("all_fit"),
        (F.count_distinct("event_id") == F.max("event_id")).alias("ids_dense"))


def _prose(x: Inputs):
    """Every line of every document, numbered by document and place."""
    return x.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "content")).where(
        text.strip(F.col("content")) != "").select((F.col("doc_id") * 1_000_000 + F.col("at")).alias("line_id"), "content")


@check("I1d_mined_in_steps", "SELECT count(*) AS lines, true AS same FROM logs", "logs")
def _(x: Inputs):
    """Mining the first third, then the rest against the stored templates, gives what mining at once gives."""
    lines = x.logs.select("line_id", "content")
    cut, path = lines.agg(F.max("line_id")).first()[0] // 3, scratch_path(x.spark, "mined")
    templates.extend(templates.Mined.nothing(x.spark), lines.where(F.col("line_id") <= cut))[1].save(path)
    known = templates.extend(templates.Mined.load(x.spark, path), lines.where(F.col("line_id") > cut))[1]
    return _agreement(_told(templates.with_stored_templates(known, lines)), _told(templates.with_mined_templates(lines)))


def _told(mined, *more):
    """Templates as digests, which is enough to tell them apart."""
    return mined.select("line_id", "event_id", F.unhex(F.sha2("template", 256)).alias("template"), *more)


def _agreement(one, other):
    pair = one.join(other.select("line_id", F.col("event_id").alias("id2"), F.col("template").alias("template2")), "line_id", "full")
    same = F.col("event_id").eqNullSafe(F.col("id2")) & F.col("template").eqNullSafe(F.col("template2"))
    return pair.agg(F.count(F.lit(1)).alias("lines"), F.bool_and(same).alias("same"))


_PROSE_LINES = """(SELECT unnest(string_split(text, chr(10))) AS content FROM documents)
WHERE regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> ''"""


@check("I1e_mined_prose_facts", f"SELECT count(*) AS lines, true AS all_fit, true AS ids_dense, true AS same FROM {_PROSE_LINES}")
def _(x: Inputs):
    """Prose in parts of 4,096 patterns: what mining must keep whatever it merges, and the same result in two steps."""
    lines = _prose(x)
    cut = F.lit(lines.agg(F.max("line_id")).first()[0] // 2)
    squeezed = text.mask_digits(text.squeeze(text.strip(F.col("content"))))
    fits = F.forall(F.zip_with(F.split(squeezed, " "), F.split("template", " "), lambda p, t: (t == "<*>") | p.eqNullSafe(t)), lambda same: same)
    whole = stage(_told(templates.with_mined_templates(lines, part_size=4096), fits.alias("fits")), "mined")
    half = templates.extend(templates.Mined.nothing(x.spark), lines.where(F.col("line_id") <= cut), part_size=4096)[1]
    known = templates.extend(half, lines.where(F.col("line_id") > cut), part_size=4096)[1]
    facts = whole.agg(F.count(F.lit(1)).alias("lines"), F.bool_and("fits").alias("all_fit"),
                      (F.count_distinct("event_id") == F.max("event_id")).alias("ids_dense"))
    return facts.join(_agreement(_told(templates.with_stored_templates(known, lines)), whole).select("same"))  # one row each


# --- JSON documents --------------------------------------------------------------------------


def _doc(x: Inputs):
    return x.logs.agg(
        F.avg("is_anomaly").alias("tfidf_silhouette"), F.avg("event_id").alias("minilm_silhouette"),
        F.count_distinct("template").alias("tfidf_clusters"), F.count_distinct("node").alias("tfidf_unique"),
        F.count_distinct("level").alias("minilm_clusters"), F.count_distinct("date").alias("minilm_unique"))


_DOC_SQL = """SELECT round(avg(is_anomaly), 4) AS tfidf_silhouette, round(avg(event_id), 4) AS minilm_silhouette,
count(DISTINCT template) AS tfidf_clusters, count(DISTINCT node) AS tfidf_unique, count(DISTINCT level) AS minilm_clusters,
count(DISTINCT date) AS minilm_unique FROM logs"""


@check("A6_read_json_doc", _DOC_SQL, "logs")
def _(x: Inputs):
    from loglens.schemas import CLUSTERING_DOC

    path = scratch_path(x.spark, "doc")
    documents.write_json_doc(_doc(x), path)
    return documents.read_json_doc(x.spark, path, CLUSTERING_DOC)


@check("A7_write_json_doc", _DOC_SQL, "logs")
def _(x: Inputs):
    path = scratch_path(x.spark, "doc")
    documents.write_json_doc(_doc(x), path)
    return documents.read_json_doc(x.spark, path).select(
        "tfidf_silhouette", "minilm_silhouette", "tfidf_clusters", "tfidf_unique", "minilm_clusters", "minilm_unique")

"""SQL twins: common table expressions over the given tables, written independently of the
Spark code (interval joins, window functions, recursive closure)."""

from __future__ import annotations

_LEVELS = "('SEVERE','ERROR','FAILURE','FATAL')"
FULL_FIELDS = ["label", "ts", "date", "node", "time", "node2", "type", "component", "level", "content"]
SHORT_FIELDS = ["label", "ts", "date", "time", "type", "component", "level", "content"]
_DENSE = ["total_logs", "error_ratio", "fatal_count", "severe_count", "unique_nodes", "unique_templates"]
FULL = (r"^(\S+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+"
        r"(INFO|WARN|WARNING|ERROR|FATAL|SEVERE|FAILURE|CRITICAL)\s+(.+)$")
SHORT = (r"^(\S+)\s+(\d+)\s+(\S+)\s+-\s+(\S+)\s+(\S+)\s+(\S+)\s+"
         r"(INFO|WARN|WARNING|ERROR|FATAL|SEVERE|FAILURE|CRITICAL)\s+(.+)$")
LOOSE = r"^(\S+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.+)$"


def _fields(pattern: str, names: list[str]) -> str:
    return f"regexp_extract(line, '{pattern}', [{', '.join(repr(n) for n in names)}])"


def _z(c: str) -> str:
    return f"abs({c} - s.m_{c}) / CASE WHEN s.s_{c} = 0 THEN 1 ELSE s.s_{c} END"


def quantile_sql(source: str, level: str) -> str:
    """Linearly interpolated quantile at a computed level."""
    return f"""SELECT max(CASE WHEN r = floor(pos) THEN v END)
  + (max(CASE WHEN r = ceil(pos) THEN v END) - max(CASE WHEN r = floor(pos) THEN v END)) * max(pos - floor(pos)) AS cut
FROM (SELECT anomaly_score AS v, row_number() OVER (ORDER BY anomaly_score) - 1 AS r FROM {source}),
     (SELECT ({level}) * (count(*) - 1) AS pos FROM {source})"""


def f1_sql(source: str, flag: str) -> str:
    tp = f"count(*) FILTER (is_anomaly = 1 AND {flag} = 1)"
    fp = f"count(*) FILTER (is_anomaly = 0 AND {flag} = 1)"
    fn = f"count(*) FILTER (is_anomaly = 1 AND {flag} = 0)"
    return (f"SELECT CASE WHEN 2*{tp}+{fp}+{fn} = 0 THEN 0.0 ELSE CAST(2*{tp} AS DOUBLE)/(2*{tp}+{fp}+{fn}) END AS f1, "
            f"{fp} AS fp, {fn} AS fn FROM {source}")


def mode_sql(source: str, keys: str, value: str, out: str) -> str:
    return (f"SELECT {keys}, {value} AS {out} FROM (SELECT {keys}, {value}, row_number() OVER (PARTITION BY {keys} "
            f"ORDER BY count(*) DESC, {value}) AS r FROM {source} GROUP BY {keys}, {value}) WHERE r = 1")


def tfidf_ctes(p: str, source: str, row: str, text: str) -> dict[str, tuple[list[str], str]]:
    """Vocabulary, unit weights, near pairs and components of a text column."""
    return {
        f"{p}_tf": ([], f"SELECT {row} AS id, w AS word, count(*) AS tf FROM (SELECT {row}, "
                        f"unnest(regexp_extract_all(lower({text}), '[a-z]+')) AS w FROM {source}) GROUP BY ALL"),
        f"{p}_vocab": ([f"{p}_tf"], f"SELECT word, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM {p}_tf "
                                    f"GROUP BY word ORDER BY n DESC, word LIMIT 500"),
        f"{p}_w": ([f"{p}_tf", f"{p}_vocab"],
                   f"SELECT id, word, x / sqrt(sum(x*x) OVER (PARTITION BY id)) AS w FROM (SELECT t.id, t.word, "
                   f"t.tf * (ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + v.df)) + 1) AS x "
                   f"FROM {p}_tf t JOIN {p}_vocab v USING (word))"),
    }


def pair_ctes(p: str, eps: float) -> dict[str, tuple[list[str], str]]:
    return {
        f"{p}_pairs": ([f"{p}_w"], f"SELECT x.id AS a, y.id AS b FROM {p}_w x JOIN {p}_w y ON x.word = y.word "
                                   f"AND x.id <> y.id GROUP BY 1, 2 HAVING round(sum(x.w * y.w), 9) >= {1 - eps}"),
    }


def component_ctes(p: str, rows: str, row: str) -> dict[str, tuple[list[str], str]]:
    """Transitive closure, smallest id as root; rows without a neighbour are noise."""
    return {
        f"{p}_reach": ([f"{p}_pairs"], f"SELECT a AS id, b AS other FROM {p}_pairs UNION "
                                       f"SELECT r.id, q.b FROM {p}_reach r JOIN {p}_pairs q ON q.a = r.other"),
        f"{p}_cl": ([f"{p}_reach"],
                    f"SELECT t.{row} AS id, CAST(coalesce(c.cid, -1) AS INTEGER) AS cluster_id FROM {rows} t LEFT JOIN "
                    f"(SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM "
                    f"(SELECT id, least(id, min(other)) AS root FROM {p}_reach GROUP BY id)) c ON c.id = t.{row}"),
    }


def dense_component_ctes(p: str, words: str, rows: str, row: str, eps: float, least: int) -> dict[str, tuple[list[str], str]]:
    """Density clustering with a threshold: closure over core rows, border rows to the lowest cluster of a core neighbour."""
    return {
        f"{p}_pairs": ([words], f"SELECT x.id AS a, y.id AS b FROM {words} x JOIN {words} y ON x.word = y.word "
                                f"AND x.id <> y.id GROUP BY 1, 2 HAVING round(sum(x.w * y.w), 9) >= {1 - eps}"),
        f"{p}_core": ([f"{p}_pairs"], f"SELECT a AS id FROM {p}_pairs GROUP BY 1 HAVING count(*) + 1 >= {least}"),
        f"{p}_reach": ([f"{p}_pairs", f"{p}_core"], f"SELECT id, id AS other FROM {p}_core UNION SELECT r.id, q.b FROM {p}_reach r "
                                                    f"JOIN {p}_pairs q ON q.a = r.other WHERE q.b IN (SELECT id FROM {p}_core)"),
        f"{p}_ids": ([f"{p}_reach"], f"SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM (SELECT id, min(other) AS root FROM {p}_reach GROUP BY 1)"),
        f"{p}_cl": ([f"{p}_ids", f"{p}_pairs"],
                    f"SELECT t.{row} AS id, CAST(coalesce(c.cid, n.cid, -1) AS INTEGER) AS cluster_id FROM {rows} t LEFT JOIN {p}_ids c ON c.id = t.{row} "
                    f"LEFT JOIN (SELECT q.a AS id, min(i.cid) AS cid FROM {p}_pairs q JOIN {p}_ids i ON i.id = q.b GROUP BY 1) n ON n.id = t.{row}"),
    }


CTES: dict[str, tuple[list[str], str]] = {
    "base": ([], """SELECT event_id AS line_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, strftime(ts, '%Y.%m.%d') AS date,
  strftime(ts, '%Y-%m-%d-%H.%M.%S') AS stamp,
  CASE WHEN event_type = 'error' AND value >= 150 THEN 1 ELSE 0 END AS is_anomaly,
  CASE WHEN event_type = 'error' THEN CASE WHEN value >= 100 THEN 'FATAL' WHEN value >= 50 THEN 'SEVERE'
       WHEN value >= 20 THEN 'ERROR' ELSE 'FAILURE' END
       WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level,
  CASE WHEN user_id % 50 = 0 THEN 'SYSTEM' ELSE 'R' || (user_id % 16) || '-N' || (user_id % 4) END AS node,
  CASE WHEN user_id % 2 = 0 THEN 'KERNEL' ELSE 'APP' END AS component,
  event_type || ' on shard ' || chr(97 + CAST(json_extract(props, '$.k') AS INTEGER) % 7) || ' code '
    || CAST(json_extract(props, '$.k') AS INTEGER) AS content
FROM events"""),
    "logs": (["base"], r"""SELECT line_id, is_anomaly, timestamp, date, node, level, component, content,
  dense_rank() OVER (ORDER BY template) AS event_id, template
FROM (SELECT *, regexp_replace(content, '\S*[0-9]\S*', '<*>', 'g') AS template FROM base)"""),
    "raw": (["base"], """SELECT line_id, CASE k % 25
  WHEN 11 THEN '' WHEN 12 THEN 'garbage ' || content
  WHEN 13 THEN lbl || ' ' || timestamp || ' ' || date || ' ' || node || ' ' || stamp || ' ' || node || ' RAS ' || component || ' DEBUG ' || content
  WHEN 14 THEN lbl || ' 12x ' || date || ' ' || node || ' ' || stamp || ' ' || node || ' RAS ' || component || ' ' || level || ' ' || content
  WHEN 15 THEN lbl || ' 99999999999999999999 ' || date || ' ' || node || ' ' || stamp || ' ' || node || ' RAS ' || component || ' ' || level || ' ' || content
  WHEN 16 THEN lbl || ' ' || timestamp || ' ' || date || ' - ' || stamp || ' RAS ' || component || ' WARNING WARN ' || content
  WHEN 17 THEN '  ' || lbl || ' ' || timestamp || ' ' || date || ' ' || node || ' ' || stamp || ' ' || node || ' RAS ' || component || ' ' || level || ' ' || content || chr(9) || ' '
  ELSE CASE WHEN node = 'SYSTEM'
    THEN lbl || ' ' || timestamp || ' ' || date || ' - ' || stamp || ' RAS ' || component || ' ' || level || ' ' || content
    ELSE lbl || ' ' || timestamp || ' ' || date || ' ' || node || ' ' || stamp || ' ' || node || ' RAS ' || component || ' ' || level || ' ' || content END
  END AS value
FROM (SELECT *, CASE WHEN is_anomaly = 1 THEN 'APPFAIL' ELSE '-' END AS lbl FROM base)"""),
    "stripped": (["raw"], r"SELECT line_id, regexp_replace(value, '^\s+|\s+$', '', 'g') AS line FROM raw"),
    "formats": (["stripped"], f"""SELECT line_id, line, CASE WHEN line = '' THEN 'blank'
  WHEN regexp_matches(line, '{FULL}') THEN CASE WHEN try_cast(regexp_extract(line, '{FULL}', 2) AS BIGINT) IS NULL THEN 'reject' ELSE 'full' END
  WHEN regexp_matches(line, '{SHORT}') THEN CASE WHEN try_cast(regexp_extract(line, '{SHORT}', 2) AS BIGINT) IS NULL THEN 'reject' ELSE 'short' END
  ELSE 'reject' END AS fmt FROM stripped"""),
    "full_parts": (["formats"], f"SELECT line_id, line, {_fields(FULL, FULL_FIELDS)} AS p FROM formats WHERE fmt = 'full'"),
    "short_parts": (["formats"], f"SELECT line_id, line, {_fields(SHORT, SHORT_FIELDS)} AS p FROM formats WHERE fmt = 'short'"),
    "loose_parts": (["stripped"], f"SELECT line_id, line, {_fields(LOOSE, FULL_FIELDS)} AS p FROM stripped "
                                  f"WHERE regexp_matches(line, '{LOOSE}')"),
    "parsed": (["full_parts", "short_parts"], """SELECT line_id, CAST(p.label <> '-' AS INTEGER) AS is_anomaly,
  CAST(p.ts AS BIGINT) AS timestamp, p.date AS date, CASE WHEN p.node = '-' THEN 'SYSTEM' ELSE p.node END AS node,
  p.level AS level, p.component AS component, p.content AS content FROM full_parts
UNION ALL SELECT line_id, CAST(p.label <> '-' AS INTEGER), CAST(p.ts AS BIGINT), p.date, 'SYSTEM', p.level, p.component,
  p.content FROM short_parts"""),
    "lw": (["logs"], "SELECT *, (timestamp - (SELECT min(timestamp) FROM logs)) // 3600 AS window_id FROM logs"),
    "counts": (["lw"], "SELECT window_id, event_id, count(*) AS n FROM lw GROUP BY 1, 2"),
    "meta": (["lw"], f"""SELECT window_id, min(timestamp) AS window_start, max(timestamp) AS window_end, count(*) AS total_logs,
  CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count,
  CAST(count(*) FILTER (level IN {_LEVELS}) AS DOUBLE) / count(*) AS error_ratio,
  count(*) FILTER (level = 'FATAL') AS fatal_count, count(*) FILTER (level = 'SEVERE') AS severe_count,
  count(DISTINCT node) AS unique_nodes, count(DISTINCT event_id) AS unique_templates,
  CAST(max(is_anomaly) AS INTEGER) AS is_anomaly FROM lw GROUP BY window_id"""),
    "features": (["counts", "meta"], "SELECT window_id, 'e_' || event_id AS feature, CAST(n AS DOUBLE) AS x FROM counts "
                 + " ".join(f"UNION ALL SELECT window_id, '{c}', CAST({c} AS DOUBLE) FROM meta" for c in _DENSE)),
    "dense": (["features"], """SELECT w.window_id, f.feature, coalesce(x.x, 0.0) AS x FROM (SELECT DISTINCT window_id FROM features) w
  CROSS JOIN (SELECT DISTINCT feature FROM features) f
  LEFT JOIN features x ON x.window_id = w.window_id AND x.feature = f.feature"""),
    "scored": (["meta"], "SELECT * EXCLUDE (x), round(x / (1 + x), 9) AS anomaly_score FROM (SELECT m.*, ("
               + " + ".join(_z(c) for c in _DENSE) + f") / {len(_DENSE)} AS x FROM meta m, (SELECT "
               + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _DENSE) + " FROM meta) s)"),
    "cut": (["scored"], quantile_sql("scored", "1 - greatest(0.01, least(avg(is_anomaly), 0.45))")),
    "flagged": (["scored", "cut"], "SELECT scored.*, CAST(anomaly_score > cut.cut AS INTEGER) AS predicted FROM scored, cut"),
    "confirmed": (["flagged"], """SELECT *, CAST(predicted = 1 AND (fatal_count > 0 OR severe_count > 0 OR error_ratio > 0
  OR anomaly_score >= (SELECT quantile_cont(anomaly_score, 0.95) FROM flagged)) AS INTEGER) AS confirmed FROM flagged"""),
    "gate": (["confirmed"], f"""SELECT b.f1 AS f1_before, a.f1 AS f1_after, b.fp AS fp_before, b.fn AS fn_before,
  a.fp AS fp_after, a.fn AS fn_after, a.f1 >= b.f1 - 0.01 AS adopted
  FROM ({f1_sql('confirmed', 'predicted')}) b, ({f1_sql('confirmed', 'confirmed')}) a"""),
    "scores": (["confirmed", "gate"], "SELECT c.* EXCLUDE (predicted, confirmed), "
               "CASE WHEN g.adopted THEN c.confirmed ELSE c.predicted END AS predicted FROM confirmed c, gate g"),
    "picked": (["scores"], "SELECT * FROM scores WHERE predicted = 1"),
    "inside": (["picked", "logs"], """SELECT p.window_id, l.* FROM picked p JOIN logs l
  ON l.timestamp >= p.window_start AND l.timestamp < p.window_end"""),
    "preferred": (["inside"], """SELECT * EXCLUDE (has) FROM (SELECT *, max(is_anomaly) OVER (PARTITION BY window_id) AS has
  FROM inside) WHERE is_anomaly = 1 OR has = 0"""),
    "cuts": (["picked"], """SELECT quantile_cont(anomaly_score, 0.95) AS p95, quantile_cont(anomaly_score, 0.85) AS p85,
  quantile_cont(anomaly_score, 0.70) AS p70 FROM picked"""),
    "bare_alerts": (["picked", "preferred", "cuts"], f"""SELECT p.window_id, p.window_start, p.window_end, p.anomaly_score,
  p.anomaly_count, p.total_logs, CASE WHEN p.anomaly_score >= p95 THEN 'CRITICAL' WHEN p.anomaly_score >= p85 THEN 'HIGH'
    WHEN p.anomaly_score >= p70 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  coalesce(t.t, 'unknown') AS top_template, coalesce(v.v, 'INFO') AS top_level
FROM picked p CROSS JOIN cuts LEFT JOIN ({mode_sql('preferred', 'window_id', 'template', 't')}) t USING (window_id)
LEFT JOIN ({mode_sql('preferred', 'window_id', 'level', 'v')}) v USING (window_id)"""),
    **tfidf_ctes("al", "bare_alerts", "window_id", "top_template"),
    **pair_ctes("al", 0.5),
    **component_ctes("al", "bare_alerts", "window_id"),
    "placed": (["bare_alerts", "al_cl"], "SELECT b.*, c.cluster_id FROM bare_alerts b JOIN al_cl c ON c.id = b.window_id"),
    "labels": (["placed"], f"""SELECT cluster_id, left(t, 60) AS cluster_label FROM ({mode_sql('placed', 'cluster_id', 'top_template', 't')})
  WHERE cluster_id <> -1
  UNION ALL SELECT -1, 'Unique: ' || left(arg_min(top_template, window_id), 40) FROM placed WHERE cluster_id = -1 HAVING count(*) > 0"""),
    "alerts": (["placed", "labels"], "SELECT p.*, l.cluster_label FROM placed p LEFT JOIN labels l USING (cluster_id)"),
    **tfidf_ctes("doc", "documents", "doc_id", "text"),
    **pair_ctes("doc", 0.5),
    **component_ctes("doc", "documents", "doc_id"),
    "vec_w": ([], """SELECT vec_id AS id, i AS word, CAST(embedding[i] AS DOUBLE) / len AS w FROM (SELECT *,
  sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS len FROM embeddings),
  LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i)"""),
    **dense_component_ctes("dm", "doc_w", "documents", "doc_id", 0.4, 25),
    **pair_ctes("vec", 0.6),
    **component_ctes("vec", "embeddings", "vec_id"),
}
CTES |= {
    "bare2": (["bare_alerts", "preferred"], "SELECT * FROM bare_alerts WHERE window_id IN (SELECT window_id FROM preferred)"),
    **tfidf_ctes("a2", "bare2", "window_id", "top_template"),
    **pair_ctes("a2", 0.5),
    **component_ctes("a2", "bare2", "window_id"),
    "v2_w": (["bare2", "vec_w"], "SELECT b.window_id AS id, v.word, v.w FROM bare2 b JOIN vec_w v ON v.id = b.window_id % (SELECT count(*) FROM embeddings)"),
    **pair_ctes("v2", 0.6),
    **component_ctes("v2", "bare2", "window_id"),
    "two_ways": (["bare2", "a2_cl", "v2_cl"], """SELECT b.* EXCLUDE (top_level), t.cluster_id AS cluster_id_tfidf, v.cluster_id AS cluster_id_minilm
  FROM bare2 b JOIN a2_cl t ON t.id = b.window_id JOIN v2_cl v ON v.id = b.window_id"""),
    "tiered": (["bare_alerts", "logs"], """SELECT a.window_id, l.content, l.level, l.line_id, CASE WHEN l.template = a.top_template THEN 1
  WHEN l.level IN ('FATAL','SEVERE','ERROR') THEN 2 END AS tier FROM bare_alerts a JOIN logs l
  ON l.timestamp >= a.window_start AND l.timestamp < a.window_end"""),
    "lowest": (["tiered"], """SELECT t.* FROM tiered t JOIN (SELECT window_id, min(tier) AS tier FROM tiered GROUP BY 1) m
  ON m.window_id = t.window_id AND m.tier = t.tier"""),
    "represented": (["bare_alerts", "lowest"], f"""SELECT a.*, coalesce(f.tier, 3) AS tier, coalesce(m.c, a.top_template) AS rep_content,
  coalesce(f.level, 'UNKNOWN') AS rep_level FROM bare_alerts a
  LEFT JOIN ({mode_sql('lowest', 'window_id', 'content', 'c')}) m USING (window_id)
  LEFT JOIN (SELECT window_id, min(tier) AS tier, arg_min(level, line_id) AS level FROM lowest GROUP BY 1) f USING (window_id)"""),
}
# Rows of the text clusterings depend on the tables they read.
for _name, _needs in [("al_tf", ["bare_alerts"]), ("al_w", ["bare_alerts"]), ("al_cl", ["bare_alerts"]),
                      ("a2_tf", ["bare2"]), ("a2_w", ["bare2"]), ("a2_cl", ["bare2"]), ("v2_cl", ["bare2"])]:
    CTES[_name] = (_needs + CTES[_name][0], CTES[_name][1])


def silhouette_sql(weights: str, clusters: str) -> str:
    """Mean cosine silhouette by brute force over all pairs of clustered rows, as one value."""
    return f"""SELECT coalesce(round(CASE WHEN count(*) > 1 AND (SELECT count(DISTINCT cluster_id) FROM {clusters} WHERE cluster_id <> -1) > 1
    THEN avg(s) ELSE 0 END, 9), 0.0) AS silhouette FROM (
  SELECT id, CASE WHEN max(CASE WHEN mine THEN size END) = 1 THEN 0 ELSE
      (min(CASE WHEN NOT mine THEN d END) - max(CASE WHEN mine THEN d END))
      / nullif(greatest(min(CASE WHEN NOT mine THEN d END), max(CASE WHEN mine THEN d END)), 0) END AS s
  FROM (SELECT x.id, x.cluster_id = y.cluster_id AS mine, y.cluster_id, count(*) AS size,
          sum(CASE WHEN x.id = y.id THEN 0 ELSE 1 - coalesce(p.dot, 0) END)
            / CASE WHEN x.cluster_id = y.cluster_id THEN nullif(count(*) - 1, 0) ELSE count(*) END AS d
        FROM {clusters} x JOIN {clusters} y ON x.cluster_id <> -1 AND y.cluster_id <> -1
        LEFT JOIN (SELECT a.id AS i, b.id AS j, sum(a.w * b.w) AS dot FROM {weights} a JOIN {weights} b USING (word)
                   GROUP BY 1, 2) p ON p.i = x.id AND p.j = y.id
        GROUP BY x.id, x.cluster_id, y.cluster_id) GROUP BY id)"""


def dominant_sql(alerts: str, cluster: str) -> str:
    """Dominant template per cluster and the commonest line carrying it, from the first of the
    cluster's first five alerts that has such a line."""
    return f"""SELECT d.{cluster}, d.t AS dominant_template, coalesce(h.content, d.t) AS rep_content
FROM ({mode_sql(alerts, cluster, 'top_template', 't')}) d LEFT JOIN (
  SELECT {cluster}, content FROM (SELECT e.{cluster}, e.place, l.content,
      row_number() OVER (PARTITION BY e.{cluster} ORDER BY e.place, count(*) DESC, l.content) AS r
    FROM (SELECT *, row_number() OVER (PARTITION BY {cluster} ORDER BY window_id) AS place FROM {alerts}) e
    JOIN ({mode_sql(alerts, cluster, 'top_template', 't')}) m USING ({cluster})
    JOIN logs l ON l.timestamp >= e.window_start AND l.timestamp < e.window_end AND l.template = m.t
    WHERE e.place <= 5 GROUP BY e.{cluster}, e.place, l.content) WHERE r = 1) h USING ({cluster})"""


def statistics_sql(rows: str, cluster: str) -> str:
    return f"""SELECT count(*) AS total, count(DISTINCT {cluster}) FILTER ({cluster} >= 0) AS clusters,
count(*) FILTER ({cluster} = -1) AS unique_rows,
count(DISTINCT {cluster}) FILTER ({cluster} >= 0) + count(*) FILTER ({cluster} = -1) AS distinct_groups,
round((1 - (count(DISTINCT {cluster}) FILTER ({cluster} >= 0) + count(*) FILTER ({cluster} = -1)) / count(*)) * 100, 1) AS noise_reduction_pct
FROM {rows}"""


def statement(body: str, *needs: str) -> str:
    """``WITH`` the needed tables, in dependency order, in front of ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in CTES[name][0]:
            add(other)
        order.append(name)

    for name in needs:
        add(name)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body

"""One DuckDB statement per registered query that SQL can express."""

from __future__ import annotations

from cinderlog import fixed

from .base import (
    ACTIVE,
    ISO,
    KEY,
    SEV_RANK,
    TEXT_LINE,
    collapse_sql,
    mask_sql,
    statement,
    text,
    values,
)

ORACLES: dict[str, str] = {}


def oracle(name: str, final: str, *needs: str) -> None:
    ORACLES[name] = statement(final, *needs)


def r6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0"


# --- sources and sinks -----------------------------------------------------------------

oracle("s01_table_lines", "SELECT doc_id, line_no, raw FROM doc_lines", "doc_lines")
oracle("s02_mixed_format_lines", "SELECT line_no, ts, level, service, message FROM log_rows", "log_rows")
oracle("s03_drop_blank", "SELECT line_no, raw FROM doc_lines WHERE trim(raw) <> ''", "doc_lines")
oracle(
    "s04_valid_utf8",
    """SELECT line_no, CASE WHEN line_no % 3 <> 1 THEN chr(65533) ELSE '' END || raw ||
       CASE WHEN line_no % 3 <> 0 THEN chr(65533) ELSE '' END AS raw FROM doc_lines""",
    "doc_lines",
)
oracle(
    "s05_numbered_file_lines",
    f"SELECT row_number() OVER (ORDER BY line_no) AS line_no, {TEXT_LINE} AS raw FROM log_rows",
    "log_rows",
)
oracle(
    "s06_run_sink",
    f"""SELECT 'runs' AS stored, 1 AS rows, CAST(n AS DOUBLE) AS total FROM row_count
       UNION ALL SELECT 'clusters', count(*), coalesce(sum(count), 0.0) FROM clu
       UNION ALL SELECT 'clusters by bucket', count(*), coalesce(sum(c), 0.0) FROM series WHERE c > 0
       UNION ALL SELECT 'incidents', count(*), {r6('coalesce(sum(confidence), 0.0)')} FROM inc
       UNION ALL SELECT 'correlations', count(*), {r6('coalesce(sum(lag_seconds), 0.0)')} FROM edge""",
    "row_count", "clu", "series", "inc", "edge",
)
oracle(
    "s07_run_scan",
    r"""SELECT 'CLU-' || lpad(CAST(row_number() OVER (ORDER BY created) AS VARCHAR), 3, '0') AS cluster_id,
       template, count, level FROM (
       SELECT masked AS template, min(line_no) AS created, count(*) AS count,
       CASE any_value(event_type) WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'UNKNOWN' END AS level
       FROM masked_rows WHERE line_no % 64 = 1 GROUP BY masked)""",
    "masked_rows",
)
oracle("s08_latest_run", "SELECT 2 AS run_id, n AS event_count FROM row_count", "row_count")
oracle(
    "s09_previous_run",
    """SELECT 1 AS run_id, n AS event_count, NULL AS previous_id, NULL AS previous_event_count FROM plain_count
       UNION ALL SELECT 2, r.n, 1, p.n FROM row_count r, plain_count p""",
    "plain_count", "row_count",
)


def iso(column: str) -> str:
    return (
        f"CASE WHEN epoch_us({column}) % 1000000 <> 0 THEN strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') "
        f"ELSE strftime({column}, '%Y-%m-%dT%H:%M:%S') END"
    )


oracle(
    "s10_export_rows",
    f"""SELECT incident_id, severity, title, coalesce(primary_service, '') AS service, cluster_id,
        printf('%.2f', confidence) AS confidence, status, printf('%.2f', anomaly_score) AS anomaly_score,
        printf('%.0f', growth_pct) AS growth_pct, count, {iso('first_seen')} AS first_seen,
        {iso('last_seen')} AS last_seen, row_number() OVER (ORDER BY {SEV_RANK} DESC, confidence DESC, rank) AS place
        FROM inc""",
    "inc",
)
oracle(
    "s11_empty_input",
    """SELECT 1 AS run_id, 0 AS event_count, 0 AS parsed_count, 0 AS unparsed_count, 0 AS cluster_count,
       0 AS incident_count, TIMESTAMP '2024-01-01' AS window_start, TIMESTAMP '2024-01-01' AS window_end,
       300 AS bucket_seconds, 5 AS figures, 0.0::DOUBLE AS total, 100 AS health_score,
       'All systems operational' AS health_summary""",
)
oracle(
    "s12_stored_buckets",
    """SELECT cluster_id, idx AS bucket_idx, CAST(bucket_ts AS TIMESTAMP) AS bucket_ts, c AS events
       FROM series JOIN ids USING (template)""",
    "series", "ids",
)
oracle(
    "s13_stored_explanations",
    """SELECT incident_id, title, 'deterministic' AS source, root_cause
       FROM inc JOIN explained USING (incident_id)""",
    "inc", "explained",
)

# --- parsing -----------------------------------------------------------------------------

oracle("p01_json_objects", "SELECT line_no, line_no % 4 = 0 AS is_object FROM log_rows", "log_rows")
oracle("p02_alias_keys", "SELECT line_no, ts, level, service, message FROM log_rows", "log_rows")
oracle(
    "p03_folded_message",
    """SELECT event_id + 1 AS line_no, 'INFO' AS level, 'a' AS service, 'z=' || user_id || ' kind=' || event_type ||
       ' ok=True gone=None half=' || user_id || '.5' AS message FROM events""",
)
oracle(
    "p04_timestamp_forms",
    """SELECT event_id + 1 AS line_no, CASE event_id % 12 WHEN 0 THEN date_trunc('second', ts)
       WHEN 1 THEN date_trunc('milliseconds', ts) WHEN 2 THEN ts
       WHEN 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 4 THEN date_trunc('milliseconds', ts)
       WHEN 5 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) WHEN 7 THEN date_trunc('second', ts) WHEN 8 THEN ts
       WHEN 9 THEN date_trunc('minute', ts) WHEN 10 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
       WHEN 11 THEN date_trunc('second', ts) - INTERVAL 19815 SECOND END AS ts FROM events""",
)
_words = [name.lower() for name in fixed.LEVEL_RANK] + ["note", "", "severe"]
oracle(
    "p05_level_names",
    f"""SELECT event_id, CASE WHEN word IN ({', '.join(text(n.lower()) for n in fixed.LEVEL_RANK)})
        THEN upper(word) ELSE 'UNKNOWN' END AS level FROM (
        SELECT event_id, [{', '.join(text(w) for w in _words)}][event_id % {len(_words)} + 1] AS word FROM events)""",
)
_STYLED = """SELECT *, (line_no // 64) % 6 AS style, CASE WHEN service = 'webhooks' THEN 'webhooks' ELSE service END AS s
    FROM plain_rows"""
oracle(
    "p06_leading_timestamp",
    f"""SELECT line_no, CASE WHEN style IN (0, 1, 4) THEN ts WHEN style = 2 THEN date_trunc('milliseconds', ts) END AS text_ts,
        CASE style WHEN 0 THEN level || ' ' || service || ' ' || message
        WHEN 1 THEN '[' || level || '] ' || service || ' - ' || message
        WHEN 2 THEN '(' || lower(level) || ') ' || service || ': ' || message
        WHEN 3 THEN message WHEN 4 THEN 'NOTE ' || message ELSE level || ' ' || message END AS rest
        FROM ({_STYLED})""",
    "plain_rows",
)
oracle(
    "p07_level_token",
    f"""SELECT line_no, CASE WHEN style IN (3, 4) THEN 'UNKNOWN' ELSE level END AS text_level,
        CASE style WHEN 0 THEN service || ' ' || message WHEN 1 THEN service || ' - ' || message
        WHEN 2 THEN service || ': ' || message WHEN 3 THEN message WHEN 4 THEN 'NOTE ' || message
        ELSE message END AS rest FROM ({_STYLED})""",
    "plain_rows",
)
# Style 5 has no service before the message, so the message's first word, the service
# name, is taken for it.
oracle(
    "p08_service_token",
    f"""SELECT line_no, CASE WHEN style IN (3, 4) THEN NULL ELSE service END AS text_service,
        CASE WHEN style IN (0, 1, 2, 3) THEN message WHEN style = 4 THEN 'NOTE ' || message
        ELSE substr(message, len(service) + 2) END AS rest FROM ({_STYLED})""",
    "plain_rows",
)
oracle(
    "p09_text_message",
    f"""SELECT line_no, CASE WHEN style IN (0, 1, 2, 3) THEN message WHEN style = 4 THEN 'NOTE ' || message
        ELSE substr(message, len(service) + 2) END AS text_message FROM ({_STYLED})""",
    "plain_rows",
)
oracle(
    "p10_synthetic_clock",
    """SELECT line_no, ts, level FROM log_rows WHERE line_no % 10 <> 0 UNION ALL
       SELECT line_no, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(row_number() OVER (ORDER BY line_no) - 1), level
       FROM log_rows WHERE line_no % 10 = 0""",
    "log_rows",
)
oracle(
    "p11_parse_counts",
    f"""SELECT count(*) AS event_count, count(*) FILTER (WHERE style NOT IN (3, 4)) AS parsed_count,
        count(*) FILTER (WHERE style IN (3, 4)) AS unparsed_count FROM ({_STYLED})""",
    "plain_rows",
)
for _name in ("p12_parse_text_lines", "p13_parse_json_lines"):
    oracle(_name, "SELECT line_no, ts, level, service, message FROM log_rows", "log_rows")

# --- masks --------------------------------------------------------------------------------

for _number, (_mask, _, _) in enumerate(fixed.MASKS, 1):
    oracle(
        f"n{_number:02d}_mask_{_mask}",
        f"SELECT line_key, {mask_sql(_mask, 'raw')} AS masked FROM maskable",
        "maskable",
    )
oracle("n14_collapse_spaces", f"SELECT line_key, {collapse_sql('raw')} AS masked FROM maskable", "maskable")
oracle(
    "n15_masked_tokens",
    """SELECT line_key, len(t) AS n_tokens, array_to_string(t, '|') AS tokens FROM (
       SELECT line_key, string_split(CASE WHEN m = '' THEN '<empty>' ELSE m END, ' ') AS t FROM masked)""",
    "masked",
)

# --- template mining ------------------------------------------------------------------------

oracle(
    "t01_routing_keys",
    f"SELECT token, {KEY.format(t='token')} AS key FROM (SELECT DISTINCT unnest(tokens) AS token FROM seqs)",
    "seqs",
)
oracle("t02_leaf_routing", "SELECT first_line, events, leaf FROM route4", "route4")
_NEIGHBOURS = f"""SELECT line_no, p, w FROM (
    SELECT doc_id, line_no, w, lag(w) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM (
    SELECT doc_id, line_no, string_split({collapse_sql('raw')}, ' ') AS w FROM doc_lines)) WHERE len(p) = len(w)"""
oracle(
    "t03_similarity",
    f"""SELECT line_no, {r6("len(list_filter(list_zip(p, w), lambda x: x[1] = '<*>' OR x[1] = x[2])) / len(w)")}
        AS similarity FROM ({_NEIGHBOURS})""",
    "doc_lines",
)
oracle(
    "t04_merge",
    f"""SELECT line_no, array_to_string(list_transform(list_zip(p, w),
        lambda x: CASE WHEN x[1] = x[2] THEN x[1] ELSE '<*>' END), ' ') AS template FROM ({_NEIGHBOURS})""",
    "doc_lines",
)
oracle("t05_mine_log_templates", "SELECT cluster_id, created, template FROM ids", "ids")
def _recursive(name: str) -> None:
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


# The k-th sequence of every leaf is folded into the leaf's templates, all leaves at once.
for _name, _of in (("t05_mine_maskable_lines", ""), ("t05_mine_document_templates", "_docs")):
    oracle(
        _name,
        f"""SELECT 'CLU-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS cluster_id,
            created, template FROM (
            SELECT row_number() OVER (ORDER BY t.created) AS n, t.created AS created,
            array_to_string(t.words, ' ') AS template FROM (
            SELECT unnest(templates) AS t FROM (SELECT *, max(k) OVER (PARTITION BY leaf) AS last FROM folded{_of}) WHERE k = last))""",
        f"folded{_of}",
    )
    _recursive(_name)
oracle("t06_assign_document_lines", "SELECT line_no, created FROM assigned_docs", "assigned_docs")
_recursive("t06_assign_document_lines")
oracle(
    "t06_assign_events",
    "SELECT line_no, cluster_id FROM masked_rows m JOIN ids ON ids.template = m.masked",
    "masked_rows", "ids",
)
oracle("t07_template_ids", "SELECT cluster_id, template AS sequence FROM ids", "ids")
oracle(
    "t08a_template_totals",
    """SELECT event_type, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen
       FROM log_rows GROUP BY event_type""",
    "log_rows",
)
oracle(
    "t08a_service_counts",
    "SELECT event_type, service, count(*) AS events FROM log_rows GROUP BY ALL",
    "log_rows",
)
_LEVELS = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.LEVEL_RANK.items()) + " END"
oracle(
    "t08b_worst_level",
    f"""SELECT event_type, CASE WHEN max({_LEVELS}) > 1
        THEN arg_min(level, (4 - {_LEVELS}) * 1000000000000 + line_no) ELSE 'UNKNOWN' END AS level
        FROM log_rows GROUP BY event_type""",
    "log_rows",
)
oracle(
    "t08c_examples",
    f"""SELECT cluster_id, example, examples FROM ids JOIN (
        SELECT masked AS template, string_agg(raw, chr(10) ORDER BY line_no) AS examples FROM (
        SELECT masked, line_no, {TEXT_LINE} AS raw,
        row_number() OVER (PARTITION BY masked ORDER BY line_no) AS k FROM masked_rows) WHERE k <= 8 GROUP BY masked)
        USING (template)""",
    "masked_rows", "ids",
)
oracle("t09_by_volume", "SELECT cluster_id, count, row_number() OVER (ORDER BY count DESC, created) AS place FROM ids", "ids")
oracle(
    "t10_pattern",
    "SELECT cluster_id, template, len(string_split(template, ' ')) AS token_count FROM ids",
    "ids",
)

# --- clusters and frequency --------------------------------------------------------------------

oracle(
    "c01_clusters",
    """SELECT cluster_id, template, len(string_split(template, ' ')) AS token_count, level, count, example,
       first_seen, last_seen FROM ids""",
    "ids",
)
oracle(
    "c02_primary_service",
    """SELECT event_type, arg_max(service, n * 1000000000000 - first_line) AS primary_service FROM (
       SELECT event_type, service, count(*) AS n, min(line_no) AS first_line FROM log_rows GROUP BY ALL)
       GROUP BY event_type""",
    "log_rows",
)
oracle(
    "f01_window",
    "SELECT s AS window_start, e AS window_end, bucket_s AS bucket_seconds, n AS n_buckets, r AS n_recent FROM win, recent",
    "win", "recent",
)
oracle(
    "f02_bucket_ladder",
    f"""SELECT unit, user_id, period, {r6('span')} AS span, CASE WHEN span <= 1800 THEN 60
        WHEN span <= 10800 THEN 300 WHEN span <= 86400 THEN 3600 WHEN span <= 604800 THEN 21600
        ELSE 86400 END AS bucket_seconds FROM (
        SELECT unit, user_id, CAST(date_trunc(unit, ts) AS TIMESTAMP) AS period,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span
        FROM events, (VALUES ('hour'), ('day'), ('month')) u(unit) GROUP BY ALL)""",
)
oracle(
    "f03_bucket_index",
    """SELECT line_no, greatest(0, least(n - 1,
       CAST(floor((epoch_us(ts) - epoch_us(s)) / (bucket_s * 1000000.0)) AS BIGINT))) AS bucket_idx FROM log_rows, win""",
    "log_rows", "win",
)
oracle(
    "f04_dense_series",
    "SELECT template AS kind, idx AS bucket_idx, CAST(bucket_ts AS TIMESTAMP) AS bucket_ts, c AS events FROM series",
    "series",
)
oracle(
    "f05_recent_and_baseline",
    f"SELECT template AS kind, recent_count, {r6('baseline_rate')} AS baseline_rate FROM freq",
    "freq",
)
oracle("f06_growth", f"SELECT template AS kind, {r6('growth_pct')} AS growth_pct FROM freq", "freq")
_ERRORS = ", ".join(text(x) for x in fixed.ERROR_LEVELS)
_WARNINGS = ", ".join(text(x) for x in fixed.WARNING_LEVELS)
oracle(
    "f07_error_trend",
    f"""SELECT bucket_idx, count(*) FILTER (WHERE level IN ({_ERRORS})) AS errors,
        count(*) FILTER (WHERE level IN ({_WARNINGS})) AS warnings FROM (
        SELECT level, greatest(0, least(n - 1,
        CAST(floor((epoch_us(ts) - epoch_us(s)) / (bucket_s * 1000000.0)) AS BIGINT))) AS bucket_idx
        FROM log_rows, win) GROUP BY bucket_idx""",
    "log_rows", "win",
)

# --- anomaly --------------------------------------------------------------------------------------

oracle(
    "a01_sensitivity",
    f"""SELECT sensitivity, kind, {r6('bar')} AS effective_threshold,
        {r6('1.0 / (1.0 + exp(-(z - bar) / softness))')} AS anomaly_score,
        z >= bar AND peak >= 4 AND (center < 1e-9 OR peak >= center * 1.5) AS is_anomaly FROM (
        SELECT CAST(sens AS DOUBLE) AS sensitivity, template AS kind, z, peak, center,
        3.5 - sens * 2.5 + sqrt(2.0 * ln(greatest(n, 2))) AS bar, greatest(1.0, (3.5 - sens * 2.5) / 2.0) AS softness
        FROM anom, (VALUES (0.0), (0.3), (0.6), (1.0)) t(sens))""",
    "anom",
)
for _name, _columns in {
    "a02_median": r6("center") + " AS center",
    "a03_robust_scale": r6("scale") + " AS scale",
    "a04_scan_correction": r6("bar") + " AS effective_threshold",
    "a05_peak_bucket": "peak_idx, peak AS peak_count",
    "a06_zscore": r6("z") + " AS zscore",
    "a07_anomaly_score": r6("anomaly_score") + " AS anomaly_score",
    "a08_peak_is_recent": "peak_is_recent",
    "a09_is_anomaly": "is_anomaly",
}.items():
    oracle(_name, f"SELECT template AS kind, {_columns} FROM anom", "anom")

# --- severity and confidence ----------------------------------------------------------------------------

for _number, _factor in enumerate(("level", "criticality", "volume", "growth", "breadth"), 1):
    oracle(
        f"v{_number:02d}_{_factor}_factor",
        f"SELECT cluster_id, {r6('f_' + _factor)} AS {_factor} FROM clu",
        "clu",
    )
oracle("v06_severity_score", f"SELECT cluster_id, {r6('severity_score')} AS severity_score FROM clu", "clu")
oracle("v07_severity_label", "SELECT cluster_id, severity FROM clu", "clu")
oracle("v08_confidence", f"SELECT cluster_id, {r6('confidence')} AS confidence FROM clu", "clu")
_FACTORS = " UNION ALL ".join(
    f"SELECT cluster_id, {i} AS o, '{name}' AS factor, f_{name} AS value, CAST({weight} AS DOUBLE) AS weight FROM clu"
    for i, (name, weight) in enumerate(fixed.SEVERITY_WEIGHTS.items())
)
oracle(
    "v09_factor_rows",
    f"""SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY value * weight DESC, o) AS place,
        factor, {r6('value')} AS value, weight, {r6('value * weight')} AS contribution FROM ({_FACTORS})""",
    "clu",
)

# --- incidents and correlation -------------------------------------------------------------------------------

oracle("i01_promoted", "SELECT cluster_id FROM inc", "inc")
oracle("i02_ranked_ids", "SELECT incident_id, rank, cluster_id FROM inc", "inc")
oracle(
    "i03_titles",
    """SELECT cluster_id, rtrim(left(array_to_string(string_split(example, ' ')[1:9], ' '), 80)) AS title FROM ids""",
    "ids",
)
oracle(
    "i04_status",
    """SELECT cluster_id, CASE WHEN recent_count = 0 OR NOT peak_is_recent THEN 'Resolved'
       WHEN severity = 'Critical' THEN 'Active' WHEN severity = 'High' THEN 'Investigating'
       ELSE 'Monitoring' END AS status FROM clu""",
    "clu",
)
for _name, _part in {"j01_dependency_edges": "dep_edge", "j02_temporal_edges": "temp_edge"}.items():
    oracle(_name, f"SELECT upstream_id, downstream_id, {r6('lag_seconds')} AS lag_seconds FROM {_part}", _part)
oracle(
    "j03_correlated_ids",
    """SELECT i.incident_id, coalesce(string_agg(other_id, ',' ORDER BY found), '') AS correlated_ids
       FROM inc i LEFT JOIN link USING (incident_id) GROUP BY i.incident_id""",
    "inc", "link",
)
oracle("j04_edge_details", "SELECT upstream_id, downstream_id, kind, detail FROM edge", "edge")

# --- dashboard ----------------------------------------------------------------------------------------------------

COUNT_TEXT = """CASE WHEN {x} >= 1000000 THEN printf('%.1f', {x} / 1e6) || 'M'
  WHEN {x} >= 1000 THEN printf('%.1f', {x} / 1e3) || 'K' ELSE CAST(CAST({x} AS BIGINT) AS VARCHAR) END"""
DURATION_TEXT = """CASE WHEN {x} / 60.0 >= 60 THEN printf('%.1f', {x} / 60.0 / 60.0) || 'h'
  ELSE printf('%.0f', greatest({x} / 60.0, 0.0)) || 'm' END"""


def count_text(x: str) -> str:
    return COUNT_TEXT.replace("{x}", x)


def duration_text(x: str) -> str:
    return DURATION_TEXT.replace("{x}", x)


oracle(
    "k01_kpis",
    f"""SELECT 0 AS place, 'events' AS key, 'Total log events' AS label, {count_text('r.n')} AS value,
        CAST(r.n AS DOUBLE) AS raw, {r6('(r.n - p.n) / p.n * 100.0')} AS delta_pct, 'analyzed this run' AS hint
        FROM row_count r, plain_count p
        UNION ALL SELECT 1, 'active', 'Active incidents', CAST(n AS VARCHAR), n, NULL, 'across ' || s || ' services'
        FROM (SELECT count(*) AS n, count(DISTINCT primary_service) AS s FROM inc WHERE {ACTIVE})
        UNION ALL SELECT 2, 'critical', 'Critical incidents', CAST(count(*) AS VARCHAR), count(*), NULL, 'need attention'
        FROM inc WHERE severity = 'Critical'
        UNION ALL SELECT 3, 'anomalies', 'Anomaly clusters', CAST(count(*) AS VARCHAR), count(*), NULL, 'detected'
        FROM clu WHERE is_anomaly
        UNION ALL SELECT 4, 'mttr', 'Mean incident duration', {duration_text('seconds')}, {r6('seconds')}, NULL,
        'first → last seen' FROM mttr""",
    "row_count", "plain_count", "inc", "clu", "mttr",
)
oracle(
    "k02_event_delta",
    f"SELECT 2 AS run_id, {r6('(r.n - p.n) / p.n * 100.0')} AS delta_pct FROM row_count r, plain_count p",
    "row_count", "plain_count",
)
oracle("k03_mean_duration", f"SELECT 2 AS run_id, {r6('seconds')} AS seconds FROM mttr", "mttr")
_SEVERITY_SUMS = ", ".join(
    f"CAST(coalesce(sum(c) FILTER (WHERE severity = '{s}'), 0) AS BIGINT) AS \"{s}\"" for s in fixed.SEVERITIES
)
oracle(
    "k04_timeline",
    f"""SELECT CAST(bucket_ts AS TIMESTAMP) AS bucket_ts, {_SEVERITY_SUMS}
        FROM inc JOIN series USING (template) GROUP BY bucket_ts""",
    "inc", "series",
)
oracle(
    "k05_service_health",
    """SELECT service, status, incidents, row_number() OVER (ORDER BY CASE status WHEN 'Critical' THEN 0
       WHEN 'Degraded' THEN 1 ELSE 2 END, service) AS place FROM health""",
    "health",
)
oracle(
    "k06_health_score",
    """SELECT greatest(0, least(100, 100 - c * 12 - d * 6)) AS health_score,
       CASE WHEN c > 0 THEN 'Degraded — ' || c || ' critical service' || CASE WHEN c <> 1 THEN 's' ELSE '' END
       WHEN d > 0 THEN 'Degraded — ' || d || ' service' || CASE WHEN d <> 1 THEN 's' ELSE '' END || ' at risk'
       ELSE 'All systems operational' END AS health_summary FROM (
       SELECT count(*) FILTER (WHERE status = 'Critical') AS c, count(*) FILTER (WHERE status = 'Degraded') AS d
       FROM health)""",
    "health",
)
oracle(
    "k07_top_clusters",
    f"""SELECT cluster_id, i.incident_id, coalesce(i.title, left(c.example, 60)) AS title, c.primary_service AS service,
        c.severity, c.count, {r6('c.growth_pct')} AS growth_pct, {r6('c.baseline_rate')} AS baseline_rate
        FROM clu c LEFT JOIN (SELECT cluster_id, incident_id, title FROM inc) i USING (cluster_id)
        ORDER BY c.anomaly_score DESC, c.growth_pct DESC, c.count DESC, c.created LIMIT 5""",
    "clu", "inc",
)
oracle(
    "k08_funnel",
    """SELECT r.n AS events, r.n AS parsed, 0 AS unparsed, (SELECT count(*) FROM clu) AS clusters,
       (SELECT count(*) FROM clu WHERE is_anomaly) AS anomalies, (SELECT count(*) FROM inc) AS incidents,
       (SELECT count(*) FROM edge) AS correlations FROM row_count r""",
    "row_count", "clu", "inc", "edge",
)
oracle("k09_insights", "SELECT place, kind, title, detail, incident_id FROM insight", "insight")
_LABELS = values(list(enumerate(fixed.SEVERITIES)))
_DISTRIBUTION = f"""SELECT place, severity, (SELECT count(*) FROM inc WHERE inc.severity = l.severity) AS incidents
    FROM (VALUES {_LABELS}) l(place, severity)"""
oracle("k10_severity_distribution", _DISTRIBUTION, "inc")
oracle(
    "k11_trends",
    f"""SELECT CAST(bucket_ts AS TIMESTAMP) AS bucket_ts,
        CAST(coalesce(sum(c) FILTER (WHERE level IN ({_ERRORS})), 0) AS BIGINT) AS errors,
        CAST(coalesce(sum(c) FILTER (WHERE level IN ({_WARNINGS})), 0) AS BIGINT) AS warnings
        FROM series JOIN tpl USING (template) GROUP BY bucket_ts""",
    "series", "tpl",
)
oracle("k12_cluster_frequency", "SELECT cluster_id, count FROM ids ORDER BY count DESC, created LIMIT 8", "ids")
oracle(
    "k13_run_summary",
    """SELECT 2 AS run_id, 'events-bursts' AS source_name, r.n AS event_count, r.n AS parsed_count, 0 AS unparsed_count,
       (SELECT count(*) FROM clu) AS cluster_count, (SELECT count(*) FROM inc) AS incident_count,
       s AS window_start, e AS window_end, TIMESTAMP '2024-02-02 00:00:00' AS created_at FROM row_count r, win""",
    "row_count", "clu", "inc", "win",
)
oracle(
    "k15_severity_shares",
    f"""SELECT *, CAST(floor(incidents / greatest((SELECT count(*) FROM inc), 1) * 100 + 0.5) AS BIGINT) AS percent
        FROM ({_DISTRIBUTION})""",
    "inc",
)
oracle(
    "k16_status_counts",
    """SELECT place, status, (SELECT count(*) FROM health WHERE health.status = l.status) AS services
       FROM (VALUES (0, 'Critical'), (1, 'Degraded'), (2, 'Healthy')) l(place, status)""",
    "health",
)
oracle(
    "k17_peak_buckets",
    """SELECT cluster_id, idx AS bucket_idx, CAST(bucket_ts AS TIMESTAMP) AS bucket_ts, c AS events,
       c = max(c) OVER (PARTITION BY template) AND c > 0 AS is_peak FROM series JOIN ids USING (template)""",
    "series", "ids",
)
oracle(
    "k18_report",
    f"""SELECT 'RPT-1002' AS report_id, 'Reliability Review — events-bursts' AS headline,
        CAST(greatest(total, 1) AS VARCHAR) AS incidents, CAST(critical AS VARCHAR) AS critical, mean AS mean_duration,
        {count_text('n')} AS events_analyzed,
        'This window analyzed ' || format('{{:,}}', n) || ' log events, which the engine compressed into ' || clusters ||
        ' clusters. ' || total || ' incidents were detected across ' || services || ' services, ' || critical ||
        ' of them critical. Mean incident duration was ' || mean || '.' || coalesce(' ' || cascade, '') AS executive_summary
        FROM (SELECT r.n, (SELECT count(*) FROM inc) AS total, (SELECT count(*) FROM clu) AS clusters,
        (SELECT count(*) FROM inc WHERE severity = 'Critical') AS critical, (SELECT count(*) FROM health) AS services,
        (SELECT {duration_text('seconds')} FROM mttr) AS mean,
        (SELECT arg_min(detail, place) FROM insight WHERE kind = 'Correlation') AS cascade FROM row_count r)""",
    "row_count", "inc", "clu", "health", "mttr", "insight",
)
oracle(
    "k19_count_and_duration_text",
    f"""SELECT o_orderkey, {count_text('x')} AS count_text, {duration_text('(x / 7)')} AS duration_text
        FROM (SELECT o_orderkey, floor(o_totalprice * (o_orderkey % 20)) AS x FROM orders)""",
)
oracle(
    "k20_growth_text",
    """SELECT cluster_id, CASE WHEN baseline_rate < 1e-6 AND growth_pct >= 9990 THEN 'NEW'
       WHEN growth_pct >= 9990 THEN '▲ 9999%+' ELSE CASE WHEN growth_pct > 0 THEN '▲' WHEN growth_pct < 0 THEN '▼'
       ELSE '' END || ' ' || abs(CAST(floor(growth_pct + 0.5) AS BIGINT)) || '%' END AS text FROM clu""",
    "clu",
)

# --- explorer and detail --------------------------------------------------------------------------------------------

_ORDER = f"{SEV_RANK} DESC, confidence DESC, rank"
oracle("l01_filter", "SELECT incident_id, severity, status FROM inc WHERE severity = 'High'", "inc")
oracle(
    "l02_search",
    """SELECT incident_id, title FROM inc WHERE contains(lower(title), 'api')
       OR contains(lower(coalesce(primary_service, '')), 'api') OR contains(lower(incident_id), 'api')
       OR contains(lower(cluster_id), 'api')""",
    "inc",
)
oracle(
    "l03_severity_order",
    f"""SELECT incident_id, severity, {r6('confidence')} AS confidence, row_number() OVER (ORDER BY {_ORDER}) AS place
        FROM inc""",
    "inc",
)
oracle("l04_baseline_rates", f"SELECT incident_id, {r6('baseline_rate')} AS baseline_rate FROM inc", "inc")
oracle(
    "l05_other_orders",
    " UNION ALL ".join(
        f"SELECT '{key}' AS sort, incident_id, row_number() OVER (ORDER BY {first} {_ORDER}) AS place FROM inc"
        for key, first in (
            ("severity", ""), ("confidence", "confidence DESC,"), ("recent", "last_seen DESC,"), ("volume", "count DESC,"),
        )
    ),
    "inc",
)
oracle(
    "l06_joined_search",
    """SELECT incident_id FROM inc WHERE contains(lower(incident_id || ' ' || title || ' ' ||
       coalesce(primary_service, '') || ' ' || cluster_id), 'api clu')""",
    "inc",
)
oracle(
    "l07_incident_detail",
    f"""SELECT incident_id, title, {r6('baseline_rate')} AS baseline_rate, template AS normalized_example,
        (SELECT n FROM win) AS n_buckets,
        (SELECT string_agg(factor, ',' ORDER BY value * weight DESC, o) FROM ({_FACTORS}) f WHERE f.cluster_id = i.cluster_id) AS factors,
        coalesce((SELECT string_agg(CASE WHEN upstream_id = i.incident_id THEN downstream_id ELSE upstream_id END, ','
        ORDER BY stage, order_a, order_b) FROM edge WHERE i.incident_id IN (upstream_id, downstream_id)), '') AS linked,
        coalesce((SELECT string_agg(other_id, ',' ORDER BY found) FROM link WHERE link.incident_id = i.incident_id), '') AS related
        FROM inc i WHERE rank = 1""",
    "inc", "win", "clu", "edge", "link",
)
oracle(
    "l07_incident_buckets",
    """SELECT incident_id, cluster_id, idx AS bucket_idx, CAST(bucket_ts AS TIMESTAMP) AS bucket_ts, c AS events
       FROM inc JOIN series USING (template)""",
    "inc", "series",
)
oracle("l08_normalized_example", "SELECT cluster_id, template AS normalized_example FROM ids", "ids")
oracle(
    "l09_cause_chain",
    f"""SELECT downstream_id AS incident_id, upstream_id AS other_id, 'upstream' AS direction, kind, {r6('lag_seconds')} AS lag_seconds FROM edge
        UNION ALL SELECT upstream_id, downstream_id, 'downstream', kind, {r6('lag_seconds')} FROM edge""",
    "edge",
)
oracle(
    "l10_related",
    f"""SELECT l.incident_id AS of_incident, i.incident_id, severity, {r6('baseline_rate')} AS baseline_rate
        FROM link l JOIN inc i ON i.incident_id = l.other_id""",
    "link", "inc",
)
oracle(
    "l11_cluster_services",
    """SELECT cluster_id, service, n AS events, row_number() OVER (ORDER BY cluster_id, n DESC, first_line) AS place
       FROM svc JOIN ids USING (template)""",
    "svc", "ids",
)
oracle(
    "l12_factor_bars",
    f"""SELECT cluster_id, factor, {r6('value * weight / greatest(max(value * weight) OVER (PARTITION BY cluster_id), 0.001)')}
        AS width FROM ({_FACTORS})""",
    "clu",
)

# --- explanations ------------------------------------------------------------------------------------------------------

oracle("m01_root_cause", "SELECT incident_id, cause FROM told", "told")
oracle("m02_suggested_fixes", "SELECT incident_id, fixes AS suggested_fixes FROM told", "told")
oracle("m03_growth_phrase", "SELECT incident_id, phrase FROM told", "told")
oracle(
    "m04_linked_ids",
    """SELECT incident_id, coalesce(replace(ups, ', ', ','), '') AS upstream,
       coalesce(replace(downs, ', ', ','), '') AS downstream FROM told""",
    "told",
)
oracle("m05_explanations", "SELECT incident_id, summary, root_cause, suggested_fixes FROM explained", "explained")


def _python_list(ids: str) -> str:
    return f"coalesce('[''' || replace({ids}, ', ', ''', ''') || ''']', 'none')"


oracle(
    "m06_prompts",
    f"""SELECT incident_id, concat_ws(chr(10),
        'You are an SRE assistant. The detection ENGINE has already computed the analysis below. Do NOT re-detect or re-score. Only explain it clearly.',
        '', 'Incident: ' || incident_id, 'Service: ' || coalesce(primary_service, 'None'),
        'Severity: ' || severity || ' (confidence ' || printf('%.0f', confidence * 100) || '%)', 'Status: ' || status,
        'Detected template: ' || template, 'Log level: ' || level, 'Event count: ' || count,
        'Anomaly z-score: ' || printf('%.2f', z) || '; growth vs baseline: ' || printf('%.0f', growth_pct) || '%',
        'Upstream causes: ' || {_python_list('ups')}, 'Downstream impact: ' || {_python_list('downs')},
        'Representative log: ' || example, '',
        'Respond as JSON with keys: summary (2-3 sentences), root_cause (1-2 sentences), suggested_fixes (array of 3 short imperative strings).'
        ) AS prompt FROM told""",
    "told",
)
oracle(
    "m07_outside_explanations",
    """SELECT incident_id, CASE WHEN rank % 3 = 1 THEN 'deterministic' ELSE 'gemini' END AS source,
       CASE WHEN rank % 3 = 1 THEN root_cause ELSE '5' END AS root_cause,
       CASE rank % 3 WHEN 1 THEN suggested_fixes WHEN 0 THEN 'a | b | c | d | e' ELSE 'one' END AS suggested_fixes
       FROM explained JOIN inc USING (incident_id)""",
    "explained", "inc",
)

# --- end to end -----------------------------------------------------------------------------------------------------------

oracle(
    "e01_analyze_text",
    f"""SELECT incident_id, cluster_id, title, primary_service AS service, severity, status,
        {r6('confidence')} AS confidence, {r6('anomaly_score')} AS anomaly_score, {r6('growth_pct')} AS growth_pct,
        count, first_seen, last_seen FROM inc""",
    "inc",
)
oracle("e02_analyze_ndjson", "SELECT incident_id, cluster_id, severity, status, count FROM inc", "inc")

# Every widget of the two pages has a statement of its own above.
_SHOWN = {
    "run": ("k13_run_summary", "event_count + parsed_count + unparsed_count + cluster_count + incident_count", "source_name"),
    "kpis": ("k01_kpis", "0", "key label value hint"),
    "timeline": ("k04_timeline", '"Critical" + "High" + "Medium" + "Low"', ""),
    "health": ("k06_health_score", "health_score", "health_summary"),
    "service_health": ("k05_service_health", "incidents", "service status"),
    "top_clusters": ("k07_top_clusters", "count", "cluster_id incident_id title service severity"),
    "severity_distribution": ("k10_severity_distribution", "incidents", "severity"),
    "insights": ("k09_insights", "0", "kind title detail incident_id"),
    "funnel": ("k08_funnel", "events + parsed + unparsed + clusters + anomalies + incidents + correlations", ""),
    "trends": ("k11_trends", "errors + warnings", ""),
    "cluster_frequency": ("k12_cluster_frequency", "count", "cluster_id"),
}
_PAGES = {
    "dashboard": "run kpis timeline health service_health top_clusters severity_distribution insights funnel",
    "analytics": "run trends cluster_frequency timeline",
}


def _shown(page: str, widget: str) -> str:
    name, numbers, texts = _SHOWN[widget]
    letters = " + ".join(["0", *[f"coalesce(length({t}), 0)" for t in texts.split()]])
    return f"""SELECT '{page}' AS page, '{widget}' AS widget, count(*) AS rows,
        CAST(coalesce(sum({numbers}), 0) AS BIGINT) AS numbers, CAST(coalesce(sum({letters}), 0) AS BIGINT) AS letters
        FROM ({ORACLES[name]})"""


ORACLES["k14_whole_dashboard"] = " UNION ALL ".join(
    _shown(page, widget) for page, widgets in _PAGES.items() for widget in widgets.split()
)

"""Common table expressions the oracle statements are built from.

They start from the driver tables and repeat the definitions of the log lines in SQL; they
share no code with the library except the constants in ``cinderlog.fixed`` and the line
definitions in ``cinderlog.plans.adapters``.
"""

from __future__ import annotations

from cinderlog import fixed
from cinderlog.plans.adapters import BURSTS, SERVICES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(v):
        return text(v) if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


ISO = "%Y-%m-%dT%H:%M:%S.%fZ"
SERVICE_LIST = "[" + ", ".join(text(s) for s in SERVICES) + "]"

PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def part(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    PARTS[name] = (sql, needs)


def statement(final: str, *needs: str) -> str:
    """The final select behind the expressions it needs, in definition order."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for other in PARTS[name][1]:
                add(other)

    for name in needs:
        add(name)
    ctes = ",\n".join(f"{name} AS ({sql})" for name, (sql, _) in PARTS.items() if name in wanted)
    return f"WITH {ctes}\n{final}" if ctes else final


# --- log rows ---------------------------------------------------------------------------

part("ev", f"SELECT *, {SERVICE_LIST}[user_id % 7 + 1] AS service FROM events")
part(
    "burst",
    "SELECT * FROM (VALUES " + values(BURSTS)
    + ") t(service, event_type, on_day, copies, start_s, level, words)",
)
part(
    "plain_rows",
    """SELECT event_id * 64 + 1 AS line_no, ts,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
       service, event_type,
       service || ' ' || event_type || ' user=' || user_id || ' cents=' ||
       CAST(round(value * 100) AS BIGINT) || ' after ' || (user_id % 900) || 'ms' AS message
       FROM ev""",
    ("ev",),
)
part(
    "burst_rows",
    """SELECT e.event_id * 64 + 1 + k AS line_no,
       date_trunc('day', e.ts) + to_seconds(b.start_s + k * 20 + e.event_id % 20) AS ts,
       b.level, e.service, e.event_type,
       b.words || ' user=' || e.user_id || ' after ' || (e.user_id % 900) || 'ms' AS message
       FROM ev e JOIN burst b ON e.service = b.service AND e.event_type = b.event_type
       AND day(e.ts) = b.on_day, unnest(range(1, b.copies + 1)) c(k)""",
    ("ev", "burst"),
)
part(
    "log_rows",
    "SELECT * FROM plain_rows UNION ALL SELECT line_no, CAST(ts AS TIMESTAMP), level, service, event_type, message FROM burst_rows",
    ("plain_rows", "burst_rows"),
)
TEXT_LINE = f"strftime(ts, '{ISO}') || ' ' || level || ' ' || service || ' ' || message"
LEVEL_RANK = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.LEVEL_RANK.items()) + " ELSE 1 END"

part(
    "masked_rows",
    r"""SELECT *, regexp_replace(regexp_replace(message, '\d+ms', '<DUR>', 'g'),
        '([= ])\d+', '\1<NUM>', 'g') AS masked FROM log_rows""",
    ("log_rows",),
)

# --- clusters ------------------------------------------------------------------------------

part(
    "win",
    """SELECT *, CAST(floor(greatest(span, bucket_s) / bucket_s) AS BIGINT) + 1 AS n FROM (
       SELECT *, CASE WHEN span <= 1800 THEN 60 WHEN span <= 10800 THEN 300 WHEN span <= 86400 THEN 3600
       WHEN span <= 604800 THEN 21600 ELSE 86400 END AS bucket_s FROM (
       SELECT min(ts) AS s, max(ts) AS e, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span
       FROM log_rows))""",
    ("log_rows",),
)
part("recent", "SELECT greatest(1, n // 6) AS r FROM win", ("win",))
part(
    "tpl",
    f"""SELECT masked AS template, min(line_no) AS created, count(*) AS count, min(ts) AS first_seen,
        max(ts) AS last_seen, arg_min(message, line_no) AS example,
        CASE WHEN max({LEVEL_RANK}) > 1 THEN arg_min(level, (4 - {LEVEL_RANK}) * 1000000000000 + line_no)
        ELSE 'UNKNOWN' END AS level
        FROM masked_rows GROUP BY masked""",
    ("masked_rows",),
)
part(
    "svc",
    """SELECT masked AS template, service, count(*) AS n, min(line_no) AS first_line
       FROM masked_rows GROUP BY ALL""",
    ("masked_rows",),
)
part(
    "ids",
    """SELECT t.*, 'CLU-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END
       AS cluster_id, (SELECT arg_max(service, n * 1000000000000 - first_line) FROM svc s
       WHERE s.template = t.template) AS primary_service,
       (SELECT count(*) FROM svc s WHERE s.template = t.template) AS n_services
       FROM (SELECT *, row_number() OVER (ORDER BY created) AS k FROM tpl) t""",
    ("tpl", "svc"),
)
part(
    "hits",
    """SELECT masked AS template, greatest(0, least(n - 1,
       CAST(floor((epoch_us(ts) - epoch_us(s)) / (bucket_s * 1000000.0)) AS BIGINT))) AS idx, count(*) AS c
       FROM masked_rows, win GROUP BY ALL""",
    ("masked_rows", "win"),
)
part(
    "series",
    """SELECT t.template, g.idx, coalesce(h.c, 0) AS c, s + to_seconds(g.idx * bucket_s) AS bucket_ts, n, r
       FROM tpl t, win, recent, unnest(range(0, n)) g(idx)
       LEFT JOIN hits h ON h.template = t.template AND h.idx = g.idx""",
    ("tpl", "win", "recent", "hits"),
)
part(
    "freq",
    """SELECT *, greatest(-100.0, least(9999.0,
       (recent_count / r - baseline_rate) / (baseline_rate + 1e-9) * 100.0)) AS growth_pct FROM (
       SELECT template, any_value(n) AS n, any_value(r) AS r,
       CAST(sum(c) FILTER (WHERE idx >= n - r) AS BIGINT) AS recent_count,
       coalesce(avg(c) FILTER (WHERE idx < n - r), avg(c) FILTER (WHERE idx >= n - r)) AS baseline_rate
       FROM series GROUP BY template)""",
    ("series",),
)
part("med", "SELECT template, median(c) AS center FROM series GROUP BY template", ("series",))
part(
    "anom",
    """SELECT *, z >= bar AND peak >= 4 AND (center < 1e-9 OR peak >= center * 1.5) AS is_anomaly,
       1.0 / (1.0 + exp(-(z - bar) / 1.0)) AS anomaly_score, peak_idx >= n - r AS peak_is_recent FROM (
       SELECT *, least(10.0, (peak - center) / scale) AS z, 2.0 + sqrt(2.0 * ln(greatest(n, 2))) AS bar FROM (
       SELECT s.template, any_value(n) AS n, any_value(r) AS r, any_value(center) AS center,
       greatest(1.4826 * median(abs(c - center)), sqrt(greatest(any_value(center), 1.0)), 1.0) AS scale,
       max(c) AS peak, arg_max(idx, c * 1000000 - idx) AS peak_idx
       FROM series s JOIN med USING (template) GROUP BY s.template))""",
    ("series", "med"),
)
CRITICALITY = "CASE primary_service " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in fixed.SERVICE_CRITICALITY.items()
) + " ELSE 0.5 END"
part(
    "clu",
    f"""SELECT *, CASE WHEN severity_score >= 0.75 THEN 'Critical' WHEN severity_score >= 0.55 THEN 'High'
        WHEN severity_score >= 0.35 THEN 'Medium' ELSE 'Low' END AS severity,
        least(0.99, greatest(0.5, 0.60 + 0.38 * (0.45 * least(log10(count + 1) / log10(500), 1.0)
        + 0.35 * f_anomaly + 0.20 * f_level))) AS confidence FROM (
        SELECT *, CAST(0.30 AS DOUBLE) * f_anomaly + CAST(0.25 AS DOUBLE) * f_level + CAST(0.15 AS DOUBLE) * f_criticality
        + CAST(0.15 AS DOUBLE) * f_volume + CAST(0.10 AS DOUBLE) * f_growth + CAST(0.05 AS DOUBLE) * f_breadth AS severity_score FROM (
        SELECT i.*, f.recent_count, f.baseline_rate, f.growth_pct, a.z, a.is_anomaly, a.anomaly_score,
        a.peak_is_recent, a.anomaly_score AS f_anomaly, ({LEVEL_RANK}) / 4.0 AS f_level,
        CAST({CRITICALITY} AS DOUBLE) AS f_criticality,
        log10(count + 1) / (log10(max(count) OVER () + 1) + 1e-9) AS f_volume,
        least(greatest(growth_pct / 300.0, 0.0), 1.0) AS f_growth,
        least(greatest((n_services - 1) / 3.0, 0.0), 1.0) AS f_breadth
        FROM ids i JOIN freq f USING (template) JOIN anom a USING (template)))""",
    ("ids", "freq", "anom"),
)

# --- incidents and edges ----------------------------------------------------------------------

TITLE = """rtrim(left(list_aggregate(list_filter(string_split(example, ' '),
  lambda w: w <> '')[1:9], 'string_agg', ' '), 80))"""
part(
    "inc",
    f"""SELECT *, 'INC-' || CAST(4800 + count(*) OVER () - rank + 1 AS VARCHAR) AS incident_id,
        {TITLE} AS title, CASE WHEN recent_count = 0 OR NOT peak_is_recent THEN 'Resolved'
        WHEN severity = 'Critical' THEN 'Active' WHEN severity = 'High' THEN 'Investigating'
        ELSE 'Monitoring' END AS status FROM (
        SELECT *, row_number() OVER (ORDER BY severity_score DESC, anomaly_score DESC, count DESC, created) AS rank
        FROM clu WHERE is_anomaly OR ({LEVEL_RANK} >= 2 AND severity_score >= 0.35))""",
    ("clu",),
)
part(
    "dep",
    "SELECT * FROM (VALUES "
    + values([(d, u) for d, ups in fixed.DEPENDENCIES.items() for u in ups])
    + ") t(down_service, up_service)",
)
part(
    "dep_edge",
    """SELECT u.incident_id AS upstream_id, d.incident_id AS downstream_id, 'dependency' AS kind,
       d.primary_service || ' depends on ' || u.primary_service || '; ' || d.incident_id || ' ignited ~' ||
       printf('%.0f', greatest(lag, 0.0)) || 's after ' || u.incident_id AS detail, lag AS lag_seconds,
       0 AS stage, d.rank AS order_a, u.rank AS order_b FROM (
       SELECT d, u, (epoch_us(d.first_seen) - epoch_us(u.first_seen)) / 1e6 AS lag
       FROM inc d JOIN dep ON d.primary_service = dep.down_service
       JOIN inc u ON u.primary_service = dep.up_service AND u.incident_id <> d.incident_id)
       WHERE lag BETWEEN -120 AND 3600""",
    ("inc", "dep"),
)
part(
    "temp_edge",
    """SELECT up AS upstream_id, down AS downstream_id, 'temporal' AS kind,
       up || ' and ' || down || ' spiked within ' || printf('%.0f', lag) || 's across services' AS detail,
       lag AS lag_seconds, 1 AS stage, order_a, order_b FROM (
       SELECT CASE WHEN a.first_seen <= b.first_seen THEN a.incident_id ELSE b.incident_id END AS up,
       CASE WHEN a.first_seen <= b.first_seen THEN b.incident_id ELSE a.incident_id END AS down,
       abs(epoch_us(a.first_seen) - epoch_us(b.first_seen)) / 1e6 AS lag, a.rank AS order_a, b.rank AS order_b
       FROM inc a JOIN inc b ON a.rank < b.rank AND a.primary_service IS DISTINCT FROM b.primary_service
       WHERE a.severity IN ('Critical', 'High') AND b.severity IN ('Critical', 'High')
       AND NOT EXISTS (SELECT 1 FROM dep_edge e WHERE (e.upstream_id = a.incident_id AND e.downstream_id = b.incident_id)
       OR (e.upstream_id = b.incident_id AND e.downstream_id = a.incident_id)))
       WHERE lag <= 180""",
    ("inc", "dep_edge"),
)
part("edge", "SELECT * FROM dep_edge UNION ALL SELECT * FROM temp_edge", ("dep_edge", "temp_edge"))
part(
    "link",
    """SELECT incident_id, other_id, min(found) AS found FROM (
       SELECT upstream_id AS incident_id, downstream_id AS other_id, stage * 1000000 + order_a * 1000 + order_b AS found FROM edge
       UNION ALL
       SELECT downstream_id, upstream_id, stage * 1000000 + order_a * 1000 + order_b FROM edge) GROUP BY ALL""",
    ("edge",),
)
ACTIVE = "status IN ('Active', 'Investigating', 'Monitoring')"
SEV_RANK = "CASE severity WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END"
part(
    "plain_count",
    "SELECT count(*) AS n FROM plain_rows",
    ("plain_rows",),
)
part("row_count", "SELECT count(*) AS n FROM log_rows", ("log_rows",))
part(
    "mttr",
    """SELECT coalesce(avg(d) FILTER (WHERE status = 'Resolved'), avg(d), 0) AS seconds FROM (
       SELECT status, (epoch_us(last_seen) - epoch_us(first_seen)) / 1e6 AS d FROM inc)""",
    ("inc",),
)
part(
    "health",
    f"""SELECT service, coalesce(grade, 0) AS grade, coalesce(incidents, 0) AS incidents,
       CASE coalesce(grade, 0) WHEN 2 THEN 'Critical' WHEN 1 THEN 'Degraded' ELSE 'Healthy' END AS status
       FROM (SELECT DISTINCT primary_service AS service FROM clu WHERE primary_service IS NOT NULL)
       LEFT JOIN (SELECT primary_service AS service, count(*) AS incidents,
       max(CASE severity WHEN 'Critical' THEN 2 WHEN 'High' THEN 1 WHEN 'Medium' THEN 1 ELSE 0 END) AS grade
       FROM inc WHERE {ACTIVE} GROUP BY 1) USING (service)""",
    ("clu", "inc"),
)
part(
    "insight",
    f"""SELECT row_number() OVER (ORDER BY g, -r, o) AS place, kind, title, detail, incident_id FROM (
       SELECT 0 AS g, r, o, 'Correlation' AS kind, 'Cascading failure detected' AS title,
       downstream_id || ' (' || ds || ') is downstream of ' || upstream_id || ' (' || us || '). ' || detail AS detail,
       upstream_id AS incident_id FROM (
       SELECT *, row_number() OVER (PARTITION BY downstream_id ORDER BY r DESC, o) AS nth FROM (
       SELECT e.*, d.primary_service AS ds, u.primary_service AS us,
       CASE u.severity WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END AS r,
       e.order_a * 1000 + e.order_b AS o
       FROM dep_edge e JOIN inc d ON d.incident_id = e.downstream_id JOIN inc u ON u.incident_id = e.upstream_id))
       WHERE nth = 1
       UNION ALL
       SELECT 1, 0, 0, 'Anomaly', 'Volume spike detected', incident_id || ' on ' || primary_service ||
       ' is spiking (' || count || ' events, ' || lower(severity) || ' severity).', incident_id FROM (
       SELECT * FROM inc WHERE {ACTIVE} AND anomaly_score >= 0.7 ORDER BY anomaly_score DESC, rank LIMIT 1))
       QUALIFY place <= 4""",
    ("dep_edge", "inc"),
)

# --- explanations -----------------------------------------------------------------------------

HAY = "lower(template || ' ' || example || ' ' || title)"


def rule_case(pick) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(hay, {text(w)})" for w in rule[0]) + f" THEN {pick(rule)}"
        for rule in fixed.ROOT_CAUSE_RULES
    )
    return arms


part(
    "told",
    f"""SELECT *, CASE {rule_case(lambda r: text(r[1]))} ELSE {text(fixed.DEFAULT_CAUSE)} END AS cause,
       CASE {rule_case(lambda r: text(' | '.join(r[2])))} ELSE {text(' | '.join(fixed.DEFAULT_FIXES))} END AS fixes,
       CASE WHEN baseline_rate < 1e-6 THEN 'an entirely new pattern with no prior baseline'
       WHEN growth_pct >= 100 THEN 'up ' || printf('%.0f', growth_pct) || '% versus its baseline'
       WHEN growth_pct <= -50 THEN 'now subsiding after an earlier spike'
       ELSE printf('%+.0f', growth_pct) || '% versus its baseline' END AS phrase FROM (
       SELECT i.*, {HAY} AS hay,
       (SELECT string_agg(upstream_id, ', ' ORDER BY stage, order_a, order_b) FROM edge WHERE downstream_id = i.incident_id) AS ups,
       (SELECT string_agg(downstream_id, ', ' ORDER BY stage, order_a, order_b) FROM edge WHERE upstream_id = i.incident_id) AS downs
       FROM inc i)""",
    ("inc", "edge"),
)
part(
    "explained",
    """SELECT incident_id, 'The detection engine flagged ' || incident_id || ' on ' ||
       coalesce(primary_service, 'an unknown service') || ' as ' || severity || ' severity (' ||
       printf('%.0f', confidence * 100) || '% confidence). The ''' || template || ''' cluster produced ' || count ||
       ' events at ' || level || ' level, ' || phrase || ' (anomaly z-score ' || printf('%.1f', z) || ').' ||
       CASE WHEN downs IS NULL THEN '' ELSE ' It appears to be propagating to ' || downs || '.' END AS summary,
       CASE WHEN ups IS NULL THEN '' ELSE 'This incident is downstream of ' || ups || '. ' END || cause AS root_cause,
       fixes AS suggested_fixes FROM told""",
    ("told",),
)

# --- maskable lines and masks -------------------------------------------------------------------

part(
    "doc_lines",
    r"""SELECT doc_id, row_number() OVER (ORDER BY doc_id, place) AS line_no, raw FROM (
       SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) AS place FROM (
       SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS lines
       FROM documents))""",
)
part(
    "maskable",
    f"""SELECT 'event ' || event_id AS line_key, event_id + 1 AS line_no,
       event_type || ' id ' || d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] ||
       ' at ' || strftime(ts, '{ISO}') || '  by u' || user_id || '.x+y@mail' || (event_id % 9) ||
       '.example.com from https://h' || (event_id % 7) || '.example.org/p?q=' || user_id || ' ip 10.' ||
       (user_id % 256) || '.0.' || (event_id % 256) || ':80' || (event_id % 10) || ' took ' || user_id || 'ms or ' ||
       (event_id % 60) || '.5 s size ' || user_id || 'MB ' || (event_id % 9) || '.25 GiB ptr 0x' || d[1:9] ||
       ' run ' || d[1:16] || ' file /var/log/u' || user_id || '/e.log said "code ' || event_id || '" or ''n ' ||
       user_id || ''' at ' || (event_id % 100) || '% and ' || (event_id % 100) || '.5% n=' || event_id || ' delta -' ||
       user_id || '.75 +' || (event_id % 10) || ' ord_' || event_id || ' x' || user_id || ' v' || user_id || '.2 <' ||
       user_id || '>' AS raw FROM (SELECT *, md5(CAST(event_id AS VARCHAR)) AS d FROM events)
       UNION ALL
       SELECT 'document line ' || line_no, line_no + (SELECT max(event_id) + 1 FROM events), raw FROM doc_lines""",
    ("doc_lines",),
)


def mask_sql(name: str, column: str) -> str:
    """One mask in RE2, which has no look-around and whose word boundaries know ASCII only.

    That is enough where a match starts and ends with ASCII. An email may start with any
    letter, and a number must not follow any letter, so there the neighbour is captured.
    Two numbers may share a neighbour, so the possible ends of numbers are marked first.
    """
    sign = next(s for n, _, s in fixed.MASKS if n == name)
    w = r"\p{L}\p{N}_"
    plain = {
        "uuid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
        "ts": r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b",
        "url": r"\bhttps?://[^\s\"']+",
        "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b",
        "duration": r"\b\d+(?:\.\d+)?\s?(?:ns|us|ms|s|m|h)\b",
        "size": r"\b\d+(?:\.\d+)?\s?(?:[kKmMgGtT]i?[bB])\b",
        "hex_prefixed": r"\b0x[0-9a-fA-F]+\b",
        "hex_run": r"\b[0-9a-fA-F]{12,}\b",
        "path": rf"(?:/[{w}.\-]+){{2,}}/?",
        "quoted": "\"[^\"]*\"|'[^']*'",
        "percent": r"\b\d+(?:\.\d+)?%",
    }
    if name in plain:
        return f"regexp_replace({column}, {text(plain[name])}, {text(sign)}, 'g')"
    if name == "email":
        pattern = rf"(^|[^{w}.+-])[{w}.+-]*[{w}][{w}.+-]*@[{w}-]+\.[{w}.-]*[{w}]"
        put = text(rf"\1{sign}")
        return f"regexp_replace({column}, {text(pattern)}, {put}, 'g')"
    ended = rf"regexp_replace({column}, {text(rf'(\d)($|[^{w}>])')}, '\1' || chr(2) || '\2', 'g')"
    number = rf"(^|[^{w}<\x02])[+-]?\d+(?:\x02\.\d+)?\x02"
    put = text(rf"\1{sign}")
    return f"replace(regexp_replace({ended}, {text(number)}, {put}, 'g'), chr(2), '')"


def collapse_sql(column: str) -> str:
    return rf"trim(regexp_replace({column}, '\s+', ' ', 'g'))"


def _chain(source: str) -> str:
    sql = f"SELECT *, raw AS m FROM {source}"
    for name, _, _ in fixed.MASKS:
        sql = f"SELECT * REPLACE ({mask_sql(name, 'm')} AS m) FROM ({sql})"
    return f"SELECT * REPLACE ({collapse_sql('m')} AS m) FROM ({sql})"


KEY = r"CASE WHEN {t} LIKE '<%' AND {t} LIKE '%>' THEN {t} WHEN regexp_matches({t}, '\p{{Nd}}') THEN '<*>' ELSE {t} END"


def _mining(source: str, of: str = "") -> None:
    """The parts of sequential mining over the lines of a part; their names end in `of`."""
    part(f"masked{of}", _chain(source), (source,))
    part(
        f"seqs{of}",
        f"""SELECT sequence, min(line_no) AS first_line, count(*) AS events, string_split(sequence, ' ') AS tokens FROM (
           SELECT CASE WHEN m = '' THEN '<empty>' ELSE m END AS sequence, line_no FROM masked{of} WHERE trim(raw) <> '')
           GROUP BY sequence""",
        (f"masked{of}",),
    )
    part(f"route0{of}", f"SELECT *, CAST(len(tokens) AS VARCHAR) AS leaf FROM seqs{of}", (f"seqs{of}",))
    for level in range(1, 5):
        key = KEY.format(t=f"tokens[{level}]")
        part(
            f"route{level}{of}",
            f"""SELECT * EXCLUDE (key, node, arrival), CASE WHEN key IS NULL THEN node
            ELSE node || chr(31) || CASE WHEN arrival <= 100 THEN key ELSE '<*>' END END AS leaf FROM (
            SELECT r.*, a.arrival FROM (SELECT * EXCLUDE (leaf), leaf AS node,
            CASE WHEN len(tokens) >= {level} THEN {key} END AS key FROM route{level - 1}{of}) r
            LEFT JOIN (SELECT node, key, row_number() OVER (PARTITION BY node ORDER BY line) AS arrival FROM (
            SELECT leaf AS node, {key} AS key, min(first_line) AS line FROM route{level - 1}{of}
            WHERE len(tokens) >= {level} GROUP BY ALL)) a ON a.node = r.node AND a.key = r.key)""",
            (f"route{level - 1}{of}",),
        )
    part(
        f"arrivals{of}",
        f"SELECT sequence, leaf, first_line, tokens, row_number() OVER (PARTITION BY leaf ORDER BY first_line) AS k FROM route4{of}",
        (f"route4{of}",),
    )
    part(
        f"folded{of}",
        f"""SELECT leaf, k, first_line, [{{'created': first_line, 'words': tokens}}] AS templates FROM arrivals{of} WHERE k = 1
            UNION ALL
            SELECT leaf, k, first_line, CASE WHEN list_max(agree) / len(tokens) >= {fixed.SIM_THRESHOLD}
            THEN list_transform(templates, lambda t, i: CASE WHEN i = list_position(agree, list_max(agree))
            THEN {{'created': t.created, 'words': list_transform(list_zip(t.words, tokens),
            lambda x: CASE WHEN x[1] = x[2] THEN x[1] ELSE '<*>' END)}} ELSE t END)
            ELSE list_append(templates, {{'created': first_line, 'words': tokens}}) END AS templates
            FROM (SELECT a.leaf, a.k, a.first_line, a.tokens, f.templates, list_transform(f.templates, lambda t:
            len(list_filter(list_zip(t.words, a.tokens), lambda x: x[1] = '<*>' OR x[1] = x[2]))) AS agree
            FROM folded{of} f JOIN arrivals{of} a ON a.leaf = f.leaf AND a.k = f.k + 1)""",
        (f"arrivals{of}",),
    )


_mining("maskable")
_mining("doc_lines", "_docs")
# An event belongs to the oldest template that covers it once its leaf has read its line.
part(
    "assigned_docs",
    """SELECT line_no, min(t.created) AS created FROM (
       SELECT e.line_no, e.tokens, unnest(f.templates) AS t FROM (
       SELECT m.line_no, a.leaf, a.tokens FROM masked_docs m JOIN arrivals_docs a
       ON a.sequence = CASE WHEN m.m = '' THEN '<empty>' ELSE m.m END WHERE trim(m.raw) <> '') e
       ASOF JOIN folded_docs f ON e.leaf = f.leaf AND e.line_no >= f.first_line)
       WHERE len(list_filter(list_zip(t.words, tokens), lambda x: x[1] = '<*>' OR x[1] = x[2])) = len(tokens)
       GROUP BY line_no""",
    ("masked_docs", "arrivals_docs", "folded_docs"),
)

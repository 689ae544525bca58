"""The registered queries: every operator over the driver tables.

Each entry takes ``(spark, sf_dir)`` and returns a flat table. Operators on lines work on
lines rendered from ``events`` and on the lines of ``documents``. Operators on clusters,
incidents and stored runs work on two analyses of those lines, which are computed once per
session and folder: run 1 without bursts, run 2 with them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import display, jsonline, masks, regex, timestamps
from ..operators.numbering import number_written
from ..operators import (
    anomaly,
    correlation,
    dashboard,
    explain,
    explorer,
    frequency,
    incidents,
    mining,
    parse,
    severity,
    templates,
)
from ..session import Workspace, configure
from ..sources.lines import read_text
from ..sources.runs import Run, RunStore, bucket_rows, filled_rows, run_history, latest_run
from . import adapters
from .analyze import Analysis, analyze

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BASE_TIME = "2024-01-01 00:00:00"
SENSITIVITIES = (0.0, 0.3, 0.6, 1.0)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(function(configure(spark), sf_dir))

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return function


def comparable(df: DataFrame) -> DataFrame:
    """Plain column types: whole numbers as BIGINT, doubles to six places, times without
    zone."""

    def plain(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6) + 0.0
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        return column.alias(field.name)

    return df.select(*[plain(field) for field in df.schema])


# --- shared inputs -----------------------------------------------------------------------

_done: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _done:
        _done[key] = make()
    return _done[key]


def analysis(spark: SparkSession, sf_dir: str, bursts: bool = True) -> Analysis:
    def make() -> Analysis:
        return analyze(Workspace(spark), adapters.text_lines(spark, sf_dir, bursts), BASE_TIME)

    return _once(spark, sf_dir, f"analysis {bursts}", make)


def store(spark: SparkSession, sf_dir: str) -> RunStore:
    def make() -> RunStore:
        runs = RunStore.create(spark, f"{Workspace(spark).root}/runs")
        runs.save(analysis(spark, sf_dir, False), "events-plain", "2024-02-01 00:00:00")
        runs.save(analysis(spark, sf_dir, True), "events-bursts", "2024-02-02 00:00:00")
        return runs

    return _once(spark, sf_dir, "store", make)


def latest(spark: SparkSession, sf_dir: str) -> Run:
    return store(spark, sf_dir).load()


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a stand-in cluster per message kind, for operators that need no mining."""
    rows = adapters.log_rows(spark, sf_dir)
    return rows.withColumn("kind", masks.normalize(F.col("message")))


def _window(rows: DataFrame) -> DataFrame:
    return frequency.analysis_window(
        rows.select(F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"))
    )


def kind_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kinds(spark, sf_dir)
    view = frequency.Window.of(_window(rows))
    counted = (
        rows.withColumn("bucket_idx", frequency.bucket_index(F.col("ts"), view))
        .groupBy("kind", "bucket_idx")
        .agg(F.count("*").alias("events"))
    )
    return frequency.sparse_counts(counted, "kind", view)


def kind_scores(spark: SparkSession, sf_dir: str, sensitivity: float = 0.6) -> DataFrame:
    return anomaly.score(frequency.growth(kind_series(spark, sf_dir)), sensitivity)


def _placed(spark: SparkSession, ordered: DataFrame) -> DataFrame:
    """Adds the place of every row of an ordered result, which a comparison of sets needs."""
    return number_written(Workspace(spark), ordered, "place")


# --- sources and sinks ------------------------------------------------------------------------


@query
def s01_table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.document_lines(spark, sf_dir)


@query
def s02_mixed_format_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_lines(adapters.mixed_lines(spark, sf_dir)).drop("raw")


@query
def s03_drop_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.drop_blank(adapters.document_lines(spark, sf_dir)).select("line_no", "raw")


@query
def s04_valid_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines with a byte that is no UTF-8 before, after or on both sides of them."""
    bad, raw, style = F.lit(bytearray(b"\xff")), F.encode("raw", "UTF-8"), F.col("line_no") % 3
    broken = (
        F.when(style == 0, F.concat(bad, raw))
        .when(style == 1, F.concat(raw, bad))
        .otherwise(F.concat(bad, raw, bad))
    )
    lines = adapters.document_lines(spark, sf_dir)
    return lines.select("line_no", F.make_valid_utf8(broken.cast("string")).alias("raw"))


@query
def s05_numbered_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written to text files in order and read back."""
    folder = f"{Workspace(spark).root}/files"
    lines = adapters.text_lines(spark, sf_dir)
    lines.orderBy("line_no").select("raw").write.text(folder)
    return read_text(spark, folder).select("line_no", "raw")


@query
def s06_run_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = RunStore.create(spark, f"{Workspace(spark).root}/runs")
    run_id = runs.save(analysis(spark, sf_dir), "sink", "2024-02-03 00:00:00")
    run = runs.load(run_id)
    stored = [
        table.agg(
            F.lit(name).alias("stored"),
            F.count("*").alias("rows"),
            F.coalesce(F.sum(number).cast("double"), F.lit(0.0)).alias("total"),
        )
        for name, table, number in (
            ("runs", run.run, "event_count"),
            ("clusters", run.clusters, "count"),
            ("clusters by bucket", filled_rows(run.clusters), "events"),
            ("incidents", run.incidents, "confidence"),
            ("correlations", run.correlations, "lag_seconds"),
        )
    ]
    return reduce(DataFrame.unionByName, stored)


@query
def s07_run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).load(1).clusters.select("cluster_id", "template", "count", "level")


@query
def s08_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_run(store(spark, sf_dir).table("runs")).select("run_id", "event_count")


@query
def s09_previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_history(store(spark, sf_dir).table("runs")).select(
        "run_id", "event_count", "previous_id", "previous_event_count"
    )


@query
def s10_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, explorer.export_rows(latest(spark, sf_dir)))


@query
def s11_empty_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored run of a log all of whose lines are blank, with the dashboard's figures."""
    lines = adapters.text_lines(spark, sf_dir).withColumn("raw", F.lit("  "))
    runs = RunStore.create(spark, f"{Workspace(spark).root}/runs")
    runs.save(analyze(Workspace(spark), lines, BASE_TIME), "empty", "2024-02-01 00:00:00")
    run = runs.load()
    row = run.run.select(
        "run_id", "event_count", "parsed_count", "unparsed_count", "cluster_count", "incident_count",
        "window_start", "window_end", "bucket_seconds",
    )
    figures = dashboard.kpis(run).agg(F.count("*").alias("figures"), F.sum("raw").alias("total"))
    return row.join(figures, F.lit(True)).join(dashboard.health(run), F.lit(True))


@query
def s12_stored_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_rows(latest(spark, sf_dir).clusters, "cluster_id")


@query
def s13_stored_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations saved one half after the other, the second half once more."""
    runs = RunStore.create(spark, f"{Workspace(spark).root}/runs")
    run_id = runs.save(analysis(spark, sf_dir), "explained", "2024-02-03 00:00:00")
    run = runs.load(run_id)
    told = explain.explain(explain.explain_input(run))
    half = F.pmod(F.xxhash64("incident_id"), F.lit(2)) == 0
    runs.save_explanations(run_id, told.filter(half))
    runs.save_explanations(run_id, told.filter(~half).withColumn("root_cause", F.lit("to be replaced")))
    runs.save_explanations(run_id, told.filter(~half))
    told = runs.load().explanations.select("incident_id", "source", "root_cause")
    return run.incidents.select("incident_id", "title").join(told, "incident_id", "left")


# --- parsing -------------------------------------------------------------------------------------


@query
def p01_json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole objects, objects with a tail, arrays, two objects in a row."""
    raw, style = F.col("raw"), F.col("line_no") % 4
    styled = (
        F.when(style == 0, raw)
        .when(style == 1, F.concat(raw, F.lit(" tail")))
        .when(style == 2, F.concat(F.lit("["), raw, F.lit("]")))
        .otherwise(F.concat(raw, F.lit(","), raw))
    )
    return adapters.json_lines(spark, sf_dir).select(
        "line_no", jsonline.strict_object(styled).isNotNull().alias("is_object")
    )


@query
def p02_alias_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields under second and later names, with null and empty values before them."""
    rows = adapters.log_rows(spark, sf_dir)
    raw = F.to_json(
        F.struct(
            F.lit("").alias("timestamp"),
            F.date_format("ts", adapters.ISO).alias("@timestamp"),
            F.lower("level").alias("severity"),
            F.lit("").alias("service"),
            F.col("service").alias("component"),
            F.lit(None).cast("string").alias("message"),
            F.col("message").alias("body"),
        ),
        {"ignoreNullFields": "false"},
    )
    parsed = parse.parse_lines(rows.select("line_no", raw.alias("raw")))
    return parsed.select("line_no", "ts", "level", "service", "message")


@query
def p03_folded_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects without a message field."""
    raw = F.concat(
        F.lit('{"z":'), "user_id", F.lit(',"level":"info","kind":"'), "event_type",
        F.lit('","ok":true,"gone":null,"half":'), "user_id", F.lit('.50,"app":"a"}'),
    )
    lines = adapters.events(spark, sf_dir).select(
        (F.col("event_id") + 1).alias("line_no"), raw.alias("raw")
    )
    return parse.parse_lines(lines).select("line_no", "level", "service", "message")


@query
def p04_timestamp_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds and milliseconds, ISO with Z, with an offset, with a comma, a date, an
    impossible time, basic forms with and without Z, a basic time behind an extended date, a
    week date and an offset with seconds."""
    ts, style = F.col("ts"), F.col("event_id") % 12
    seconds = F.floor(F.unix_micros(ts) / 1_000_000)
    millis = F.floor(F.unix_micros(ts) / 1_000)

    week = F.format_string(
        "%04d-W%02d-%d",
        F.extract(F.lit("YEAROFWEEK"), ts),
        F.extract(F.lit("WEEK"), ts),
        F.extract(F.lit("DAYOFWEEK_ISO"), ts),
    )

    def quoted(column: Column) -> Column:
        return F.concat(F.lit('"'), column, F.lit('"'))

    value = (
        F.when(style == 0, seconds.cast("string"))
        .when(style == 1, millis.cast("string"))
        .when(style == 2, quoted(F.date_format(ts, adapters.ISO)))
        .when(style == 3, quoted(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")))
        .when(style == 4, quoted(F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS")))
        .when(style == 5, quoted(F.date_format(ts, "yyyy-MM-dd")))
        .when(style == 6, quoted(F.date_format(ts, "yyyy-13-dd'T'HH:mm:ss")))
        .when(style == 7, quoted(F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")))
        .when(style == 8, quoted(F.date_format(ts, "yyyyMMdd'T'HHmmss.SSSSSS")))
        .when(style == 9, quoted(F.date_format(ts, "yyyy-MM-dd'T'HHmm")))
        .when(style == 10, quoted(week))
        .otherwise(quoted(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+05:30:15'")))
    )
    raw = F.concat(F.lit('{"ts":'), value, F.lit(',"msg":"m"}'))
    lines = adapters.events(spark, sf_dir).select(
        (F.col("event_id") + 1).alias("line_no"), raw.alias("raw")
    )
    return parse.parse_lines(lines).select("line_no", "ts")


@query
def p05_level_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All level names in small letters, and words that are none."""
    words = [name.lower() for name in fixed.LEVEL_RANK] + ["note", "", "severe"]
    word = F.element_at(
        F.array(*[F.lit(w) for w in words]), (F.col("event_id") % len(words) + 1).cast("int")
    )
    return adapters.events(spark, sf_dir).select(
        "event_id", jsonline.known_level(F.upper(word)).alias("level")
    )


@query
def p06_leading_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = parse.split_timestamp(adapters.styled_lines(spark, sf_dir))
    return split.select("line_no", "text_ts", "rest")


@query
def p07_level_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = parse.split_level(parse.split_timestamp(adapters.styled_lines(spark, sf_dir)))
    return split.select("line_no", "text_level", "rest")


@query
def p08_service_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse.parse_text(adapters.styled_lines(spark, sf_dir))
    return parsed.select("line_no", "text_service", "rest")


@query
def p09_text_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse.parse_text(adapters.styled_lines(spark, sf_dir))
    return parsed.select("line_no", "text_message")


@query
def p10_synthetic_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse.parse_lines(adapters.timeless_lines(spark, sf_dir))
    parsed = Workspace(spark).table(parsed.select("line_no", "ts", "level"), "parsed")
    return parse.synthetic_clock(parsed, BASE_TIME)


@query
def p11_parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_counts(parse.parse_lines(adapters.styled_lines(spark, sf_dir)))


@query
def p12_parse_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_lines(adapters.text_lines(spark, sf_dir)).drop("raw")


@query
def p13_parse_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_lines(adapters.json_lines(spark, sf_dir)).drop("raw")


# --- masks -----------------------------------------------------------------------------------------


def _masked_by(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = adapters.maskable_lines(spark, sf_dir)
    return lines.select("line_key", masks.mask(F.col("raw"), name).alias("masked"))


for _number, (_name, _, _) in enumerate(fixed.MASKS, 1):
    _query = partial(_masked_by, _name)
    _query.__name__ = f"n{_number:02d}_mask_{_name}"
    _query.__doc__ = f"The {_name} mask on every line."
    query(_query)


@query
def n14_collapse_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = adapters.maskable_lines(spark, sf_dir)
    return lines.select("line_key", regex.collapse_spaces(F.col("raw")).alias("masked"))


@query
def n15_masked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = adapters.maskable_lines(spark, sf_dir).withColumn(
        "tokens", masks.tokens(masks.normalize(F.col("raw")))
    )
    return lines.select(
        "line_key", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens")
    )


# --- template mining ---------------------------------------------------------------------------------


def _maskable_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parse.drop_blank(adapters.maskable_lines(spark, sf_dir))
    return mining.distinct_sequences(
        lines.withColumn("masked", masks.normalize(F.col("raw")))
    )


@query
def t01_routing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A sequence has at least one token, so the outer form gives the same rows; the filter that
    # the plain one infers would be evaluated, masks and all, on every line of the scan.
    tokens = _maskable_sequences(spark, sf_dir).select(F.explode_outer("tokens").alias("token"))
    return tokens.distinct().select("token", mining.routing_key(F.col("token")).alias("key"))


@query
def t02_leaf_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    # the texts have done their work
    sequences = _maskable_sequences(spark, sf_dir).drop("sequence")
    return mining.route(workspace, sequences).select("first_line", "events", "leaf")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document line with the line before it, if both have as many words."""
    words = F.split(regex.collapse_spaces(F.col("raw")), " ")
    before = W.partitionBy("doc_id").orderBy("line_no")
    return (
        adapters.document_lines(spark, sf_dir)
        .withColumn("words", words)
        .withColumn("previous", F.lag("words").over(before))
        .filter(F.size("previous") == F.size("words"))
    )


@query
def t03_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select(
        "line_no", mining.similarity(F.col("previous"), F.col("words")).alias("similarity")
    )


@query
def t04_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = mining.merge(F.col("previous"), F.col("words"))
    return _neighbours(spark, sf_dir).select("line_no", mining.pattern(merged).alias("template"))


@query
def t05_mine_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of the log lines, mined afresh."""
    workspace = Workspace(spark)
    rows = adapters.log_rows(spark, sf_dir)
    sequences = mining.distinct_sequences(
        rows.withColumn("masked", masks.normalize(F.col("message")))
    )
    routed = mining.routed_table(workspace, sequences)
    versions = mining.mine(workspace, routed)
    return templates.number_templates(mining.latest(versions)).select(
        "cluster_id", "created", mining.pattern(F.col("tokens")).alias("template")
    )


def _document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All document lines with their masked text."""
    lines = parse.drop_blank(adapters.document_lines(spark, sf_dir))
    return lines.withColumn("masked", masks.normalize(F.col("raw")))


@query
def t05_mine_document_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of all document lines, with real merging."""
    workspace = Workspace(spark)
    sequences = mining.distinct_sequences(_document_events(spark, sf_dir))
    routed = mining.routed_table(workspace, sequences)
    versions = mining.mine(workspace, routed)
    return templates.number_templates(mining.latest(versions)).select(
        "cluster_id", "created", mining.pattern(F.col("tokens")).alias("template")
    )


@query
def t05_mine_maskable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of the document lines whose masks SQL can express, with real merging."""
    workspace = Workspace(spark)
    routed = mining.routed_table(workspace, _maskable_sequences(spark, sf_dir))
    versions = mining.mine(workspace, routed)
    return templates.number_templates(mining.latest(versions)).select(
        "cluster_id", "created", mining.pattern(F.col("tokens")).alias("template")
    )


@query
def t06_assign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = analysis(spark, sf_dir)
    ids = done.clusters.select("created", "cluster_id")
    return done.event_clusters().join(ids, "created").select("line_no", "cluster_id")


@query
def t06_assign_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document line with the template it belongs to at its line, where templates
    widen and take over texts of others."""
    workspace = Workspace(spark)
    events = workspace.table(_document_events(spark, sf_dir).select("line_no", "masked"), "events")
    routed = mining.routed_table(workspace, mining.distinct_sequences(events))
    versions = mining.mine(workspace, routed)
    sequences = mining.by_digest(routed)
    steps = workspace.table(mining.sequence_steps(sequences, versions), "steps")
    return mining.assign_events(events, sequences, steps).select("line_no", "created")


@query
def t07_template_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = mining.distinct_sequences(
        kinds(spark, sf_dir).withColumnRenamed("kind", "masked")
    ).select("sequence", F.col("first_line").alias("created"))
    return templates.number_templates(sequences).select("cluster_id", "sequence")


def _type_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the five event types, whose lines come from several services."""
    return templates.event_facts(
        adapters.log_rows(spark, sf_dir), ["event_type", "level", "service"]
    )


@query
def t08a_template_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.totals(_type_facts(spark, sf_dir), "event_type").drop("level")


@query
def t08a_service_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = templates.services(_type_facts(spark, sf_dir), "event_type")
    return counted.select("event_type", F.explode("services").alias("service", "events"))


@query
def t08b_worst_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.totals(_type_facts(spark, sf_dir), "event_type").select("event_type", "level")


@query
def t08c_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).clusters.select(
        "cluster_id", "example", F.array_join("examples", "\n").alias("examples")
    )


@query
def t09_by_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = templates.by_volume(analysis(spark, sf_dir).clusters).select("cluster_id", "count")
    return _placed(spark, ordered)


@query
def t10_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).clusters.select(
        "cluster_id", mining.pattern(F.col("tokens")).alias("template"), "token_count"
    )


# --- clusters and frequency ----------------------------------------------------------------------------


@query
def c01_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.to_clusters(analysis(spark, sf_dir).clusters).select(
        "cluster_id", "template", "token_count", "level", "count", "example", "first_seen", "last_seen"
    )


@query
def c02_primary_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = templates.services(_type_facts(spark, sf_dir), "event_type")
    return counted.select("event_type", "primary_service")


@query
def f01_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window(adapters.log_rows(spark, sf_dir))


@query
def f02_bucket_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket width for the span of every user's activity per hour, day and overall."""
    rows = adapters.events(spark, sf_dir)
    spans = []
    for unit in ("hour", "day", "month"):
        span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000
        spans.append(
            rows.groupBy("user_id", F.date_trunc(unit, "ts").alias("period"))
            .agg(span.alias("span"))
            .select(F.lit(unit).alias("unit"), "user_id", "period", "span")
        )
    every = spans[0].union(spans[1]).union(spans[2])
    return every.withColumn("bucket_seconds", frequency.bucket_seconds(F.col("span")))


@query
def f03_bucket_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.log_rows(spark, sf_dir)
    view = frequency.Window.of(_window(rows))
    return rows.select("line_no", frequency.bucket_index(F.col("ts"), view).alias("bucket_idx"))


@query
def f04_dense_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = frequency.Window.of(_window(adapters.log_rows(spark, sf_dir)))
    return frequency.bucket_rows(kind_series(spark, sf_dir), "kind", view)


@query
def f05_recent_and_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = frequency.growth(kind_series(spark, sf_dir))
    return grown.select("kind", "recent_count", "baseline_rate")


@query
def f06_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.growth(kind_series(spark, sf_dir)).select("kind", "growth_pct")


@query
def f07_error_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error and warning events per bucket, straight from the log rows."""
    rows = adapters.log_rows(spark, sf_dir)
    view = frequency.Window.of(_window(rows))
    placed = rows.withColumn("bucket_idx", frequency.bucket_index(F.col("ts"), view))
    return placed.groupBy("bucket_idx").agg(
        F.count_if(F.col("level").isin(*fixed.ERROR_LEVELS)).alias("errors"),
        F.count_if(F.col("level").isin(*fixed.WARNING_LEVELS)).alias("warnings"),
    )


# --- anomaly ---------------------------------------------------------------------------------------------


@query
def a01_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and flags of every series at several sensitivities."""
    series = kind_series(spark, sf_dir)
    parts = [
        anomaly.score(series, s).select(
            F.lit(s).alias("sensitivity"), "kind", "effective_threshold", "anomaly_score", "is_anomaly"
        )
        for s in SENSITIVITIES
    ]
    every = parts[0]
    for one in parts[1:]:
        every = every.unionByName(one)
    return every


def _scores(columns: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    return kind_scores(spark, sf_dir).select("kind", *columns)


for _name, _columns in {
    "a02_median": ("center",),
    "a03_robust_scale": ("scale",),
    "a04_scan_correction": ("effective_threshold",),
    "a05_peak_bucket": ("peak_idx", "peak_count"),
    "a06_zscore": ("zscore",),
    "a07_anomaly_score": ("anomaly_score",),
    "a08_peak_is_recent": ("peak_is_recent",),
    "a09_is_anomaly": ("is_anomaly",),
}.items():
    _query = partial(_scores, _columns)
    _query.__name__ = _name
    _query.__doc__ = f"{', '.join(_columns)} of every series."
    query(_query)


# --- severity and confidence -----------------------------------------------------------------------------------


def _rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity computed from the stored signals of the latest run."""
    signals = latest(spark, sf_dir).clusters.drop(
        "severity", "severity_score", "severity_factors", "confidence"
    )
    return severity.score(signals)


def _factor(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescored(spark, sf_dir).select("cluster_id", F.col(f"severity_factors.{name}").alias(name))


for _number, _name in enumerate(("level", "criticality", "volume", "growth", "breadth"), 1):
    _query = partial(_factor, _name)
    _query.__name__ = f"v{_number:02d}_{_name}_factor"
    _query.__doc__ = f"The {_name} factor of every cluster."
    query(_query)


@query
def v06_severity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescored(spark, sf_dir).select("cluster_id", "severity_score")


@query
def v07_severity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescored(spark, sf_dir).select("cluster_id", "severity")


@query
def v08_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescored(spark, sf_dir).select("cluster_id", "confidence")


@query
def v09_factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity.factor_rows(latest(spark, sf_dir).clusters)


# --- incidents and correlation ----------------------------------------------------------------------------------


@query
def i01_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).clusters.filter(incidents.is_incident()).select("cluster_id")


@query
def i02_ranked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = incidents.form(Workspace(spark), analysis(spark, sf_dir).clusters)
    return ranked.select("incident_id", "rank", "cluster_id")


@query
def i03_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).clusters.select(
        "cluster_id", incidents.title(F.col("example"), F.col("template")).alias("title")
    )


@query
def i04_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).clusters.select("cluster_id", incidents.status().alias("status"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.correlate(
        latest(spark, sf_dir).incidents, correlation.dependency_table(spark)
    )


@query
def j01_dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = correlation.dependency_edges(
        latest(spark, sf_dir).incidents, correlation.dependency_table(spark)
    )
    return edges.select("upstream_id", "downstream_id", "lag_seconds")


@query
def j02_temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).filter(F.col("kind") == "temporal")
    return edges.select("upstream_id", "downstream_id", "lag_seconds")


@query
def j03_correlated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latest(spark, sf_dir).incidents.drop("correlated_ids")
    linked = correlation.with_correlated_ids(found, _edges(spark, sf_dir))
    return linked.select("incident_id", F.array_join("correlated_ids", ",").alias("correlated_ids"))


@query
def j04_edge_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("upstream_id", "downstream_id", "kind", "detail")


# --- dashboard ------------------------------------------------------------------------------------------------------


def _model(model, spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(latest(spark, sf_dir))


for _name, _model_function in {
    "k01_kpis": dashboard.kpis,
    "k04_timeline": dashboard.timeline,
    "k06_health_score": dashboard.health,
    "k07_top_clusters": dashboard.top_clusters,
    "k08_funnel": dashboard.funnel,
    "k09_insights": dashboard.insights,
    "k10_severity_distribution": dashboard.severity_distribution,
    "k11_trends": dashboard.trends,
    "k12_cluster_frequency": dashboard.cluster_frequency,
    "k13_run_summary": dashboard.run_summary,
    "k15_severity_shares": dashboard.severity_shares,
    "k16_status_counts": dashboard.service_status_counts,
    "k17_peak_buckets": dashboard.peak_buckets,
    "k18_report": dashboard.report,
}.items():
    _query = partial(_model, _model_function)
    _query.__name__ = _name
    _query.__doc__ = _model_function.__doc__
    query(_query)


@query
def k05_service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, dashboard.service_health(latest(spark, sf_dir)))


@query
def k02_event_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = latest(spark, sf_dir)
    return run.run.select("run_id", dashboard.event_delta(run.previous).alias("delta_pct"))


@query
def k03_mean_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = latest(spark, sf_dir)
    return run.run.select("run_id", dashboard.mean_duration(run.incidents).alias("seconds"))


@query
def k14_whole_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What everything on the two pages shows: rows, the sum of all whole numbers but places
    and ids, and the letters of all texts."""
    run = latest(spark, sf_dir)
    pages = {"dashboard": dashboard.dashboard(run), "analytics": dashboard.analytics(run)}

    def added(table: DataFrame, kind: str, value) -> Column:
        columns = [c for c, t in table.dtypes if t == kind and c != "run_id"]
        every = reduce(Column.__add__, [F.coalesce(value(F.col(c)), F.lit(0)) for c in columns], F.lit(0))
        return F.coalesce(F.sum(every), F.lit(0)).cast("bigint")

    shown = [
        table.agg(
            F.lit(page).alias("page"),
            F.lit(name).alias("widget"),
            F.count("*").alias("rows"),
            added(table, "bigint", lambda c: c).alias("numbers"),
            added(table, "string", F.length).alias("letters"),
        )
        for page, widgets in pages.items()
        for name, table in widgets.items()
    ]
    return reduce(DataFrame.unionByName, shown)


@query
def k19_count_and_duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as counts, line quantities as durations."""
    orders = adapters.read(spark, sf_dir, "orders")
    amount = F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 20))
    return orders.select(
        "o_orderkey",
        display.count_text(amount).alias("count_text"),
        display.duration_text(amount / 7).alias("duration_text"),
    )


@query
def k20_growth_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = latest(spark, sf_dir).clusters
    return clusters.select(
        "cluster_id", display.growth_text(F.col("growth_pct"), F.col("baseline_rate")).alias("text")
    )


# --- explorer and detail ----------------------------------------------------------------------------------------------


@query
def l01_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explorer.list_incidents(latest(spark, sf_dir), severity="hIGH", status="ALL")
    return found.select("incident_id", "severity", "status")


@query
def l02_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.list_incidents(latest(spark, sf_dir), needle="API").select("incident_id", "title")


@query
def l03_severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explorer.list_incidents(latest(spark, sf_dir))
    return _placed(spark, found.select("incident_id", "severity", "confidence"))


@query
def l04_baseline_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.with_baseline(latest(spark, sf_dir)).select("incident_id", "baseline_rate")


@query
def l05_other_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents by every sort key."""
    run = latest(spark, sf_dir)
    parts = [
        _placed(spark, explorer.list_incidents(run, sort=key).select(F.lit(key).alias("sort"), "incident_id"))
        for key in ("severity", "confidence", "recent", "volume")
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query
def l06_joined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.search_joined(latest(spark, sf_dir), "  API clu ").select("incident_id")


@query
def l07_incident_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested detail of the top incident, flattened for comparison."""
    run = latest(spark, sf_dir)
    top = run.incidents.orderBy("rank").limit(1).select("incident_id").first()
    detail = explorer.incident_detail(run, top[0] if top else "")
    return detail.select(
        "incident_id",
        F.col("incident.title").alias("title"),
        F.col("incident.baseline_rate").alias("baseline_rate"),
        F.col("cluster.normalized_example").alias("normalized_example"),
        F.size("cluster.buckets").alias("n_buckets"),
        F.array_join("cluster.factors.factor", ",").alias("factors"),
        F.coalesce(F.array_join("correlations.other_id", ","), F.lit("")).alias("linked"),
        F.coalesce(F.array_join("related.incident_id", ","), F.lit("")).alias("related"),
    )


@query
def l07_incident_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.incident_buckets(latest(spark, sf_dir))


@query
def l08_normalized_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.normalized_example(latest(spark, sf_dir).clusters).select(
        "cluster_id", "normalized_example"
    )


@query
def l09_cause_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.chain(latest(spark, sf_dir)).select(
        "incident_id", "other_id", "direction", "kind", "lag_seconds"
    )


@query
def l10_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.related(latest(spark, sf_dir)).select(
        "of_incident", "incident_id", "severity", "baseline_rate"
    )


@query
def l11_cluster_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explorer.service_rows(latest(spark, sf_dir))
    return _placed(spark, found.select("cluster_id", "service", "events"))


@query
def l12_factor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.factor_bars(latest(spark, sf_dir)).select("cluster_id", "factor", "width")


# --- explanations -------------------------------------------------------------------------------------------------------


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.explain_input(latest(spark, sf_dir))


@query
def m01_root_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.root_cause(_inputs(spark, sf_dir)).select("incident_id", "cause")


@query
def m02_suggested_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.root_cause(_inputs(spark, sf_dir)).select(
        "incident_id", F.array_join("suggested_fixes", " | ").alias("suggested_fixes")
    )


@query
def m03_growth_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = explain.growth_phrase(F.col("growth_pct"), F.col("baseline_rate"))
    return _inputs(spark, sf_dir).select("incident_id", phrase.alias("phrase"))


@query
def m04_linked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir).select(
        "incident_id",
        F.array_join("upstream", ",").alias("upstream"),
        F.array_join("downstream", ",").alias("downstream"),
    )


@query
def m05_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = explain.explain(_inputs(spark, sf_dir))
    return told.select(
        "incident_id", "summary", "root_cause",
        F.array_join("suggested_fixes", " | ").alias("suggested_fixes"),
    )


@query
def m06_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.prompt(_inputs(spark, sf_dir))


@query
def m07_outside_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of three kinds: complete, with one fix as text, without a needed field."""
    inputs = _inputs(spark, sf_dir)
    fixes = F.when(F.col("rank") % 3 == 0, F.lit('["a","b","c","d","e","f"]')).otherwise('"one"')
    response = F.when(
        F.col("rank") % 3 == 1, F.lit('{"summary":"s","root_cause":"r"}')
    ).otherwise(
        F.concat(
            F.lit('{"summary":"outside '), "incident_id", F.lit('","root_cause":5,"suggested_fixes":'),
            fixes, F.lit("}"),
        )
    )
    responses = inputs.select("incident_id", response.alias("response"))
    merged = explain.merge_responses(explain.explain(inputs), responses)
    return merged.select(
        "incident_id", "source", "root_cause",
        F.array_join("suggested_fixes", " | ").alias("suggested_fixes"),
    )


# --- end to end ----------------------------------------------------------------------------------------------------------


@query
def e01_analyze_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text lines to ranked incidents, computed afresh."""
    done = analyze(Workspace(spark), adapters.text_lines(spark, sf_dir), BASE_TIME)
    return done.incidents.select(
        "incident_id", "cluster_id", "title", "service", "severity", "status", "confidence",
        "anomaly_score", "growth_pct", "count", "first_seen", "last_seen",
    )


@query
def e02_analyze_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDJSON lines to ranked incidents, computed afresh."""
    done = analyze(Workspace(spark), adapters.json_lines(spark, sf_dir), BASE_TIME)
    return done.incidents.select("incident_id", "cluster_id", "severity", "status", "count")


@query
def e03_analyze_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All document lines, which have neither time nor level, to clusters, afresh."""
    done = analyze(Workspace(spark), adapters.document_lines(spark, sf_dir), BASE_TIME)
    return done.clusters.select("cluster_id", "template", "count", "severity", "is_anomaly")

"""Driver tables as log lines.

``events`` rows become log lines of seven services. On a few service days each event also
causes a burst of lines with a message of its own, so that spikes, cascades and resolved
incidents occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import ROWS_PER_TASK, spread, table_lines

SERVICES = (
    "payments-api",
    "checkout-gateway",
    "auth-service",
    "orders-api",
    "webhooks",
    "media-worker",
    "analytics-api",
)

# (service, event type, day of month, copies, second of day, level, words)
BURSTS = (
    ("payments-api", "error", 28, 40, 43200, "ERROR", "connection pool exhausted acquiring connection"),
    ("checkout-gateway", "error", 28, 30, 43260, "ERROR", "request failed upstream returned 503"),
    ("auth-service", "signup", 28, 25, 43140, "WARN", "token refresh exceeded slo"),
    ("media-worker", "click", 28, 35, 43300, "FATAL", "heap usage near limit"),
    ("orders-api", "error", 12, 30, 36000, "ERROR", "duplicate delivery detected on replay"),
    ("analytics-api", "signup", 9, 30, 30000, "WARN", "rollup query scanned whole table"),
    ("webhooks", "view", 27, 40, 50000, "INFO", "cache miss ratio degraded"),
)

# Each event owns this many line numbers, for itself and its burst.
LINES_PER_EVENT = 64

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the service they belong to."""
    names = F.array(*[F.lit(name) for name in SERVICES])
    return (
        spread(spark.read.parquet(f"{sf_dir}/events.parquet"), ROWS_PER_TASK)
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("service", F.element_at(names, (F.col("user_id") % 7 + 1).cast("int")))
    )


def _burst_line(midnight: Column, second: int, level: str, words: str):
    def line(copy: Column) -> Column:
        after = second + copy * 20 + F.col("event_id") % 20
        user = F.col("user_id")
        return F.struct(
            copy.alias("copy"),
            F.lit(level).alias("level"),
            (midnight + after * 1_000_000).alias("us"),
            _text(words, " user=", user, " after ", user % 900, "ms").alias("message"),
        )

    return line


def log_rows(spark: SparkSession, sf_dir: str, bursts: bool = True) -> DataFrame:
    """``(line_no, ts, level, service, event_type, message)``. One pass over the events:
    an event in a burst becomes several rows."""
    event_type, user = F.col("event_type"), F.col("user_id")
    own = F.struct(
        F.lit(0).alias("copy"),
        F.when(event_type == "error", "ERROR")
        .when(event_type == "signup", "WARN")
        .otherwise("INFO")
        .alias("level"),
        F.unix_micros("ts").alias("us"),
        _text(
            F.col("service"), " ", event_type, " user=", user, " cents=",
            F.round(F.col("value") * 100).cast("bigint"), " after ", user % 900, "ms",
        ).alias("message"),
    )
    lines = F.array(own)
    if bursts:
        midnight = F.unix_micros(F.date_trunc("day", "ts"))
        day = F.dayofmonth("ts")
        for service, kind, on, copies, second, level, words in BURSTS:
            hit = (F.col("service") == service) & (event_type == kind) & (day == on)
            extra = F.transform(
                F.sequence(F.lit(1), F.lit(copies)), _burst_line(midnight, second, level, words)
            )
            lines = F.when(hit, F.concat(F.array(own), extra)).otherwise(lines)
    return (
        events(spark, sf_dir)
        .select("event_id", "service", "event_type", F.explode(lines).alias("line"))
        .select(
            (F.col("event_id") * LINES_PER_EVENT + F.col("line.copy") + 1).alias("line_no"),
            F.timestamp_micros("line.us").alias("ts"),
            "line.level",
            "service",
            "event_type",
            "line.message",
        )
    )


def text_line() -> Column:
    return F.concat_ws(" ", F.date_format("ts", ISO), "level", "service", "message")


def json_line() -> Column:
    return F.to_json(
        F.struct(F.date_format("ts", ISO).alias("timestamp"), "level", "service", "message")
    )


def text_lines(spark: SparkSession, sf_dir: str, bursts: bool = True) -> DataFrame:
    """The rows as text log lines ``(line_no, raw)``."""
    return log_rows(spark, sf_dir, bursts).select("line_no", text_line().alias("raw"))


def json_lines(spark: SparkSession, sf_dir: str, bursts: bool = True) -> DataFrame:
    """The rows as NDJSON ``(line_no, raw)``."""
    return log_rows(spark, sf_dir, bursts).select("line_no", json_line().alias("raw"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and NDJSON lines in turn."""
    raw = F.when(F.col("line_no") % 2 == 0, json_line()).otherwise(text_line())
    return log_rows(spark, sf_dir).select("line_no", raw.alias("raw"))


def timeless_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of which every tenth line number has no time."""
    bare = F.concat_ws(" ", "level", "service", "message")
    raw = F.when(F.col("line_no") % 10 == 0, bare).otherwise(text_line())
    return log_rows(spark, sf_dir).select("line_no", raw.alias("raw"))


def styled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event in six styles: plain; bracketed level and dash; comma fraction,
    level in small letters in parentheses and colon; message only; unknown level word;
    impossible date."""
    style = F.col("line_no") / LINES_PER_EVENT
    style = F.floor(style) % 6
    level, service, message = F.col("level"), F.col("service"), F.col("message")
    iso = F.date_format("ts", ISO)
    spaced = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    raw = (
        F.when(style == 0, text_line())
        .when(style == 1, _text(iso, " [", level, "] ", service, " - ", message))
        .when(style == 2, _text(spaced, " (", F.lower(level), ") ", service, ": ", message))
        .when(style == 3, message)
        .when(style == 4, _text(iso, " NOTE ", message))
        .otherwise(_text("2024-02-30T10:00:00 ", level, " ", message))
    )
    return log_rows(spark, sf_dir, bursts=False).select("line_no", raw.alias("raw"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents ``(doc_id, line_no, raw)``."""
    return table_lines(read(spark, sf_dir, "documents"), "text", "doc_id")


def maskable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line_key, line_no, raw)``: a line per event that holds something for every mask,
    followed by all lines of all documents."""
    digest = F.md5(F.col("event_id").cast("string"))
    user, event = F.col("user_id"), F.col("event_id")
    uuid = F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4),
        F.substring(digest, 17, 4), F.substring(digest, 21, 12),
    )
    raw = _text(
        F.col("event_type"), " id ", uuid, " at ", F.date_format("ts", ISO), "  by u", user,
        ".x+y@mail", event % 9, ".example.com from https://h", event % 7, ".example.org/p?q=", user,
        " ip 10.", user % 256, ".0.", event % 256, ":80", event % 10, " took ", user, "ms or ",
        event % 60, ".5 s size ", user, "MB ", event % 9, ".25 GiB ptr 0x", F.substring(digest, 1, 9),
        " run ", F.substring(digest, 1, 16), " file /var/log/u", user, "/e.log said \"code ", event,
        "\" or 'n ", user, "' at ", event % 100, "% and ", event % 100, ".5% n=", event, " delta -",
        user, ".75 +", event % 10, " ord_", event, " x", user, " v", user, ".2 <", user, ">",
    )
    own = events(spark, sf_dir).select(
        _text("event ", event).alias("line_key"), (event + 1).alias("line_no"), raw.alias("raw")
    )
    first = read(spark, sf_dir, "events").agg(F.max("event_id") + 1).scalar()
    documents = document_lines(spark, sf_dir).select(
        _text("document line ", F.col("line_no")).alias("line_key"),
        (F.col("line_no") + first).alias("line_no"),
        "raw",
    )
    return own.unionByName(documents)

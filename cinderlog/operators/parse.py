"""Raw lines to events.

Input: a line table ``(line_no BIGINT, raw STRING, ...)`` from ``sources.lines``.
Output adds ``ts, level, service, message``; no line that is not blank is dropped.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import jsonline, timestamps
from ..functions.regex import WHITESPACE, java, strip, strip_left
from .numbering import prefix_sum

_TS = java(fixed.TS_PREFIX)
_LEVEL = java(fixed.LEVEL_PREFIX)
_SERVICE = java(fixed.SERVICE_PREFIX)


def drop_blank(lines: DataFrame) -> DataFrame:
    """Blank lines go, but they have already used up a line number."""
    return lines.filter(strip(F.col("raw")) != "")


def _after(rest: Column, prefix: Column) -> Column:
    return F.substring(rest, F.length(prefix) + 1, F.length(rest))


def split_timestamp(lines: DataFrame) -> DataFrame:
    """Leading timestamp of ``raw``: adds ``text_ts`` and ``rest``. A prefix of the right
    shape is consumed even if its date is impossible."""
    return (
        lines.withColumn("prefix", F.regexp_extract("raw", _TS, 0))
        .withColumn(
            "text_ts",
            F.when(F.col("prefix") != "", timestamps.leading(strip(F.col("prefix")))),
        )
        .withColumn("rest", _after(F.col("raw"), F.col("prefix")))
        .drop("prefix")
    )


def split_level(lines: DataFrame) -> DataFrame:
    """Level word at the start of ``rest``: adds ``text_level``; an unknown word stays."""
    return (
        lines.withColumn("prefix", F.regexp_extract("rest", _LEVEL, 0))
        .withColumn(
            "text_level",
            jsonline.known_level(F.upper(F.btrim(F.col("prefix"), F.lit(WHITESPACE + "[]()")))),
        )
        .withColumn(
            "rest",
            F.when(
                F.col("text_level") != fixed.UNKNOWN_LEVEL, _after(F.col("rest"), F.col("prefix"))
            ).otherwise(F.col("rest")),
        )
        .drop("prefix")
    )


def split_service(lines: DataFrame) -> DataFrame:
    """Service word at the start of ``rest``: adds ``text_service``. Only after a known
    level, and only a word with ``. - /`` or without capitals."""
    word = F.col("word")
    accepted = (
        (F.col("text_level") != fixed.UNKNOWN_LEVEL)
        & (word != "")
        & (word.rlike(r"[.\-/]") | ~word.rlike(r"[\p{IsUppercase}\p{Lt}]"))
    )
    return (
        lines.withColumn("prefix", F.regexp_extract("rest", _SERVICE, 0))
        .withColumn("word", F.regexp_extract("rest", _SERVICE, 1))
        .withColumn("text_service", F.when(accepted, word))
        .withColumn(
            "rest",
            F.when(
                F.col("text_service").isNotNull(), _after(F.col("rest"), F.col("prefix"))
            ).otherwise(F.col("rest")),
        )
        .drop("prefix", "word")
    )


def text_message(lines: DataFrame) -> DataFrame:
    """What is left of the line, or the whole line if nothing is left."""
    rest = strip(F.col("rest"))
    return lines.withColumn(
        "text_message", F.when(rest != "", rest).otherwise(strip(F.col("raw")))
    )


def parse_text(lines: DataFrame) -> DataFrame:
    return text_message(split_service(split_level(split_timestamp(lines))))


def parse_json(lines: DataFrame) -> DataFrame:
    """JSON fields of lines that are one JSON object: adds ``json`` (null elsewhere) and
    ``json_ts, json_level, json_service, json_message``."""
    body = strip_left(F.col("raw"))
    obj = F.col("json")
    named = jsonline.first_filled(obj, fixed.JSON_MESSAGE_KEYS)
    service = jsonline.first_filled(obj, fixed.JSON_SERVICE_KEYS)
    return (
        lines.withColumn("json", F.when(F.startswith(body, F.lit("{")), jsonline.strict_object(body)))
        .withColumn("json_ts_value", jsonline.first_filled(obj, fixed.JSON_TS_KEYS))
        .withColumn("json_level_value", jsonline.first_filled(obj, fixed.JSON_LEVEL_KEYS))
        .withColumn("json_service_value", service)
        .withColumn("json_message_value", named)
        .withColumn("json_ts", jsonline.timestamp_of(F.col("json_ts_value")))
        .withColumn("json_level", jsonline.level_of(F.col("json_level_value")))
        .withColumn("json_service", jsonline.text_of(F.col("json_service_value")))
        .withColumn(
            "json_message",
            strip(
                F.when(
                    F.col("json_message_value").isNotNull(),
                    jsonline.text_of(F.col("json_message_value")),
                ).when(obj.isNotNull(), jsonline.folded_message(body, obj))
            ),
        )
        .drop(
            "json_ts_value", "json_level_value", "json_service_value", "json_message_value"
        )
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Each line as JSON if it is one object, else as text. ``ts`` is null where the line
    has no usable time; ``synthetic_clock`` fills it."""
    parsed = parse_json(parse_text(drop_blank(lines)))
    is_json = F.col("json").isNotNull()

    def pick(name: str) -> Column:
        return F.when(is_json, F.col(f"json_{name}")).otherwise(F.col(f"text_{name}"))

    fields = [pick(name).alias(name) for name in ("ts", "level", "service", "message")]
    return parsed.select(*lines.columns, *fields)


def synthetic_clock(events: DataFrame, base_time: datetime | str) -> DataFrame:
    """The k-th event without a time gets ``base_time`` + k seconds, in line order.

    Events with a time pass through untouched; only the others are shuffled, in blocks
    of the line number.
    """
    timeless = prefix_sum(events.filter(F.col("ts").isNull()), "line_no", F.lit(1), "k")
    base = F.lit(base_time).cast("timestamp")
    filled = timeless.withColumn(
        "ts", F.timestamp_micros(F.unix_micros(base) + F.col("k") * 1_000_000)
    ).drop("k")
    return events.filter(F.col("ts").isNotNull()).unionByName(filled)


def parse_counts(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("event_count"),
        F.count_if(F.col("level") != fixed.UNKNOWN_LEVEL).alias("parsed_count"),
        F.count_if(F.col("level") == fixed.UNKNOWN_LEVEL).alias("unparsed_count"),
    )

"""Per-template aggregates, template ids and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from .numbering import join_narrow, number_rows
from .severity import level_rank


def event_facts(events: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Events counted by ``keys`` (which include ``level`` and ``service``). Everything a
    template needs except its sample lines follows from this much smaller table."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("events"),
        F.min("line_no").alias("first_line"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *more,
    )


def totals(facts: DataFrame, key: str) -> DataFrame:
    """Count, first and last moment, and the most severe level, which starts as UNKNOWN
    and is replaced by strictly more severe ones only; the first to arrive wins a tie."""
    rank = level_rank(F.col("level"))
    worst = F.min_by("level", F.struct(-rank, F.col("first_line")))
    return facts.groupBy(key).agg(
        F.sum("events").alias("count"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
        F.when(F.max(rank) > 1, worst).otherwise(fixed.UNKNOWN_LEVEL).alias("level"),
    )


def services(facts: DataFrame, key: str) -> DataFrame:
    """``services`` (name to events, first seen first) and ``primary_service`` (most
    events; the first seen wins a tie)."""
    named = (
        facts.filter(F.col("service").isNotNull() & (F.col("service") != ""))
        .groupBy(key, "service")
        .agg(F.sum("events").alias("events"), F.min("first_line").alias("first_line"))
    )
    in_order = F.array_sort(F.collect_list(F.struct("first_line", "service", "events")))
    return named.groupBy(key).agg(
        F.map_from_entries(
            F.transform(in_order, lambda s: F.struct(s["service"], s["events"]))
        ).alias("services"),
        primary_service("service", "events", "first_line").alias("primary_service"),
    )


def primary_service(service: str, events: str, first_line: str) -> Column:
    return F.max_by(service, F.struct(F.col(events), -F.col(first_line)))


def first_lines(events: DataFrame, key: str, limit: int = fixed.MAX_EXAMPLES) -> DataFrame:
    """``(key, line_no, place)`` of the first lines per key. The group limit works before
    the shuffle, so a key with most of the events still ships only ``limit`` rows per
    task."""
    place = W.partitionBy(key).orderBy("line_no")
    return (
        events.select(key, "line_no")
        .withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= limit)
    )


def template_id(number: Column) -> Column:
    """``CLU-007``; numbers past 999 keep all their digits."""
    padded = F.lpad(number.cast("string"), 3, "0")
    return F.concat(F.lit("CLU-"), F.when(number < 1000, padded).otherwise(number.cast("string")))


def number_templates(templates: DataFrame, created: str = "created") -> DataFrame:
    """Adds ``cluster_id``, counted in the order of creation. Only the creating lines are
    numbered; the wide rows stay where they are or are joined by a unique key."""
    numbered = number_rows(templates.select(created), created, "_number")
    ids = numbered.select(created, template_id(F.col("_number")).alias("cluster_id"))
    return join_narrow(templates, ids, created)


def by_volume(templates: DataFrame) -> DataFrame:
    """Most frequent first, the older one first on ties."""
    return templates.orderBy(F.desc("count"), "created")


def to_clusters(templates: DataFrame) -> DataFrame:
    """Templates that have events."""
    return templates.filter(F.col("count") > 0)

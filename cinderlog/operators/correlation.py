"""Cause links between incidents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from .intervals import interval_join

_MICROS = 1_000_000


def dependency_table(
    spark: SparkSession, dependencies: Mapping[str, Sequence[str]] = fixed.DEPENDENCIES
) -> DataFrame:
    """``(downstream_service, upstream_service)``."""
    rows = [(down, up) for down, ups in dependencies.items() for up in ups]
    return spark.createDataFrame(rows, "downstream_service string, upstream_service string")


def _side(incidents: DataFrame, prefix: str) -> DataFrame:
    return incidents.select(
        F.col("incident_id").alias(f"{prefix}_id"),
        F.col("rank").alias(f"{prefix}_rank"),
        F.col("service").alias(f"{prefix}_service"),
        F.unix_micros("first_seen").alias(f"{prefix}_us"),
    )


def whole_seconds(seconds: Column) -> Column:
    """Seconds without decimals, halves to even."""
    return F.bround(seconds, 0).cast("bigint").cast("string")


def dependency_edges(incidents: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Edges from an incident to those of dependent services that started within the
    allowed lag of it.

    """
    lead, lag = fixed.LEAD_TOLERANCE_SECONDS, fixed.MAX_LAG_SECONDS
    needs = dependencies.withColumnRenamed("upstream_service", "needed_service")
    down = _side(incidents, "downstream").join(needs, "downstream_service")
    up = _side(incidents, "upstream")
    pairs = interval_join(
        down, up, ("downstream_us", "upstream_us"), -lag * _MICROS, lead * _MICROS,
        on=("needed_service", "upstream_service"),
    )
    lag_seconds = (F.col("downstream_us") - F.col("upstream_us")) / _MICROS
    shown = F.greatest(F.col("lag_seconds"), F.lit(0.0))
    return (
        pairs.filter(F.col("upstream_id") != F.col("downstream_id"))
        .withColumn("lag_seconds", lag_seconds)
        .select(
            "upstream_id",
            "downstream_id",
            F.lit("dependency").alias("kind"),
            F.concat(
                "downstream_service", F.lit(" depends on "), "upstream_service", F.lit("; "),
                "downstream_id", F.lit(" ignited ~"), whole_seconds(shown), F.lit("s after "),
                "upstream_id",
            ).alias("detail"),
            "lag_seconds",
            F.lit(0).alias("stage"),
            F.col("downstream_rank").alias("order_a"),
            F.col("upstream_rank").alias("order_b"),
        )
    )


def temporal_edges(incidents: DataFrame, linked: DataFrame) -> DataFrame:
    """Edges between severe incidents of different services that started together and are
    not linked by a dependency already.

    Rows of one service are never paired with each other, however many there are.
    """
    width = fixed.TEMPORAL_WINDOW_SECONDS * _MICROS
    severe = incidents.filter(F.col("severity").isin("Critical", "High"))
    pairs = (
        interval_join(
            _side(severe, "a"), _side(severe, "b"), ("a_us", "b_us"), -width, width,
            apart=("a_service", "b_service"),
        )
        .filter(F.col("a_rank") < F.col("b_rank"))
        .select("a_id", "a_rank", "a_us", "b_id", "b_rank", "b_us")
    )
    forth = linked.select(F.col("upstream_id").alias("a_id"), F.col("downstream_id").alias("b_id"))
    back = linked.select(F.col("downstream_id").alias("a_id"), F.col("upstream_id").alias("b_id"))
    fresh = pairs.join(forth.unionByName(back), ["a_id", "b_id"], "left_anti")
    a_first = F.col("a_us") <= F.col("b_us")
    return (
        fresh.withColumn("upstream_id", F.when(a_first, F.col("a_id")).otherwise(F.col("b_id")))
        .withColumn("downstream_id", F.when(a_first, F.col("b_id")).otherwise(F.col("a_id")))
        .withColumn("lag_seconds", F.abs(F.col("a_us") - F.col("b_us")) / _MICROS)
        .select(
            "upstream_id",
            "downstream_id",
            F.lit("temporal").alias("kind"),
            F.concat(
                "upstream_id", F.lit(" and "), "downstream_id", F.lit(" spiked within "),
                whole_seconds(F.col("lag_seconds")), F.lit("s across services"),
            ).alias("detail"),
            "lag_seconds",
            F.lit(1).alias("stage"),
            F.col("a_rank").alias("order_a"),
            F.col("b_rank").alias("order_b"),
        )
    )


EDGE_ORDER = ("stage", "order_a", "order_b")


def correlate(incidents: DataFrame, dependencies: DataFrame) -> DataFrame:
    """All edges. ``stage, order_a, order_b`` give the order in which they are found."""
    by_dependency = dependency_edges(incidents, dependencies)
    return by_dependency.unionByName(temporal_edges(incidents, by_dependency))


def links(correlations: DataFrame) -> DataFrame:
    """``(incident_id, other_id, stage, order_a, order_b)``: both directions, each pair
    once, at its first edge."""
    order = F.struct(*EDGE_ORDER)

    def direction(one: str, other: str) -> DataFrame:
        return correlations.select(
            F.col(one).alias("incident_id"), F.col(other).alias("other_id"), order.alias("found")
        )

    both = direction("upstream_id", "downstream_id").unionByName(
        direction("downstream_id", "upstream_id")
    )
    return (
        both.groupBy("incident_id", "other_id")
        .agg(F.min("found").alias("found"))
        .select("incident_id", "other_id", "found.*")
    )


def with_correlated_ids(incidents: DataFrame, correlations: DataFrame) -> DataFrame:
    """Adds ``correlated_ids`` in the order the links were found."""
    found = F.array_sort(F.collect_list(F.struct(*EDGE_ORDER, "other_id")))
    ids = (
        links(correlations)
        .groupBy("incident_id")
        .agg(F.transform(found, lambda link: link["other_id"]).alias("correlated_ids"))
    )
    return incidents.join(ids, "incident_id", "left").withColumn(
        "correlated_ids", F.coalesce("correlated_ids", F.array().cast("array<string>"))
    )

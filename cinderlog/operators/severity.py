"""Severity as a weighted blend of six factors, and confidence."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def lookup(key: Column, table: Mapping[str, float | int], default: float | int) -> Column:
    """Value of a small fixed table."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def level_rank(level: Column) -> Column:
    return lookup(level, fixed.LEVEL_RANK, 1)


def severity_rank(severity: Column) -> Column:
    return lookup(severity, fixed.SEVERITY_RANK, 0)


def level_factor(level: Column) -> Column:
    return level_rank(level) / 4.0


def criticality(
    service: Column, table: Mapping[str, float] = fixed.SERVICE_CRITICALITY
) -> Column:
    return lookup(service, table, fixed.DEFAULT_CRITICALITY)


def _clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def volume_factor(count: Column, largest: Column) -> Column:
    return F.log10(count + 1.0) / (F.log10(largest + 1.0) + fixed.EPSILON)


def growth_factor(growth_pct: Column) -> Column:
    return _clamp(growth_pct / 300.0)


def breadth_factor(n_services: Column) -> Column:
    return _clamp((n_services - 1) / 3.0)


def blend(factors: Column) -> Column:
    """Weighted sum, added in the order of the weights."""
    total = F.lit(0.0)
    for name, weight in fixed.SEVERITY_WEIGHTS.items():
        total = total + F.lit(weight) * factors[name]
    return total


def label(severity_score: Column) -> Column:
    named = F.lit(fixed.LOWEST_SEVERITY)
    for name, cut in reversed(fixed.SEVERITY_CUTS):
        named = F.when(severity_score >= cut, name).otherwise(named)
    return named


def confidence(count: Column, anomaly_score: Column, level: Column) -> Column:
    sample = F.least(F.log10(count + 1.0) / math.log10(500), F.lit(1.0))
    evidence = 0.45 * sample + 0.35 * anomaly_score + 0.20 * level
    return F.least(F.lit(0.99), F.greatest(F.lit(0.5), 0.60 + 0.38 * evidence))


def score(
    clusters: DataFrame,
    largest_count: Column | None = None,
    table: Mapping[str, float] = fixed.SERVICE_CRITICALITY,
) -> DataFrame:
    """Adds ``severity_factors, severity_score, severity, confidence``. The volume factor
    compares with the largest cluster, a scalar subquery unless given; ``table`` holds the
    criticality of services."""
    if largest_count is None:
        largest_count = clusters.agg(F.max("count")).scalar()
    factors = F.struct(
        F.col("anomaly_score").alias("anomaly"),
        level_factor(F.col("level")).alias("level"),
        criticality(F.col("primary_service"), table).alias("criticality"),
        volume_factor(F.col("count"), largest_count).alias("volume"),
        growth_factor(F.col("growth_pct")).alias("growth"),
        breadth_factor(F.size("services")).alias("breadth"),
    )
    return (
        clusters.withColumn("severity_factors", factors)
        .withColumn("severity_score", blend(F.col("severity_factors")))
        .withColumn("severity", label(F.col("severity_score")))
        .withColumn(
            "confidence",
            confidence(F.col("count"), F.col("anomaly_score"), F.col("severity_factors.level")),
        )
    )


def factor_rows(clusters: DataFrame) -> DataFrame:
    """One row per cluster and factor: value, weight, contribution and its place, the
    largest contribution first."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("weight_order"),
                F.lit(name).alias("factor"),
                F.col(f"severity_factors.{name}").alias("value"),
                F.lit(weight).alias("weight"),
                (F.col(f"severity_factors.{name}") * weight).alias("contribution"),
            )
            for i, (name, weight) in enumerate(fixed.SEVERITY_WEIGHTS.items())
        ]
    )
    by_contribution = F.array_sort(
        rows,
        lambda a, b: F.when(a["contribution"] > b["contribution"], -1)
        .when(a["contribution"] < b["contribution"], 1)
        .otherwise(a["weight_order"] - b["weight_order"]),
    )
    return clusters.select(
        "cluster_id", F.posexplode(by_contribution).alias("place", "row")
    ).select("cluster_id", (F.col("place") + 1).alias("place"), "row.*").drop("weight_order")

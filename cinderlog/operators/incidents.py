"""Promotion of clusters to incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.regex import WHITESPACE_RUN, strip, strip_right
from ..session import Workspace
from .numbering import number_sorted
from .severity import level_rank


def is_incident() -> Column:
    """An anomaly at any level, or at least WARN with a score of Medium or more."""
    error_ish = level_rank(F.col("level")) >= fixed.INCIDENT_MIN_LEVEL_RANK
    return F.col("is_anomaly") | (
        error_ish & (F.col("severity_score") >= fixed.INCIDENT_MIN_SCORE)
    )


def rank_order() -> list[Column]:
    """Most severe first; ties in cluster order (volume, then age)."""
    return [
        F.desc("severity_score"),
        F.desc("anomaly_score"),
        F.desc("count"),
        F.asc("created"),
    ]


def title(example: Column, template: Column) -> Column:
    """First words of the example that are not mask signs, as one clause."""
    source = F.when(F.coalesce(example, F.lit("")) != "", example).otherwise(template)
    words = F.filter(
        F.split(strip(source), WHITESPACE_RUN),
        lambda w: (w != "") & ~F.lower(w).isin(*fixed.TITLE_STOP_WORDS),
    )
    clause = strip(
        F.btrim(F.array_join(F.slice(words, 1, fixed.TITLE_WORDS), " "), F.lit(" :-"))
    )
    chosen = F.when(clause != "", clause).otherwise(template)
    return strip_right(F.left(chosen, F.lit(fixed.TITLE_CHARS)))


def status() -> Column:
    severity = F.col("severity")
    return (
        F.when((F.col("recent_count") == 0) | ~F.col("peak_is_recent"), "Resolved")
        .when(severity == "Critical", "Active")
        .when(severity == "High", "Investigating")
        .otherwise("Monitoring")
    )


def incident_id(rank: Column, total: Column) -> Column:
    """The top incident gets the largest number."""
    number = F.lit(fixed.INCIDENT_BASE) + total - (rank - 1)
    return F.concat(F.lit("INC-"), number.cast("string"))


def form(workspace: Workspace, clusters: DataFrame) -> DataFrame:
    """Ranked incidents. ``rank`` keeps the order the list had."""
    promoted = (
        clusters.filter(is_incident())
        .withColumn("title", title(F.col("example"), F.col("template")))
        .withColumn("status", status())
    )
    ranked = number_sorted(workspace, promoted, rank_order(), "rank")
    total = ranked.agg(F.count("*")).scalar()
    return ranked.select(
        incident_id(F.col("rank"), total).alias("incident_id"),
        "rank",
        "cluster_id",
        "title",
        F.col("primary_service").alias("service"),
        "severity",
        "confidence",
        "status",
        "anomaly_score",
        "growth_pct",
        "count",
        "first_seen",
        "last_seen",
    )

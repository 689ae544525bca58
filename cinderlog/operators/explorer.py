"""Incident list, export and detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.display import decimals
from ..functions.masks import normalize
from ..functions.regex import WHITESPACE
from ..sources.runs import Run, bucket_list, bucket_rows
from .correlation import EDGE_ORDER
from .search import SEARCHED, joined_text, may_hold
from .severity import factor_rows, severity_rank

INCIDENT_COLUMNS = (
    "incident_id", "cluster_id", "title", "service", "severity", "confidence", "status",
    "anomaly_score", "growth_pct", "baseline_rate", "count", "first_seen", "last_seen",
    "correlated_ids",
)


def with_baseline(run: Run, incidents: DataFrame | None = None) -> DataFrame:
    """Incidents with the baseline rate of their cluster, 0 without a cluster."""
    rates = run.clusters.select("cluster_id", "baseline_rate")
    found = run.incidents if incidents is None else incidents
    return found.join(rates, "cluster_id", "left").withColumn(
        "baseline_rate", F.coalesce("baseline_rate", F.lit(0.0))
    )


def has_label(column: str, wanted: str | None) -> Column:
    """Label filter without regard to case; nothing or ``all`` lets everything through."""
    if not wanted or wanted.lower() == "all":
        return F.lit(True)
    return F.lower(column) == wanted.lower()


def matches(needle: str | None) -> Column:
    """Needle in the title, the service, the incident id or the cluster id."""
    if not needle:
        return F.lit(True)
    wanted = F.lit(needle.lower())
    found = F.lit(False)
    for column in SEARCHED:
        found = found | F.contains(F.lower(F.coalesce(column, F.lit(""))), wanted)
    return found


def matches_joined(needle: str | None) -> Column:
    """Trimmed needle in the four fields joined with blanks, so it may span two of them."""
    wanted = (needle or "").strip(WHITESPACE).lower()
    return F.contains(F.lower(joined_text()), F.lit(wanted))


def search_joined(run: Run, needle: str | None) -> DataFrame:
    """Incidents with the trimmed needle in their joined fields."""
    wanted = (needle or "").strip(WHITESPACE).lower()
    return with_baseline(run, may_hold(run.incidents, run.grams, wanted)).filter(matches_joined(needle))


def severity_order() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.desc("confidence"), F.asc("rank")]


def sort_order(key: str = "severity") -> list[Column]:
    """Sort keys of the list; ties keep the severity order."""
    first = {"confidence": "confidence", "recent": "last_seen", "volume": "count"}.get(key)
    return ([F.desc(first)] if first else []) + severity_order()


def list_incidents(
    run: Run,
    severity: str | None = None,
    status: str | None = None,
    needle: str | None = None,
    sort: str = "severity",
) -> DataFrame:
    found = may_hold(run.incidents, run.grams, (needle or "").lower())
    return (
        with_baseline(run, found)
        .filter(has_label("severity", severity) & has_label("status", status) & matches(needle))
        .orderBy(*sort_order(sort))
        .select(*INCIDENT_COLUMNS)
    )


def iso_text(ts: Column) -> Column:
    """ISO time; the fraction only where there is one, then with six digits."""
    has_fraction = F.unix_micros(ts) % 1_000_000 != 0
    return F.when(has_fraction, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    )


def export_rows(run: Run) -> DataFrame:
    """The export's columns, formatted, in its order."""
    return run.incidents.orderBy(*severity_order()).select(
        "incident_id",
        "severity",
        "title",
        F.coalesce("service", F.lit("")).alias("service"),
        "cluster_id",
        decimals(F.col("confidence"), 2).alias("confidence"),
        "status",
        decimals(F.col("anomaly_score"), 2).alias("anomaly_score"),
        decimals(F.col("growth_pct"), 0).alias("growth_pct"),
        "count",
        iso_text(F.col("first_seen")).alias("first_seen"),
        iso_text(F.col("last_seen")).alias("last_seen"),
    )


def export_csv(run: Run, path: str) -> None:
    export_rows(run).write.option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def chain(run: Run) -> DataFrame:
    """Every edge from the view of both its incidents: ``incident_id, other_id`` and
    whether the other one is upstream or downstream."""
    columns = ["kind", "detail", "lag_seconds", *EDGE_ORDER]

    def seen_from(one: str, other: str, direction: str) -> DataFrame:
        return run.correlations.select(
            F.col(one).alias("incident_id"),
            F.col(other).alias("other_id"),
            F.lit(direction).alias("direction"),
            *columns,
        )

    return seen_from("downstream_id", "upstream_id", "upstream").unionByName(
        seen_from("upstream_id", "downstream_id", "downstream")
    )


def related(run: Run) -> DataFrame:
    """Linked incidents of every incident, with their baseline rate."""
    pairs = run.incidents.select(
        F.col("incident_id").alias("of_incident"),
        F.posexplode("correlated_ids").alias("place", "incident_id"),
    )
    return pairs.join(with_baseline(run).select(*INCIDENT_COLUMNS), "incident_id")


def service_rows(run: Run) -> DataFrame:
    """Services of every cluster; by events, then first seen."""
    return run.clusters.select(
        "cluster_id",
        F.posexplode(F.map_entries("services")).alias("seen", "entry"),
    ).select(
        "cluster_id", F.col("entry.key").alias("service"), F.col("entry.value").alias("events"), "seen"
    ).orderBy("cluster_id", F.desc("events"), "seen")


def normalized_example(clusters: DataFrame) -> DataFrame:
    """Adds the masked example for display, the template where there is none."""
    return clusters.withColumn(
        "normalized_example",
        F.when(F.coalesce("example", F.lit("")) != "", normalize(F.col("example"))).otherwise(
            F.col("template")
        ),
    )


def factor_bars(run: Run) -> DataFrame:
    """Severity factors of every cluster with the width of their bar."""
    rows = factor_rows(run.clusters)
    widest = run.clusters.select(
        "cluster_id",
        F.array_max(
            F.array(
                *[
                    F.col(f"severity_factors.{name}") * weight
                    for name, weight in fixed.SEVERITY_WEIGHTS.items()
                ]
            )
        ).alias("widest"),
    )
    return rows.join(widest, "cluster_id").select(
        *rows.columns,
        (F.col("contribution") / F.greatest("widest", F.lit(0.001))).alias("width"),
    )


def incident_detail(run: Run, incident_id: str) -> DataFrame:
    """One nested row for an incident; none if it or its cluster is missing."""
    wanted = with_baseline(run).filter(F.col("incident_id") == incident_id)
    factors = (
        factor_rows(run.clusters.join(wanted.select("cluster_id"), "cluster_id", "left_semi"))
        .groupBy("cluster_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("place", "factor", "value", "weight", "contribution"))
            ).alias("factors")
        )
    )
    clusters = (
        normalized_example(bucket_list(run.clusters.join(wanted.select("cluster_id"), "cluster_id", "left_semi")))
        .join(factors, "cluster_id")
        .select(
            "cluster_id",
            F.struct(
                "cluster_id", "template", "normalized_example", "level", "count", "token_count",
                "services", F.col("examples").alias("example_logs"), "buckets", "anomaly_score",
                "zscore", "is_anomaly", "growth_pct", "baseline_rate", "recent_count", "severity",
                "severity_score", "confidence", "factors",
            ).alias("cluster"),
        )
    )
    edges = (
        chain(run)
        .filter(F.col("incident_id") == incident_id)
        .groupBy("incident_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(*EDGE_ORDER, "direction", "other_id", "kind", "detail", "lag_seconds")
                )
            ).alias("correlations")
        )
    )
    others = (
        related(run)
        .filter(F.col("of_incident") == incident_id)
        .groupBy("of_incident")
        .agg(
            F.array_sort(F.collect_list(F.struct("place", *INCIDENT_COLUMNS))).alias("related")
        )
        .withColumnRenamed("of_incident", "incident_id")
    )
    told = run.explanations.select(
        "incident_id",
        F.struct("source", "summary", "root_cause", "suggested_fixes").alias("explanation"),
    )
    return (
        wanted.select("incident_id", "cluster_id", F.struct(*INCIDENT_COLUMNS).alias("incident"))
        .join(clusters, "cluster_id")
        .join(edges, "incident_id", "left")
        .join(others, "incident_id", "left")
        .join(told, "incident_id", "left")
        .drop("cluster_id")
    )


def incident_buckets(run: Run) -> DataFrame:
    """Bucket rows of the clusters behind incidents."""
    ids = run.incidents.select("cluster_id", "incident_id")
    return bucket_rows(run.clusters.join(ids, "cluster_id"), "incident_id", "cluster_id")

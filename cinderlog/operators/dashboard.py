"""Read models over one stored run.

Single values of other tables enter as scalar subqueries, so no table is cross joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..functions.display import count_text, duration_text, half_up, plural
from ..sources.runs import Run, bucket_rows, run_buckets
from .correlation import EDGE_ORDER
from .severity import severity_rank

NO_DATA = "No data yet — upload logs to begin."


def is_active() -> Column:
    return F.col("status").isin(*fixed.ACTIVE_STATUSES)


def mean_duration(incidents: DataFrame) -> Column:
    """Mean seconds from first to last seen: of resolved incidents, else of all, else 0."""
    seconds = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1_000_000
    resolved = F.avg(F.when(F.col("status") == "Resolved", seconds))
    return incidents.agg(F.coalesce(resolved, F.avg(seconds), F.lit(0.0))).scalar()


def event_delta(previous: DataFrame) -> Column:
    """Change of ``event_count`` against the previous run in percent; null without one."""
    before = previous.select(F.nullif("event_count", F.lit(0).cast("bigint"))).scalar()
    return (F.col("event_count") - before) / before * 100.0


def kpis(run: Run) -> DataFrame:
    totals = run.incidents.agg(
        F.struct(
            F.count_if(is_active()).alias("active"),
            F.count_if(F.col("severity") == "Critical").alias("critical"),
            F.countDistinct(F.when(is_active(), F.col("service"))).alias("services"),
        )
    ).scalar()
    anomalies = run.clusters.agg(F.count_if(F.col("is_anomaly"))).scalar()
    base = (
        run.run.withColumn("totals", totals)
        .withColumn("anomalies", anomalies)
        .withColumn("mttr", mean_duration(run.incidents))
        .withColumn("delta", event_delta(run.previous))
    )

    def row(key: str, label: str, value: Column, raw: Column, hint: Column, delta=None) -> Column:
        return F.struct(
            F.lit(key).alias("key"),
            F.lit(label).alias("label"),
            value.alias("value"),
            raw.cast("double").alias("raw"),
            (F.lit(None).cast("double") if delta is None else delta).alias("delta_pct"),
            hint.alias("hint"),
        )

    active, critical = F.col("totals.active"), F.col("totals.critical")
    events, anomalous = F.col("event_count"), F.col("anomalies")
    across = F.concat(F.lit("across "), F.col("totals.services").cast("string"), F.lit(" services"))
    rows = F.array(
        row("events", "Total log events", count_text(events), events,
            F.lit("analyzed this run"), F.col("delta")),
        row("active", "Active incidents", active.cast("string"), active, across),
        row("critical", "Critical incidents", critical.cast("string"), critical,
            F.lit("need attention")),
        row("anomalies", "Anomaly clusters", anomalous.cast("string"), anomalous,
            F.lit("detected")),
        row("mttr", "Mean incident duration", duration_text(F.col("mttr")), F.col("mttr"),
            F.lit("first → last seen")),
    )
    return base.select(F.posexplode(rows).alias("place", "row")).select("place", "row.*")


def timeline(run: Run) -> DataFrame:
    """Events of incident clusters per bucket, one column per severity, from the states
    stored with the run. Empty buckets follow from the window."""
    behind = run.states.filter(F.col("severity").isNotNull())
    counted = behind.groupBy("bucket_idx").pivot("severity", list(fixed.SEVERITIES)).sum("events")
    return (
        run_buckets(behind)
        .join(counted, "bucket_idx", "left")
        .na.fill(0, list(fixed.SEVERITIES))
        .select("bucket_ts", *fixed.SEVERITIES)
        .orderBy("bucket_ts")
    )


def service_health(run: Run) -> DataFrame:
    """Every service with its worst active severity and its active incidents."""
    services = (
        run.clusters.select(F.col("primary_service").alias("service"))
        .union(run.incidents.select("service"))
        .filter(F.col("service").isNotNull())
        .distinct()
    )
    grade = (
        F.when(F.col("severity") == "Critical", 2)
        .when(F.col("severity").isin("High", "Medium"), 1)
        .otherwise(0)
    )
    active = (
        run.incidents.filter(is_active())
        .groupBy("service")
        .agg(F.max(grade).alias("grade"), F.count("*").alias("incidents"))
    )
    worst = F.coalesce("grade", F.lit(0))
    return (
        services.join(active, "service", "left")
        .orderBy(worst.desc(), "service")
        .select(
            "service",
            F.when(worst == 2, "Critical").when(worst == 1, "Degraded").otherwise("Healthy").alias("status"),
            F.coalesce("incidents", F.lit(0)).cast("bigint").alias("incidents"),
        )
    )


def health(run: Run) -> DataFrame:
    """One row: score and summary sentence."""
    critical, degraded = F.col("critical"), F.col("degraded")
    penalty = critical * fixed.CRITICAL_PENALTY + degraded * fixed.DEGRADED_PENALTY
    runs = run.run.agg(F.count("*")).scalar()
    sentence = (
        F.when(runs == 0, NO_DATA)
        .when(
            critical > 0,
            F.concat(F.lit("Degraded — "), critical.cast("string"), F.lit(" critical service"), plural(critical)),
        )
        .when(
            degraded > 0,
            F.concat(F.lit("Degraded — "), degraded.cast("string"), F.lit(" service"), plural(degraded), F.lit(" at risk")),
        )
        .otherwise("All systems operational")
    )
    return (
        service_health(run)
        .agg(
            F.count_if(F.col("status") == "Critical").alias("critical"),
            F.count_if(F.col("status") == "Degraded").alias("degraded"),
        )
        .select(
            F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).cast("bigint").alias("health_score"),
            sentence.alias("health_summary"),
        )
    )


def service_status_counts(run: Run) -> DataFrame:
    """Number of services per status, all three present."""
    counts = service_health(run).groupBy("status").agg(F.count("*").alias("services"))
    return _labels(run, "status", ("Critical", "Degraded", "Healthy"), counts, "services")


def _labels(run: Run, name: str, labels: tuple[str, ...], counts: DataFrame, value: str) -> DataFrame:
    dimension = run.run.sparkSession.createDataFrame(
        list(enumerate(labels)), f"place int, {name} string"
    )
    return (
        dimension.join(counts, name, "left")
        .withColumn(value, F.coalesce(value, F.lit(0)).cast("bigint"))
        .orderBy("place")
        .select("place", name, value)
    )


def top_clusters(run: Run, limit: int = fixed.TOP_CLUSTERS) -> DataFrame:
    """Strongest anomalies first; growth, volume and age break ties."""
    titles = run.incidents.select("cluster_id", "incident_id", "title")
    own = F.left("example", F.lit(60))
    own = F.when(own != "", own).otherwise(F.left("template", F.lit(60)))
    return (
        run.clusters.orderBy(F.desc("anomaly_score"), F.desc("growth_pct"), F.desc("count"), "created")
        .limit(limit)
        .join(titles, "cluster_id", "left")
        .orderBy(F.desc("anomaly_score"), F.desc("growth_pct"), F.desc("count"), "created")
        .select(
            "cluster_id",
            "incident_id",
            F.coalesce("title", own).alias("title"),
            F.col("primary_service").alias("service"),
            "severity",
            "count",
            "growth_pct",
            "baseline_rate",
        )
    )


def funnel(run: Run) -> DataFrame:
    """One row: how the events narrowed down to incidents."""
    clusters = run.clusters.agg(
        F.struct(F.count("*").alias("clusters"), F.count_if(F.col("is_anomaly")).alias("anomalies"))
    ).scalar()
    return run.run.withColumn("found", clusters).select(
        F.col("event_count").alias("events"),
        F.col("parsed_count").alias("parsed"),
        F.col("unparsed_count").alias("unparsed"),
        "found.clusters",
        "found.anomalies",
        run.incidents.agg(F.count("*")).scalar().alias("incidents"),
        run.correlations.agg(F.count("*")).scalar().alias("correlations"),
    )


def insights(run: Run, limit: int = fixed.MAX_INSIGHTS) -> DataFrame:
    """Cascades, one per downstream incident with its most severe cause, then the
    strongest active anomaly."""

    def side(prefix: str) -> DataFrame:
        return run.incidents.select(
            F.col("incident_id").alias(f"{prefix}_id"),
            F.col("service").alias(f"{prefix}_service"),
            F.col("severity").alias(f"{prefix}_severity"),
        )

    strongest = [F.desc("cause_rank"), *EDGE_ORDER]
    cascades = (
        run.correlations.filter(F.col("kind") == "dependency")
        .join(side("upstream"), "upstream_id")
        .join(side("downstream"), "downstream_id")
        .withColumn("cause_rank", severity_rank(F.col("upstream_severity")))
        .withColumn("nth", F.row_number().over(W.partitionBy("downstream_id").orderBy(*strongest)))
        .filter(F.col("nth") == 1)
        .orderBy(*strongest)
        .limit(limit)
        .select(
            F.struct(F.lit(0).alias("group"), -F.col("cause_rank"), *EDGE_ORDER).alias("at"),
            F.lit("Correlation").alias("kind"),
            F.lit("Cascading failure detected").alias("title"),
            F.concat(
                "downstream_id", F.lit(" ("), "downstream_service", F.lit(") is downstream of "),
                "upstream_id", F.lit(" ("), "upstream_service", F.lit("). "), "detail",
            ).alias("detail"),
            F.col("upstream_id").alias("incident_id"),
        )
    )
    none = F.lit(0)
    spike = (
        run.incidents.filter(is_active() & (F.col("anomaly_score") >= fixed.INSIGHT_MIN_ANOMALY))
        .orderBy(F.desc("anomaly_score"), "rank")
        .limit(1)
        .select(
            F.struct(
                F.lit(1).alias("group"), none, none, none.cast("bigint"), none.cast("bigint")
            ).alias("at"),
            F.lit("Anomaly").alias("kind"),
            F.lit("Volume spike detected").alias("title"),
            F.concat(
                "incident_id", F.lit(" on "), F.coalesce("service", F.lit("None")),
                F.lit(" is spiking ("), F.col("count").cast("string"), F.lit(" events, "),
                F.lower("severity"), F.lit(" severity)."),
            ).alias("detail"),
            "incident_id",
        )
    )
    # At most limit + 1 rows reach this window.
    return (
        cascades.union(spike)
        .withColumn("place", F.row_number().over(W.orderBy("at")))
        .filter(F.col("place") <= limit)
        .select("place", "kind", "title", "detail", "incident_id")
    )


def severity_distribution(run: Run) -> DataFrame:
    counts = run.incidents.groupBy("severity").agg(F.count("*").alias("incidents"))
    return _labels(run, "severity", fixed.SEVERITIES, counts, "incidents")


def severity_shares(run: Run) -> DataFrame:
    """Distribution with rounded percentages."""
    total = F.greatest(run.incidents.agg(F.count("*")).scalar(), F.lit(1))
    return severity_distribution(run).withColumn(
        "percent", half_up(F.col("incidents") / total * 100)
    )


def trends(run: Run) -> DataFrame:
    """Events of error and of warning clusters per bucket, from the states stored with the run."""
    level, n = F.col("level"), F.col("events")
    counted = (
        run.states.groupBy("bucket_idx")
        .agg(
            F.sum(F.when(level.isin(*fixed.ERROR_LEVELS), n).otherwise(0)).alias("errors"),
            F.sum(F.when(level.isin(*fixed.WARNING_LEVELS), n).otherwise(0)).alias("warnings"),
        )
    )
    return (
        run_buckets(run.states)
        .join(counted, "bucket_idx", "left")
        .na.fill(0, ["errors", "warnings"])
        .select("bucket_ts", "errors", "warnings")
        .orderBy("bucket_ts")
    )


def cluster_frequency(run: Run, limit: int = fixed.FREQUENCY_BARS) -> DataFrame:
    return run.clusters.orderBy(F.desc("count"), "created").limit(limit).select("cluster_id", "count")


def run_summary(run: Run) -> DataFrame:
    return run.run.select(
        "run_id", "source_name", "event_count", "parsed_count", "unparsed_count",
        "cluster_count", "incident_count", "window_start", "window_end", "created_at",
    )


def peak_buckets(run: Run) -> DataFrame:
    """Buckets of every cluster; those that reach the cluster's maximum are marked."""
    highest = F.coalesce(F.array_max(F.transform("filled", lambda b: b["events"])), F.lit(0))
    rows = bucket_rows(run.clusters.withColumn("highest", highest), "cluster_id", "highest")
    return rows.withColumn(
        "is_peak", (F.col("events") == F.col("highest")) & (F.col("highest") > 0)
    ).drop("highest")


def report(run: Run) -> DataFrame:
    """One row: report number, headline, the four stats and the executive summary."""
    totals = run.incidents.agg(
        F.struct(
            F.count("*").alias("incidents"),
            F.count_if(F.col("severity") == "Critical").alias("critical"),
        )
    ).scalar()
    services = service_health(run).agg(F.count("*")).scalar()
    cascade = (
        insights(run)
        .filter(F.col("kind") == "Correlation")
        .agg(F.min_by("detail", "place"))
        .scalar()
    )
    base = (
        run.run.withColumn("totals", totals)
        .withColumn("services", services)
        .withColumn("mttr", duration_text(mean_duration(run.incidents)))
        .withColumn("cascade", cascade)
    )
    incidents, critical = F.col("totals.incidents"), F.col("totals.critical")
    sentence = F.concat(
        F.lit("This window analyzed "), F.format_number("event_count", 0),
        F.lit(" log events, which the engine compressed into "),
        F.col("cluster_count").cast("string"), F.lit(" clusters. "), incidents.cast("string"),
        F.lit(" incidents were detected across "), F.col("services").cast("string"),
        F.lit(" services, "), critical.cast("string"),
        F.lit(" of them critical. Mean incident duration was "), F.col("mttr"), F.lit("."),
        F.coalesce(F.concat(F.lit(" "), F.col("cascade")), F.lit("")),
    )
    return base.select(
        F.concat(F.lit("RPT-"), (F.col("run_id") + fixed.REPORT_BASE).cast("string")).alias("report_id"),
        F.concat(F.lit("Reliability Review — "), "source_name").alias("headline"),
        F.greatest(incidents, F.lit(1)).cast("string").alias("incidents"),
        critical.cast("string").alias("critical"),
        F.col("mttr").alias("mean_duration"),
        count_text(F.col("event_count")).alias("events_analyzed"),
        sentence.alias("executive_summary"),
    )


def dashboard(run: Run) -> dict[str, DataFrame]:
    """The whole dashboard."""
    return {
        "run": run_summary(run),
        "kpis": kpis(run),
        "timeline": timeline(run),
        "health": health(run),
        "service_health": service_health(run),
        "top_clusters": top_clusters(run),
        "severity_distribution": severity_distribution(run),
        "insights": insights(run),
        "funnel": funnel(run),
    }


def analytics(run: Run) -> dict[str, DataFrame]:
    """The analytics page."""
    return {
        "run": run_summary(run),
        "trends": trends(run),
        "cluster_frequency": cluster_frequency(run),
        "timeline": timeline(run),
    }

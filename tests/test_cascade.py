"""A two-hour cascade: steady traffic of seven services, five bursts that are still going on
at the end and two that are over."""

import random
from datetime import datetime, timedelta

import pytest

from cinderlog.operators import dashboard, explain, explorer, severity
from cinderlog.plans.analyze import analyze
from cinderlog.session import Workspace
from cinderlog.sources.runs import RunStore

START = datetime(2026, 6, 30, 12)
STEADY = {
    "payments-api": "processed payment intent amount={n}.10 currency=USD",
    "checkout-gateway": "checkout completed items={n} status=200 latency={n}ms",
    "auth-service": "login success user={n} method=password",
    "media-worker": "resized image bytes={n} heap={n}%",
    "analytics-api": "rollup completed rows={n} duration={n}ms",
    "edge-cache": "cache hit region=us-east ratio=0.9{n}",
    "webhooks": "webhook delivered status=200 attempt={n}",
}
# service, level, words, first minute, last minute, lines
BURSTS = [
    ("payments-api", "ERROR", "connection pool exhausted acquiring connection to payments-db after {n}ms", 105, 120, 190),
    ("checkout-gateway", "ERROR", "checkout request failed upstream payments-api returned 503 latency={n}ms", 107, 120, 160),
    ("auth-service", "WARN", "auth token refresh exceeded slo latency={n}ms user={n}", 108, 120, 90),
    ("media-worker", "ERROR", "image resize worker heap usage {n}% oom risk", 102, 120, 70),
    ("webhooks", "WARN", "duplicate webhook delivery detected attempt={n}", 100, 120, 55),
    ("analytics-api", "WARN", "slow query on analytics rollup duration={n}ms", 40, 70, 60),
    ("edge-cache", "WARN", "cdn cache miss ratio degraded ratio=0.{n}", 10, 35, 45),
]


def cascade_lines():
    rng = random.Random(5)
    rows = [
        (rng.uniform(0, 7200), "INFO", service, words)
        for service, words in STEADY.items()
        for _ in range(90)
    ]
    for service, level, words, first, last, count in BURSTS:
        rows += [(rng.uniform(first * 60, last * 60), level, service, words) for _ in range(count)]
    lines = []
    for number, (second, level, service, words) in enumerate(sorted(rows), 1):
        at = (START + timedelta(seconds=second)).isoformat(timespec="milliseconds")
        text = words.replace("{n}", str(rng.randint(100, 9000)))
        lines.append((number, f"{at}Z {level} {service} {text}"))
    return lines


@pytest.fixture(scope="module")
def done(spark):
    lines = spark.createDataFrame(cascade_lines(), "line_no bigint, raw string")
    return analyze(Workspace(spark), lines, "2026-06-30 12:00:00")


@pytest.fixture(scope="module")
def runs(spark, done):
    store = RunStore.create(spark, f"{Workspace(spark).root}/runs")
    store.save(done, "cascade", "2026-07-01 00:00:00")
    return store


def test_root_cause_and_downstream(done):
    worst = {r.service: r for r in done.incidents.orderBy("rank", ascending=False).collect()}
    payments, checkout = worst["payments-api"], worst["checkout-gateway"]
    assert payments.severity == checkout.severity == "Critical"
    edges = done.correlations.filter("kind = 'dependency'").collect()
    (edge,) = [
        e for e in edges if (e.upstream_id, e.downstream_id) == (payments.incident_id, checkout.incident_id)
    ]
    assert edge.lag_seconds >= 0
    assert checkout.incident_id in payments.correlated_ids


def test_steady_traffic_is_no_incident(done):
    titles = " ".join(r.title.lower() for r in done.incidents.collect())
    assert "processed payment intent" not in titles
    assert "login success" not in titles


def test_past_spike_is_resolved(done):
    resolved = {r.service for r in done.incidents.filter("status = 'Resolved'").collect()}
    assert {"analytics-api", "edge-cache"} <= resolved


def test_bounds_and_top_number(done):
    incidents = done.incidents.orderBy("rank").collect()
    assert incidents[0].incident_id == f"INC-{4800 + len(incidents)}"
    assert incidents[-1].incident_id == "INC-4801"
    for i in incidents:
        assert i.severity in ("Critical", "High", "Medium", "Low")
        assert 0.5 <= i.confidence <= 0.99 and 0 <= i.anomaly_score <= 1


def test_same_input_same_result(spark, done):
    lines = spark.createDataFrame(cascade_lines()[::-1], "line_no bigint, raw string")
    again = analyze(Workspace(spark), lines.repartition(7), "2026-06-30 12:00:00")
    assert sorted(map(str, again.incidents.collect())) == sorted(map(str, done.incidents.collect()))
    assert sorted(map(str, again.clusters.collect())) == sorted(map(str, done.clusters.collect()))


def test_dashboard(runs):
    run = runs.load()
    kpis = {r.key: r for r in dashboard.kpis(run).collect()}
    assert set(kpis) == {"events", "active", "critical", "anomalies", "mttr"}
    assert kpis["events"].value == "1.3K" and kpis["events"].delta_pct is None
    shares = {r.severity: r.incidents for r in dashboard.severity_distribution(run).collect()}
    assert shares["Critical"] >= 1 and len(shares) == 4
    timeline = dashboard.timeline(run).collect()
    assert len(timeline) == 24 and sum(r.Critical for r in timeline) > 300
    assert "Cascading failure detected" in [r.title for r in dashboard.insights(run).collect()]
    assert dashboard.health(run).first().health_summary.startswith("Degraded — ")
    assert "1,300 log events" in dashboard.report(run).first().executive_summary


def test_detail(runs):
    run = runs.load()
    payments = run.incidents.filter("service = 'payments-api'").orderBy("rank").first()
    (row,) = explorer.incident_detail(run, payments.incident_id).collect()
    assert row.cluster.zscore > 0 and len(row.cluster.factors) == 6
    assert row.cluster.example_logs and len(row.cluster.buckets) == 24
    assert any(c.kind == "dependency" for c in row.correlations)
    assert [r.incident_id for r in row.related] == payments.correlated_ids
    assert row.explanation is None
    assert explorer.incident_detail(run, "INC-1").collect() == []


def test_factor_rows_add_up(runs):
    run = runs.load()
    sums = severity.factor_rows(run.clusters).groupBy("cluster_id").sum("contribution")
    for row in sums.join(run.clusters, "cluster_id").collect():
        assert row["sum(contribution)"] == pytest.approx(row.severity_score)


def test_explanations_are_stored(runs):
    run = runs.load()
    told = explain.explain(explain.explain_input(run))
    runs.save_explanations(runs.latest_id(), told)
    runs.save_explanations(runs.latest_id(), told)
    run = runs.load()
    assert run.explanations.count() == run.incidents.count()
    top = run.incidents.orderBy("rank").first().incident_id
    detail = explorer.incident_detail(run, top).first()
    assert detail.explanation.source == "deterministic" and len(detail.explanation.suggested_fixes) == 3

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cinderlog import fixed
from cinderlog.operators import correlation
from cinderlog.operators.intervals import interval_join

SCHEMA = (
    "incident_id string, rank bigint, service string, severity string, first_seen timestamp"
)
START = datetime(2024, 1, 1)


def brute_force(incidents):
    """Edges and links by comparing everything with everything."""
    edges, linked, links = [], set(), {i[0]: [] for i in incidents}

    def link(a, b):
        for one, other in ((a, b), (b, a)):
            if other[0] not in links[one[0]]:
                links[one[0]].append(other[0])

    for down in incidents:
        for up in incidents:
            if up is down or up[2] not in fixed.DEPENDENCIES.get(down[2], ()):
                continue
            lag = (down[4] - up[4]).total_seconds()
            if -120 <= lag <= 3600:
                edges.append((up[0], down[0], "dependency", lag))
                linked |= {(up[0], down[0]), (down[0], up[0])}
                link(up, down)
    high = [i for i in incidents if i[3] in ("Critical", "High")]
    for n, a in enumerate(high):
        for b in high[n + 1 :]:
            lag = (b[4] - a[4]).total_seconds()
            if a[2] == b[2] or (a[0], b[0]) in linked or abs(lag) > 180:
                continue
            first, second = (a, b) if lag >= 0 else (b, a)
            edges.append((first[0], second[0], "temporal", abs(lag)))
            link(first, second)
    return edges, links


def test_equals_brute_force(spark):
    rng = random.Random(4)
    services = ["payments-api", "checkout-gateway", "auth-service", "orders-api", "webhooks", None, "x"]
    incidents = [
        (
            f"INC-{4800 + 90 - i}", i + 1, rng.choice(services), rng.choice(fixed.SEVERITIES),
            START + timedelta(seconds=rng.choice([0, 60, 180, 181, 3600, 3720, rng.random() * 9000])),
        )
        for i in range(90)
    ]
    df = spark.createDataFrame(incidents, SCHEMA)
    edges = correlation.correlate(df, correlation.dependency_table(spark))
    found = edges.orderBy(*correlation.EDGE_ORDER).collect()
    expected, links = brute_force(incidents)
    assert [(e.upstream_id, e.downstream_id, e.kind, e.lag_seconds) for e in found] == expected
    assert {e[2] for e in expected} == {"dependency", "temporal"}
    linked = correlation.with_correlated_ids(df, edges).collect()
    assert {r.incident_id: r.correlated_ids for r in linked} == links


@pytest.mark.parametrize("rows_a, rows_b", [(1, 1), (3, 7), (1000, 2000)])
def test_interval_join_equals_brute_force(spark, rows_a, rows_b):
    rng = random.Random(6)
    pick = lambda: (rng.choice([None, 0, 5, 9, 10, 11, 100, -40, rng.randrange(-300, 300)]), rng.choice("xyz") if rng.random() < 0.9 else None)
    left = [(i, *pick()) for i in range(60)] + [(100 + i, 50, "x") for i in range(20)]
    right = [(i, *pick()) for i in range(60)] + [(100 + i, 45, "x") for i in range(20)]
    a = spark.createDataFrame(left, "a int, a_at bigint, a_k string")
    b = spark.createDataFrame(right, "b int, b_at bigint, b_k string")
    for low, high in ((-7, 10), (0, 0), (3, 40)):
        near = [(l, r) for l in left for r in right if None not in (l[1], r[1]) and low <= r[1] - l[1] <= high]
        sizes = {"left_rows": rows_a, "right_rows": rows_b}
        found = lambda **k: sorted((r.a, r.b) for r in interval_join(a, b, ("a_at", "b_at"), low, high, **k, **sizes).collect())
        assert found() == sorted((l[0], r[0]) for l, r in near)
        assert found(on=("a_k", "b_k")) == sorted((l[0], r[0]) for l, r in near if l[2] and l[2] == r[2])
        assert found(apart=("a_k", "b_k")) == sorted((l[0], r[0]) for l, r in near if l[2] != r[2])


def test_a_storm_spreads_over_tasks(spark):
    """Three thousand rows within three minutes."""
    rows = [(i, i % 180, f"s{i % 5}") for i in range(3000)]
    a = spark.createDataFrame(rows, "a int, a_at bigint, a_k string")
    b = spark.createDataFrame(rows, "b int, b_at bigint, b_k string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        pairs = interval_join(a, b, ("a_at", "b_at"), -180, 180, apart=("a_k", "b_k"), left_rows=300, right_rows=300)
        per_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(per_task) == 3000 * 2400
    assert len(per_task) > 30 and max(per_task) < 0.1 * sum(per_task)


def test_details(spark):
    rows = [
        ("INC-2", 1, "payments-api", "Critical", START),
        ("INC-1", 2, "checkout-gateway", "Critical", START - timedelta(seconds=30.5)),
        ("INC-0", 3, None, "High", START + timedelta(seconds=2.5)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = correlation.correlate(df, correlation.dependency_table(spark))
    assert [r.detail for r in found.orderBy(*correlation.EDGE_ORDER).collect()] == [
        "checkout-gateway depends on payments-api; INC-1 ignited ~0s after INC-2",
        "INC-2 and INC-0 spiked within 2s across services",
        "INC-1 and INC-0 spiked within 33s across services",
    ]

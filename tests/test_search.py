"""Search through trigrams, and pages from stored states, against scans of whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import dashboard, explorer, search
from cinderlog.plans.analyze import analyze
from cinderlog.session import Workspace
from cinderlog.sources import runs as stored
from cinderlog.sources.runs import RunStore, bucket_states, filled_rows

WORDS = ["disk", "Ärger", "ΟΔΟΣ", "𝒳𝒴𝒵", "100%", "pool_x", "time out", "naïve"]


@pytest.fixture(scope="module")
def run(spark):
    """90 incidents in blocks of 16."""
    rng, rows, number = random.Random(3), [], 0
    for k in range(90):
        words = " ".join(rng.sample(WORDS, 2)) + " " + "".join(rng.choice("abcdefgh") for _ in range(6))
        for _ in range(rng.randint(3, 6)):
            number += 1
            rows.append((number, f"{rng.choice(['ERROR', 'FATAL', 'WARN'])} svc-{k % 7} {words} {'x ' * (k % 9)}"))
    lines = spark.createDataFrame(rows, "line_no bigint, raw string")
    store = RunStore.create(spark, f"{Workspace(spark).root}/runs")
    before, stored.BLOCK = stored.BLOCK, 16
    try:
        store.save(analyze(Workspace(spark), lines, "2024-01-01 00:00:00"), "many", "2024-03-01 00:00:00")
    finally:
        stored.BLOCK = before
    return store.load()


NEEDLES = [
    "", "a", "sv", "DISK", "disk", "svc-3", "ärger", "οδος", "𝒳𝒴𝒵", "𝒴𝒵", "100%", "_", "%", "time out", "aïv",
    "no such text", "inc-", "CLU-00", "out pool", ".", "(?s)", None,
]


def test_blocks_are_folders(run):
    assert run.incidents.select("block").distinct().count() > 3
    found = run.grams.groupBy("gram", "block").count().filter("count > 1")
    assert found.isEmpty()


@pytest.mark.parametrize("needle", NEEDLES)
def test_search_finds_what_a_scan_finds(run, needle):
    everything = run.incidents.collect()
    want = [r.incident_id for r in explorer.with_baseline(run).filter(explorer.matches(needle)).orderBy(*explorer.sort_order()).collect()]
    assert [r.incident_id for r in explorer.list_incidents(run, needle=needle).collect()] == want
    low = (needle or "").lower()
    fields = lambda r: (r.title, r.service or "", r.incident_id, r.cluster_id)
    assert set(want) == {r.incident_id for r in everything if any(low in f.lower() for f in fields(r))}
    joined = explorer.search_joined(run, f" {needle or ''} ")
    shown = lambda r: f"{r.incident_id} {r.title} {r.service or ''} {r.cluster_id}".lower()
    assert {r.incident_id for r in joined.collect()} == {r.incident_id for r in everything if low.strip() in shown(r)}


def test_a_needle_across_two_fields(run):
    first = run.incidents.filter("service is not null").orderBy("rank").first()
    needle = f"{first.service} {first.cluster_id}"
    assert first.incident_id in {r.incident_id for r in explorer.search_joined(run, needle).collect()}
    assert explorer.list_incidents(run, needle=needle).isEmpty()


def test_blocks_without_the_trigrams_are_not_read(run):
    title = run.incidents.orderBy("rank").first().title
    rare = max(title.split(), key=lambda w: sum(c in "abcdefgh" for c in w) if len(w) == 6 and w.isascii() else 0)
    found = search.may_hold(run.incidents, run.grams, rare)
    assert 0 < found.select("block").distinct().count() < run.incidents.select("block").distinct().count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert search.may_hold(run.incidents, run.grams, "zzzzqq").isEmpty()


def test_trigrams_of_short_and_odd_texts(spark):
    texts = ["", "ab", "abc", "abcab", "aaaaa", "a\nb", "x𝒳yz", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", search.trigrams(F.col("text")).alias("g"))
    for r in rows.collect():
        text = r.text or ""
        want = {text[i : i + 3] for i in range(len(text) - 2)}
        assert want <= set(r.g) and len(set(r.g)) == len(r.g)
        if not any(ord(c) > 0xFFFF for c in text):
            assert want == set(r.g)


def test_states_add_up_to_the_buckets_of_all_clusters(run):
    severities = {r.cluster_id: r.severity for r in run.incidents.collect()}
    want, pages = {}, {}
    for r in filled_rows(run.clusters, "cluster_id", "level").collect():
        key = (r.level, severities.get(r.cluster_id), r.bucket_idx)
        want[key] = want.get(key, 0) + r.events
        pages[r.bucket_idx] = pages.get(r.bucket_idx, 0) + (r.events if key[1] else 0)
    got = {(r.level, r.severity, r.bucket_idx): r.events for r in run.states.collect()}
    assert got == want
    assert bucket_states(run.clusters, run.incidents).count() == len(want)
    shown = [r.Critical + r.High + r.Medium + r.Low for r in dashboard.timeline(run).collect()]
    assert sum(shown) == sum(pages.values())


def test_pages_over_time_leave_the_clusters_unread(run):
    for page in (dashboard.timeline(run), dashboard.trends(run)):
        paths = {path.split("/run_id=")[0].rsplit("/", 1)[1] for path in page.inputFiles()}
        assert paths == {"states"}

import csv
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import dashboard, explain, explorer
from cinderlog.plans.analyze import analyze
from cinderlog.session import Workspace, shared_folder
from cinderlog.sources.commits import Commits, Files
from cinderlog.sources.runs import RunExists, RunStore


def analysed(spark, rows):
    lines = spark.createDataFrame(rows, "line_no bigint, raw string")
    return analyze(Workspace(spark), lines, "2024-01-01 00:00:00")


@pytest.fixture(scope="module")
def store(spark):
    runs = RunStore.create(spark, f"{Workspace(spark).root}/runs")
    small = [(i, f"ERROR svc-a disk {i}% full") for i in range(1, 4)]
    large = [(i, f'ERROR svc-a say, "disk" {i}% full') for i in range(1, 8)] + [(9, "FATAL down")]
    runs.save(analysed(spark, small), "small", "2024-03-02 00:00:00")
    runs.save(analysed(spark, large), "large", "2024-03-01 00:00:00")
    return runs


def test_latest_and_previous(store):
    assert store.latest_id() == 1
    assert store.load().run.first().source_name == "small"
    assert store.load(2).previous.first().run_id == 1
    assert store.load(1).previous.count() == 0
    delta = store.load(2).run.select(dashboard.event_delta(store.load(2).previous)).first()[0]
    assert delta == pytest.approx((8 - 3) / 3 * 100)


def test_only_the_wanted_run_is_scanned(store):
    plan = store.load(2).clusters._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_saving_again_replaces(spark, store):
    before = store.load(2).clusters.count()
    rows = [(i, f'ERROR svc-a say, "disk" {i}% full') for i in range(1, 8)] + [(9, "FATAL down")]
    store.save(analysed(spark, rows), "large", "2024-03-01 00:00:00", run_id=2, replace=True)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.save(analysed(spark, rows), "large", "2024-03-01 00:00:00", run_id=2)
    assert store.load(2).clusters.count() == before
    assert store.table("runs").count() == 2


def test_two_writers_at_once_get_two_runs(spark):
    runs = RunStore.create(spark, f"{Workspace(spark).root}/runs")
    done = analysed(spark, [(i, f"ERROR svc-a disk {i}% full") for i in range(1, 4)])
    with ThreadPoolExecutor(4) as pool:
        saved = [pool.submit(RunStore(spark, runs.path).save, done, f"w{k}", "2024-03-01 00:00:00") for k in range(4)]
        ids = [f.result() for f in saved]
    assert sorted(ids) == [1, 2, 3, 4]
    found = {r.run_id: r.source_name for r in runs.table("runs").collect()}
    assert found == {i: f"w{k}" for k, i in enumerate(ids)}
    assert runs.table("clusters").groupBy("run_id").count().count() == 4
    # all of them found the commit of another in their place but one
    assert runs.commits.newest()[0] == 4


def test_two_writers_of_one_id_get_one_run_and_one_error(spark):
    runs = RunStore.create(spark, f"{Workspace(spark).root}/runs")
    done = analysed(spark, [(i, f"ERROR svc-a disk {i}% full") for i in range(1, 4)])

    def save(name):
        try:
            return RunStore(spark, runs.path).save(done, name, "2024-03-01 00:00:00", run_id=7)
        except RunExists:
            return None

    with ThreadPoolExecutor(2) as pool:
        ids = list(pool.map(save, ["a", "b"]))
    assert sorted(ids, key=str) == [7, None]
    assert runs.table("runs").count() == 1


def test_readers_never_see_half_a_run(spark, monkeypatch):
    runs = RunStore.create(spark, f"{Workspace(spark).root}/runs")
    done = analysed(spark, [(i, f"ERROR svc-a disk {i}% full") for i in range(1, 4)])
    runs.save(done, "whole", "2024-03-01 00:00:00")
    before = runs.load().clusters.count()
    dying = RunStore(spark, runs.path)
    for name in ("correlations", "runs"):
        stage = RunStore._stage

        def fail(self, table, *rest, at=name, stage=stage):
            if table == at:
                raise OSError("lost")
            stage(self, table, *rest)

        if name == "runs":
            monkeypatch.setattr(dying, "_commit", lambda change: (_ for _ in ()).throw(OSError("lost")))
        else:
            monkeypatch.setattr(RunStore, "_stage", fail)
        for replace in ({}, {"run_id": 1, "replace": True}):
            with pytest.raises(OSError):
                dying.save(done, "half", "2024-03-02 00:00:00", **replace)
        monkeypatch.undo()
        dying = RunStore(spark, runs.path)
    assert [r.source_name for r in runs.table("runs").collect()] == ["whole"]
    assert runs.load().clusters.count() == before and runs.table("clusters").count() == before
    # ids of lost writers stay unused
    assert runs.save(done, "next", "2024-03-03 00:00:00") > 1


def test_a_lost_hint_costs_time_only(spark):
    files = Files(spark, f"{Workspace(spark).root}/commits-only")
    commits = Commits(files)
    assert commits.newest() == (0, None)
    assert commits.add(1, "a") and commits.add(2, "b") and not commits.add(2, "c")
    for told in ("", "x", "1", "9"):
        files.write("commits/hint", told)
        assert commits.newest() == (2, "b")


def test_files_of_another_file_system_are_never_overwritten(spark):
    """The way of all systems but the local disk: a rename that refuses to overwrite."""
    files = Files(spark, f"{Workspace(spark).root}/renamed")
    files.write("a/staged-1", "one")
    files.write("a/staged-2", "two")
    assert files._rename("a/staged-1", "a/name")
    assert not files._rename("a/staged-2", "a/name")
    assert files.read("a/name") == "one" and files.read("a/staged-2") is None


def test_export(store, tmp_path):
    explorer.export_csv(store.load(2), str(tmp_path / "out"))
    rows = []
    for path in sorted(Path(tmp_path / "out").glob("*.csv")):
        rows += list(csv.reader(path.open(newline="")))[1:]
    assert rows[0][1:5] == ["Medium", 'say, "disk" 1% full', "svc-a", "CLU-001"]
    assert rows[0][10] == "2024-01-01T00:00:00"


def test_empty_input(spark):
    done = analysed(spark, [(1, "  "), (2, "")])
    assert tuple(done.counts.first()) == (0, 0, 0)
    assert done.clusters.count() == done.incidents.count() == done.correlations.count() == 0
    window = done.window.first()
    assert window.window_start == window.window_end
    runs = RunStore.create(spark, f"{Workspace(spark).root}/runs")
    runs.save(done, "empty", "2024-01-01 00:00:00")
    run = runs.load()
    assert run.run.first().bucket_seconds == 300
    assert [r.raw for r in dashboard.kpis(run).collect()] == [0, 0, 0, 0, 0]
    assert dashboard.timeline(run).count() == dashboard.trends(run).count() == 0
    assert dashboard.health(run).first().health_score == 100


def test_no_run_at_all(spark):
    run = RunStore.create(spark, f"{Workspace(spark).root}/runs").load()
    assert run.run.count() == 0
    assert dashboard.kpis(run).count() == 0
    assert tuple(dashboard.health(run).first()) == (100, "No data yet — upload logs to begin.")
    assert explorer.list_incidents(run).count() == 0
    assert dashboard.insights(run).count() == 0
    assert explorer.incident_detail(run, "INC-1").count() == 0


def test_filters(store):
    run = store.load(2)
    ids = lambda **k: [r.incident_id for r in explorer.list_incidents(run, **k).collect()]
    everything = ids()
    assert ids(severity="all", status="", needle="") == everything
    assert ids(severity="medium") == [r.incident_id for r in run.incidents.filter("severity='Medium'").orderBy(F.desc("confidence")).collect()]
    assert ids(needle="DISK") and not ids(needle="%no%")
    assert ids(needle="_") == []


def test_outside_responses(spark):
    told = spark.createDataFrame(
        [(f"INC-{i}", "deterministic", "s", "c", ["f"]) for i in range(6)],
        "incident_id string, source string, summary string, root_cause string, suggested_fixes array<string>",
    )
    responses = spark.createDataFrame(
        [
            ("INC-0", '{"summary":"S","root_cause":1.50,"suggested_fixes":["1","2",3,"4","5","6"]}'),
            ("INC-1", '{"summary":"S","root_cause":"R","suggested_fixes":"one"}'),
            ("INC-2", '{"summary":"S","root_cause":"R"}'),
            ("INC-3", "not json"),
            ("INC-4", '["summary","root_cause","suggested_fixes"]'),
        ],
        "incident_id string, response string",
    )
    found = {r.incident_id: r for r in explain.merge_responses(told, responses).collect()}
    assert (found["INC-0"].root_cause, found["INC-0"].suggested_fixes) == ("1.5", ["1", "2", "3", "4", "5"])
    assert (found["INC-1"].source, found["INC-1"].suggested_fixes) == ("gemini", ["one"])
    assert [found[f"INC-{i}"].source for i in (2, 3, 4, 5)] == ["deterministic"] * 4


def test_shared_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") == shared_folder(spark)

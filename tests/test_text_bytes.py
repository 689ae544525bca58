"""An analysis writes its texts once, and moves them only to mine and to show them."""

import time

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import mining
from cinderlog.plans import analyze as plan
from cinderlog.session import Workspace

BASE = "2024-01-01 00:00:00"
LINES = [
    (1, "alpha event of kind one"),
    (2, "  alpha event of kind two"),
    (3, "beta 17 ms"),
    (4, "2024-01-02T03:04:05 WARN svc-a beta 18 ms"),
    (5, '{"level":"warn","msg":" "}'),
    (6, '{"msg":"<empty>"}'),
    (7, "gamma of its own"),
    (9, "alpha event of kind two"),
] + [(10 + i, f"p q r s {tail}") for i, tail in enumerate(["a a a a a a", "b b b b b b", "a c c c c c", "c d d d d d", "b b b b b b"])]


def analyzed(spark, workspace, lines=LINES):
    return plan.analyze(workspace, spark.createDataFrame(lines, "line_no bigint, raw string"), BASE)


@pytest.fixture
def written(monkeypatch):
    """The written work tables, as they are in their files."""
    seen, table = {}, Workspace.table

    def recorded(self, df, name):
        made = table(self, df, name)
        seen.setdefault(name, []).append(made)
        return made

    monkeypatch.setattr(Workspace, "table", recorded)
    return seen


def test_texts_are_written_once(spark, workspace, written):
    done = analyzed(spark, workspace)
    named = {name for name in written for made in written[name] if ("sequence", "string") in made.dtypes}
    assert named == {"routed"}
    assert {name for name in written for made in written[name] if "raw" in made.columns} == {"parsed"}
    stored = {r.line_no: r for r in written["parsed"][0].collect()}
    assert (stored[1].raw, stored[1].message, stored[1].masked) == ("alpha event of kind one", None, None)
    assert (stored[2].message, stored[2].masked) == ("alpha event of kind two", None)
    assert (stored[3].message, stored[3].masked) == (None, "beta <DUR>")
    (shown,) = written["clusters"]
    assert shown.filter("created = 7 AND example IS NULL AND template IS NULL").count() == 1
    found = {r.line_no: r for r in done.events.collect()}
    assert (found[1].message, found[1].masked) == ("alpha event of kind one", "alpha event of kind one")
    assert (found[3].message, found[3].masked) == ("beta 17 ms", "beta <DUR>")
    # the clock of lines without a time counts those alone, in order
    assert [found[n].ts.second for n in (1, 2, 3, 4, 5, 9)] == [0, 1, 2, 5, 3, 6]
    assert done.event_clusters().count() == len(LINES)


def test_samples_by_line_and_by_broadcast_are_the_same(spark, workspace, monkeypatch):
    some = analyzed(spark, workspace).clusters.collect()
    monkeypatch.setattr(plan, "BROADCAST_LINES", 0)
    many = analyzed(spark, workspace).clusters.collect()
    assert sorted(map(str, some)) == sorted(map(str, many))
    found = {r.created: r for r in many}
    assert (found[1].template, found[1].example, found[1]["count"]) == ("alpha event of kind <*>", "alpha event of kind one", 3)
    assert found[1].examples == ["alpha event of kind one", "  alpha event of kind two", "alpha event of kind two"]
    assert (found[5].template, found[5].example, found[5].examples) == ("<empty>", "<empty>", [LINES[4][1], LINES[5][1]])
    assert (found[7].template, found[7].tokens, found[7].token_count) == ("gamma of its own", ["gamma", "of", "its", "own"], 4)


def test_lines_that_come_twice_keep_their_texts(spark, workspace):
    lines = [(1, "one text here"), (1, "one text here"), (2, "another"), (2, "yet some other text"), (3, "another")]
    events = spark.createDataFrame(lines, "line_no bigint, masked string")
    routed = {r.sequence: r for r in mining.routed_lines(workspace, events).collect()}
    assert {k: (r.first_line, r.events, r.tokens) for k, r in routed.items()} == {
        "one text here": (1, 2, ["one", "text", "here"]),
        "another": (2, 2, ["another"]),
        "yet some other text": (2, 1, ["yet", "some", "other", "text"]),
    }


def test_routed_lines_are_the_routed_texts(spark, workspace):
    rows = [(i, f"w{chr(97 + i % 7)} k{i % 3} end{'' if i % 5 else ' more'}") for i in range(60)] + [(99, "")]
    events = spark.createDataFrame(rows, "line_no bigint, masked string")
    columns = ("sequence", "first_line", "events", "leaf", "founds", "alone", "tokens")
    whole = mining.routed_table(workspace, mining.distinct_sequences(events), 4, 2).select(*columns)
    lines = mining.routed_lines(workspace, events, 4, 2).select(*columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, lines.collect()))


def test_a_written_table_leaves_no_shuffle_files(spark, workspace):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return sum("shuffle" in disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size()))

    settings = {k: spark.conf.get(k, None) for k in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled",)}
    before = files()
    shuffled = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    table = workspace.table(shuffled, "shuffled")
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before
    assert {k: spark.conf.get(k, None) for k in settings} == settings
    assert table.count() == 10 and table.agg(F.sum("n")).first()[0] == 1000

"""Mining moves no more text than it needs."""

import pytest

from cinderlog.operators import mining
from cinderlog.session import Workspace


@pytest.fixture
def written(monkeypatch):
    """Types of the columns of every work table."""
    seen, table = {}, Workspace.table

    def recorded(self, df, name):
        seen.setdefault(name, []).append(dict(df.dtypes))
        return table(self, df, name)

    monkeypatch.setattr(Workspace, "table", recorded)
    return seen


def test_tokens_are_written_joined_and_lines_meet_by_digest(spark, workspace, written):
    lines = [(1, "a b c d e f"), (2, "a b c d e g"), (3, "x y"), (4, ""), (5, "a b c d e g"), (6, "q  r"), (7, "x y")]
    events = spark.createDataFrame(lines, "line_no bigint, masked string")
    routed = mining.routed_table(workspace, mining.distinct_sequences(events))
    versions = mining.mine(workspace, routed)
    steps = workspace.table(mining.sequence_steps(mining.by_digest(routed), versions), "steps")
    assigned = mining.assign_events(events, routed, steps).select("line_no", "created")

    assert not any(types.get("tokens", "string") != "string" for name in written for types in written[name])
    assert "tokens" not in written["keys"][0] and "tokens" not in written["routed"][0]
    assert written["steps"][0]["sequence"] == "binary"
    assert {r.created: r.tokens for r in mining.latest(versions).collect()} == {
        1: ["a", "b", "c", "d", "e", "<*>"], 3: ["x", "y"], 4: ["<empty>"], 6: ["q", "", "r"]
    }
    assert sorted(tuple(r) for r in assigned.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 1), (6, 6), (7, 3)]


def test_routing_without_texts_gives_the_same_leaves(spark, workspace):
    events = spark.createDataFrame([(i, f"w{chr(97 + i % 7)} k{i % 3} end") for i in range(40)], "line_no bigint, masked string")
    sequences = mining.distinct_sequences(events)
    whole = mining.route(workspace, sequences, 4, 2)
    bare = mining.route(workspace, sequences.drop("sequence"), 4, 2)
    assert whole.columns == ["sequence", "first_line", "events", "tokens", "leaf"]
    assert bare.columns == ["first_line", "events", "leaf"]
    assert sorted(whole.select("first_line", "leaf").collect()) == sorted(bare.select("first_line", "leaf").collect())

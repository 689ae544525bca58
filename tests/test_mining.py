import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cinderlog.functions.masks import normalize
from cinderlog.operators import mining, templates
from cinderlog.plans import adapters
from cinderlog.plans.analyze import analyze


def sequential(lines, depth=4, cap=100, threshold=0.5):
    """Plain miner over (line, masked text): templates and the template of every line."""
    leaves, nodes, found, assigned = {}, {}, [], {}
    for line, masked in lines:
        tokens = masked.split() or ["<empty>"]
        path = (len(tokens),)
        for token in tokens[: max(2, depth)]:
            key = token
            if not (token.startswith("<") and token.endswith(">")) and any(c.isdigit() for c in token):
                key = "<*>"
            children = nodes.setdefault(path, set())
            if key not in children and len(children) >= cap:
                key = "<*>"
            children.add(key)
            path += (key,)
        candidates = leaves.setdefault(path, [])
        scores = [
            sum(t in ("<*>", s) for t, s in zip(found[i][1], tokens)) / len(tokens) for i in candidates
        ]
        if scores and max(scores) >= threshold:
            best = candidates[scores.index(max(scores))]
            found[best][1] = [t if t == s else "<*>" for t, s in zip(found[best][1], tokens)]
        else:
            best = len(found)
            found.append([line, tokens])
            candidates.append(best)
        assigned[line] = found[best][0]
    return {line: tokens for line, tokens in found}, assigned


def mined(spark, workspace, lines, depth=4, cap=100, threshold=0.5, hot_share=1 / 512, **sizes):
    events = spark.createDataFrame(lines, "line_no bigint, masked string")
    sequences = mining.distinct_sequences(events)
    routed = workspace.table(mining.route(workspace, sequences, depth, cap), "routed")
    versions = mining.mine(workspace, routed, threshold, **sizes)
    steps = workspace.table(mining.sequence_steps(routed, versions), "steps")
    assigned = mining.assign_events(events, routed, steps, hot_share)
    return (
        {r.created: r.tokens for r in mining.latest(versions).collect()},
        {r.line_no: r.created for r in assigned.select("line_no", "created").collect()},
    )


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_sequential_miner(spark, workspace, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(rng.choice([2, 3, 5, 9]))] + ["<NUM>", "x1", "<*>", "²"]
    lines = [
        (3 * i + 1, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 6, 6, 7]))))
        for i in range(250)
    ]
    depth, cap = rng.choice([2, 3, 4]), rng.choice([1, 2, 3, 100])
    threshold = rng.choice([0.3, 0.5, 0.7, 1.0])
    expected = sequential(lines, depth, cap, threshold)
    found = mined(
        spark, workspace, lines, depth, cap, threshold, rng.choice([0.01, 0.9]),
        first_block=rng.choice([4, 16]), largest_block=32, leaf_templates=rng.choice([2, 1000]),
    )
    assert found == expected


def test_node_with_more_children_than_allowed(spark, workspace):
    letters = [f"{a}{b}" for a in "abcdefghijkl" for b in "abcdefghijkl"]
    lines = [(i + 1, f"{w} same tail here") for i, w in enumerate(letters + letters[::-1])]
    assert mined(spark, workspace, lines) == sequential(lines)


def test_default_sizes_on_one_wide_leaf(spark, workspace):
    rng = random.Random(3)
    lines = [(i, f"a b c d {rng.choice('xyz')}{i} {rng.choice('uvw')} {i} q{i} r{i} s{i}") for i in range(1500)]
    assert mined(spark, workspace, lines, first_block=64) == sequential(lines)


def test_all_lines_of_the_documents(spark, workspace):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no driver tables")
    masked = adapters.document_lines(spark, folder).select(
        "line_no", normalize(F.col("raw")).alias("masked")
    )
    lines = [(r.line_no, r.masked) for r in masked.orderBy("line_no").collect()]
    assert mined(spark, workspace, lines) == sequential(lines)


@pytest.mark.parametrize("few", [0, 10**9])
def test_index_finds_what_comparing_all_templates_finds(monkeypatch, few):
    monkeypatch.setattr(mining, "FEW", few)
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "<*>", "<NUM>"]
    leaf, plain = mining._Leaf(), []
    for line in range(600):
        tokens = [rng.choice(words) + ("" if rng.random() < 0.5 else str(rng.randrange(3))) for _ in range(7)]
        scores = [sum(t in ("<*>", s) for t, s in zip(own, tokens)) for _, own in plain]
        expected = (scores.index(max(scores)), max(scores)) if plain else (-1, 0)
        assert leaf.best(tokens) == expected
        threshold = rng.choice([0.6, 0.9, 1.0])
        leaf.absorb(line, tokens, threshold)
        if plain and expected[1] / 7 >= threshold:
            own = plain[expected[0]][1]
            plain[expected[0]][1] = [t if t == s else "<*>" for t, s in zip(own, tokens)]
        else:
            plain.append([line, tokens])
        assert [[c, t] for c, t in zip(leaf.created, leaf.tokens)] == plain


@pytest.mark.parametrize("rows_per_walk", [3, 50_000])
def test_walks_of_wide_leaves_are_split(spark, workspace, rows_per_walk):
    rng = random.Random(5)
    pick = lambda: [rng.choice(["a", "b", "<*>"]) for _ in range(4)]
    texts = [(rng.choice("xyz"), 100 + i, [rng.choice("ab<") for _ in range(4)]) for i in range(80)]
    versions = [(rng.choice("xy"), i // 2, i, pick()) for i in range(60)]
    sequences = workspace.table(spark.createDataFrame(texts, "leaf string, first_line bigint, tokens array<string>"), "s")
    found = mining.covering_versions(
        sequences, workspace.table(spark.createDataFrame(versions, mining.VERSION_SCHEMA), "v"), rows_per_walk
    )
    # the oldest template at every line, whatever the parts passed on
    def oldest(steps):
        out, best = {}, None
        for line in range(61):
            here = [c for f, c in steps if f == line]
            best = min([*here, *([] if best is None else [best])], default=None)
            out[line] = best
        return out

    got = {}
    for r in found.collect():
        got.setdefault(r.first_line, []).append((r.from_line, r.created))
    for leaf, line, tokens in texts:
        covering = [
            (f, c) for own, c, f, t in versions
            if own == leaf and "<*>" in t and all(a in ("<*>", b) for a, b in zip(t, tokens))
        ]
        assert oldest(got.get(line, [])) == oldest(covering)


def test_threshold_above_one_is_refused(spark, workspace):
    with pytest.raises(ValueError):
        mining.mine(workspace, None, 1.5)


def run(spark, workspace, rows):
    lines = spark.createDataFrame(rows, "line_no bigint, raw string")
    return analyze(workspace, lines, "2024-01-01 00:00:00")


def test_similar_lines_become_one_template(spark, workspace):
    rows = [(i + 1, f"ERROR svc-a connection pool exhausted for db-{i} after {i * 10}ms") for i in range(5)]
    (row,) = run(spark, workspace, rows).clusters.select("cluster_id", "count", "level").collect()
    assert tuple(row) == ("CLU-001", 5, "ERROR")


def test_varying_word_becomes_wildcard(spark, workspace):
    rows = [(1, "payment failed for account alice"), (2, "payment failed for account bob")]
    (row,) = run(spark, workspace, rows).clusters.select("tokens", "count", "examples", "example").collect()
    assert row.tokens == ["payment", "failed", "for", "account", "<*>"]
    assert (row["count"], row.examples, row.example) == (2, [r for _, r in rows], rows[0][1])


def test_unlike_lines_and_their_ids(spark, workspace):
    rows = [(1, "alpha event one"), (2, "beta event two"), (3, "user login succeeded now")]
    found = run(spark, workspace, rows).clusters.orderBy("created").select("cluster_id", "template").collect()
    assert [tuple(r) for r in found] == [
        ("CLU-001", "alpha event one"), ("CLU-002", "beta event two"), ("CLU-003", "user login succeeded now"),
    ]


def test_level_and_services(spark, workspace):
    rows = [(1, "WARN svc-a db broke"), (2, "ERROR svc-b db broke"), (3, "ERR svc-b db broke"), (4, "INFO svc-a idle now")]
    found = {r.template: r for r in run(spark, workspace, rows).clusters.collect()}
    assert found["db broke"].level == "ERROR"
    assert found["db broke"].services == {"svc-a": 1, "svc-b": 2}
    assert found["db broke"].primary_service == "svc-b"
    assert found["idle now"].level == "UNKNOWN"


def test_service_tie_goes_to_the_first_seen(spark, workspace):
    rows = [(1, "WARN svc-b x y"), (2, "WARN svc-a x y"), (3, "WARN svc-a x y"), (4, "WARN svc-b x y")]
    (row,) = run(spark, workspace, rows).clusters.collect()
    assert row.primary_service == "svc-b"


def test_example_skips_empty_messages_and_examples_stop_at_eight(spark, workspace):
    rows = [(i, '{"level":"warn","msg":" "}') for i in range(1, 11)] + [(20, '{"msg":"<empty>"}')]
    (row,) = run(spark, workspace, rows).clusters.collect()
    assert (row.template, row.example, row["count"]) == ("<empty>", "<empty>", 11)
    assert row.examples == [raw for _, raw in rows[:8]]


def test_moving_sequences_are_counted_by_line(spark, workspace):
    """A text that founds a template of its own can later belong to an older, wider one."""
    tails = ["a a a a a a", "b b b b b b", "b b b b b b", "a c c c c c", "c d d d d d"]
    tails += ["b b b b b b", "a a a a a a"] * 10
    lines = [(3 * i + 1, f"p q r s {tail}") for i, tail in enumerate(tails)]
    done = run(spark, workspace, lines)
    assert done.steps.filter(F.col("to_line").isNotNull()).count() > 0
    expected, assigned = sequential(lines)
    counts = {}
    for created in assigned.values():
        counts[created] = counts.get(created, 0) + 1
    assert {r.created: r["count"] for r in done.clusters.collect()} == counts
    first = {}
    for line, text in lines:
        first.setdefault(assigned[line], []).append(text)
    assert {r.created: r.examples for r in done.clusters.collect()} == {k: v[:8] for k, v in first.items()}


def test_ids_keep_all_digits(spark):
    found = spark.range(998, 1001).select(templates.template_id(F.col("id"))).collect()
    assert [r[0] for r in found] == ["CLU-998", "CLU-999", "CLU-1000"]

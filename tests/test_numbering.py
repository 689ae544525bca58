"""Rows before, ranges of numbers and the reading they save, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import numbering
from cinderlog.plans import analyze as plan
from cinderlog.session import Workspace
from cinderlog.sources.runs import run_history


def table(spark, numbers, parts=5):
    rows = [(n, f"v{n}" if n % 3 else None) for n in numbers]
    return spark.createDataFrame(rows, "at bigint, value string").repartition(parts)


@pytest.mark.parametrize("numbers", [[], [7], range(40), [3, -8, 2**40, 0, 5_000_000]])
def test_the_row_before(spark, numbers):
    numbers = list(numbers)
    got = numbering.with_previous(table(spark, numbers), "at", "before", F.struct("at", "value"))
    ordered = sorted(numbers)
    want = {n: p for p, n in zip(ordered, ordered[1:])}
    found = {r.at: r.before for r in got.collect()}
    assert sorted(found) == ordered
    for n, before in found.items():
        if n not in want:
            assert before is None or before.at is None
        else:
            assert (before.at, before.value) == (want[n], f"v{want[n]}" if want[n] % 3 else None)


def test_history_needs_no_window_over_everything(spark):
    rows = [(k * 3, k * 100) for k in range(1, 30)]
    random.Random(1).shuffle(rows)
    runs = spark.createDataFrame(rows, "run_id bigint, event_count bigint").repartition(4)
    got = sorted((r.run_id, r.event_count, r.previous_id, r.previous_event_count) for r in run_history(runs).collect())
    want = [(k * 3, k * 100, *(((k - 1) * 3, (k - 1) * 100) if k > 1 else (None, None))) for k in range(1, 30)]
    assert got == want


def brute_spans(numbers, most, least):
    numbers = sorted(set(numbers))
    gaps = sorted((b - a, -b, a) for a, b in zip(numbers, numbers[1:]) if b - a >= least)[::-1][: most - 1]
    cuts = sorted((a, -b) for _, b, a in gaps)
    lows, highs = [numbers[0], *(b for _, b in cuts)], [*(a for a, _ in cuts), numbers[-1]]
    return list(zip(lows, highs))


@pytest.mark.parametrize("seed", range(3))
def test_ranges_are_cut_at_the_widest_gaps(spark, seed):
    rng = random.Random(seed)
    numbers = [rng.randrange(100_000) for _ in range(60)] + [5, 5, 99_999]
    got = numbering.spans(table(spark, numbers), "at", 9, 100)
    assert got == brute_spans(numbers, 9, 100) and len(got) == 9
    inside = table(spark, range(0, 100_000, 7)).filter(numbering.within("at", got))
    want = [n for n in range(0, 100_000, 7) if any(a <= n <= b for a, b in got)]
    assert sorted(r.at for r in inside.collect()) == want


def test_no_numbers_no_ranges(spark):
    empty = table(spark, [])
    assert numbering.spans(empty, "at", 9, 100) == []
    assert table(spark, range(5)).filter(numbering.within("at", [])).count() == 0
    assert numbering.spans(table(spark, [4]), "at", 9, 100) == [(4, 4)]


def rows_scanned(df):
    """Rows that the scans of an executed plan have read, without those of skipped pages."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    metrics = [leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())]
    return sum(metrics)


def test_wide_columns_are_read_around_the_numbers_alone(spark):
    rows = spark.range(400_000).select(F.col("id").alias("line_no"), F.sha2(F.col("id").cast("string"), 256).alias("raw"))
    written = Workspace(spark).table(rows.coalesce(2), "wide")
    chosen = spark.createDataFrame([(n,) for n in (1, 2, 210_000, 399_000)], "line_no bigint")
    ranges = numbering.spans(chosen, "line_no", plan.SAMPLE_RANGES, 2 * plan.PAGE_ROWS)
    assert ranges == [(1, 399_000)]  # too little to skip for one more pass
    ranges = numbering.spans(chosen, "line_no", 8, plan.PAGE_ROWS)
    assert ranges == [(1, 2), (210_000, 210_000), (399_000, 399_000)]
    assert rows_scanned(written.filter(numbering.within("line_no", ranges))) <= 4 * plan.PAGE_ROWS
    assert rows_scanned(written.filter(numbering.within("line_no", [(1, 399_000)]))) == 400_000

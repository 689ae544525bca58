import os
import random
import statistics
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import anomaly
from cinderlog.operators.frequency import Window, dense, growth, sparse_counts
from cinderlog.operators.numbering import number_rows, number_sorted, prefix_sum
from cinderlog.sources.lines import read_text, table_lines


ROOT = Path(__file__).resolve().parents[1]


def test_files_are_numbered_in_order(spark, tmp_path):
    texts = {"b.log": "four\n\nsix", "a.log": "one\r\ntwo\x0bthree\n", "c.log": "seven\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    found = read_text(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.raw) for r in found] == [
        (1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, ""), (6, "six"), (7, "seven"),
    ]


def test_numbers_across_splits(spark, tmp_path):
    rng = random.Random(1)
    lines = ["x" * rng.randint(0, 60) + str(i) for i in range(20000)]
    (tmp_path / "big.log").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        read = read_text(spark, str(tmp_path), unicode_breaks=False)
        assert read.select(F.spark_partition_id()).distinct().count() > 1
        found = {r.line_no: r.raw for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == dict(enumerate(lines, 1))


def test_bad_bytes_are_replaced(spark, tmp_path):
    data = b"ok \xff\xc3\x28 \xe2\x82 end\n\xf0\x9f\x92\xa9 fine"
    (tmp_path / "bad.log").write_bytes(data)
    found = [r.raw for r in read_text(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert found == data.decode("utf-8", errors="replace").splitlines()


def test_table_lines(spark):
    texts = ["a\nb", "c", "d e\x85f", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    found = table_lines(df, "text", "id").orderBy("line_no").collect()
    assert [(r.line_no, r.id, r.raw) for r in found] == [
        (1, 0, "a"), (2, 0, "b"), (3, 1, "c"), (4, 2, "d"), (5, 2, "e"), (6, 2, "f"), (7, 3, ""),
    ]


def test_prefix_sum_over_blocks(spark):
    keys = random.Random(2).sample(range(-500, 5000), 300)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k bigint, w bigint")
    found = {r.k: r.s for r in prefix_sum(df, "k", F.col("w"), "s").collect()}
    total, expected = 0, {}
    for k in sorted(keys):
        expected[k], total = total, total + k % 7
    assert found == expected
    numbers = {r.k: r.n for r in number_rows(df, "k", "n").collect()}
    assert numbers == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_number_sorted(spark, workspace):
    rows = [(i, random.Random(i).random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, score double")
    found = number_sorted(workspace, df, [F.desc("score"), F.asc("id")], "rank").collect()
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r.id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in found) == list(range(1, 501))


def test_numbers_of_sparse_keys_and_rolled_files(spark, workspace):
    """Random 63-bit keys, and files that roll over every few rows."""
    draw = random.Random(3)
    keys = [draw.randrange(1 << 62) for _ in range(1200)]
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k bigint, w bigint")
    before = {k: sum(x % 7 for x in keys if x < k) for k in keys}
    place = {k: i + 1 for i, k in enumerate(sorted(keys))}
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    try:
        assert {r.k: r.s for r in prefix_sum(df, "k", F.col("w"), "s").collect()} == before
        assert {r.k: r.n for r in number_rows(df, "k", "n").collect()} == place
        found = number_sorted(workspace, df, [F.col("k")], "rank").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert {r.k: r["rank"] for r in found} == place


def test_long_series_with_few_filled_buckets(spark):
    view = Window(F.lit("1970-01-01").cast("timestamp"), F.lit(86400), F.lit(60000), F.lit(1))
    rows = spark.createDataFrame([("a", 0, 1), ("a", 59990, 2), ("a", 59990, 3), ("b", 7, 4)], "k string, bucket_idx int, events bigint")
    series = sparse_counts(rows, "k", view)
    assert {r.k: [tuple(e) for e in r.filled] for r in series.collect()} == {"a": [(0, 1), (59990, 5)], "b": [(7, 4)]}
    found = {r.k: r.counts for r in series.select("k", dense(F.col("filled"), F.col("n_buckets")).alias("counts")).collect()}
    assert {k: (len(v), sum(v)) for k, v in found.items()} == {"a": (60000, 6), "b": (60000, 4)}
    assert found["a"][0] == 1 and found["a"][59990] == 5 and found["b"][7] == 4


@pytest.mark.parametrize("n", [1, 2, 3, 8, 13])
def test_sparse_statistics_equal_those_of_the_whole_series(spark, n):
    rng = random.Random(n)
    series = {f"s{i}": [rng.choice([0, 0, 0, 1, 2, 2, 7, 40]) for _ in range(n)] for i in range(60)}
    series = {k: v for k, v in series.items() if any(v)} | {"full": [3] * n, "one": [0] * (n - 1) + [9]}
    rows = [(k, i, c) for k, v in series.items() for i, c in enumerate(v) if c or rng.random() < 0.3]
    view = Window(F.lit("1970-01-01").cast("timestamp"), F.lit(60), F.lit(n), F.lit(1))
    df = spark.createDataFrame(rows, "k string, bucket_idx int, events bigint")
    scored = anomaly.score(growth(sparse_counts(df, "k", view)))
    for r in scored.collect():
        counts, tail = series[r.k], max(1, n // 6)
        center = statistics.median(counts)
        mad = statistics.median(abs(c - center) for c in counts)
        recent = sum(counts[n - tail :])
        base = sum(counts[: n - tail]) / (n - tail) if n > tail else recent / tail
        assert (r.center, r.peak_count, r.peak_idx) == (center, max(counts), counts.index(max(counts)))
        assert r.scale == pytest.approx(max(1.4826 * mad, max(center, 1) ** 0.5, 1))
        assert r.recent_count == recent and r.baseline_rate == pytest.approx(base)
        assert r.peak_is_recent == (r.peak_idx >= n - tail)


def test_workers_get_the_package(tmp_path):
    """Mining runs from another folder, without the package on the workers' path."""
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from cinderlog.session import Workspace, local_session\n"
        "from cinderlog.plans.analyze import analyze\n"
        "spark = local_session('2')\n"
        "rows = [(i, f'ERROR svc job run has stopped for the reason {w} today') for i, w in enumerate('abcdefgh')]\n"
        "done = analyze(Workspace(spark), spark.createDataFrame(rows, 'line_no bigint, raw string'), '2024-01-01 00:00:00')\n"
        "print('clusters', done.clusters.count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "clusters 1" in told.stdout, told.stderr[-2000:]

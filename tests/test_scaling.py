"""What keeps the work of the queries in proportion to their rows."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import mining
from cinderlog.plans.catalog import QUERIES
from cinderlog.sources.lines import spread


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    ts = datetime.datetime(2024, 1, 12, 10)
    spark.createDataFrame(
        [(i, ts, i % 5, "view", 1.5) for i in range(20)],
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    ).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame(
        [(1, "one line\n\nof two"), (2, None), (3, "")], "doc_id bigint, text string"
    ).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_routing_keys_mask_no_line_in_a_filter(spark, tables):
    keys = QUERIES["t01_routing_keys"](spark, tables)
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    # conditions hold line breaks, so nodes are told apart by their branches
    filters = [node for node in re.split(r"\n[ :]*[+:]- ", plan) if node.startswith("Filter")]
    assert filters and not any("regexp_replace" in node for node in filters)
    assert {"one", "line", "of", "two"} <= {r["token"] for r in keys.collect()}
    assert keys.filter("token IS NULL").isEmpty()


def test_scan_of_many_rows_is_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/rows")
    scan = spark.read.parquet(f"{tmp_path}/rows")
    cores = spark.sparkContext.defaultParallelism
    parts = spread(scan, rows_per_task=10).select(F.spark_partition_id().alias("p"), "id")
    assert parts.select("p").distinct().count() == max(cores, 100)
    assert parts.select("id").distinct().count() == 1000


def test_first_of_leaves_sorts_little_more_than_a_block(spark, workspace):
    rows = [("a", 7 * i, ["x", str(i)]) for i in range(2000)] + [("b", i, ["y"]) for i in range(30)]
    rows += [("c", i if i < 300 else 10**17 + i, ["z"]) for i in range(400)]  # lines far apart
    table = spark.createDataFrame(rows, "leaf string, first_line bigint, tokens array<string>")
    remaining = workspace.table(table, "remaining")
    found = mining.first_of_leaves(remaining, 100)
    got = sorted((r.leaf, r.first_line) for r in found.collect())
    assert got == sorted(
        [("a", 7 * i) for i in range(100)] + [("b", i) for i in range(30)] + [("c", i) for i in range(100)]
    )
    reached = mining.reached_lines(remaining, 100).groupBy("leaf").count().collect()
    assert {r.leaf: r["count"] for r in reached}["a"] <= 107

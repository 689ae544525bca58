"""Running totals and row numbers over a whole table, without a global window.

A window without partitions would move every row through one task. Here rows are range
partitioned by the order column and written sorted; each split of the written files is one
window partition, and the totals of the splits before it, one row each, are added. That
holds for any order column without ties: dense, sparse or random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Workspace


def _sorted_splits(workspace: Workspace, ordered: DataFrame) -> DataFrame:
    """An ordered table written and read back, with the split each row comes from:
    ``_path`` (number of the sorted part, and of the file where a part rolls over) and
    ``_start``."""
    table = workspace.table(ordered, "sorted")
    name = F.col("_metadata.file_name")
    path = F.struct(
        F.regexp_extract(name, r"^part-(\d+)", 1).cast("bigint").alias("part"),
        F.regexp_extract(name, r"-c(\d+)\.", 1).cast("bigint").alias("file"),
    )
    return table.select("*", path.alias("_path"), F.col("_metadata.file_block_start").alias("_start"))


def running_sum(narrow: DataFrame, order: str, weight: Column, target: str) -> DataFrame:
    """Adds ``target``: the sum of ``weight`` over all rows with a smaller ``order``."""
    weighted = narrow.withColumn("_weight", weight.cast("bigint")).orderBy(order)
    rows = _sorted_splits(Workspace(narrow.sparkSession), weighted)
    before = W.orderBy("_path", "_start").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_path", "_start")
        .agg(F.sum("_weight").alias("_total"))
        .select("_path", "_start", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    )
    inside = W.partitionBy("_path", "_start").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(starts, ["_path", "_start"])
        .withColumn(
            target,
            F.col("_base") + F.coalesce(F.sum("_weight").over(inside), F.lit(0)),
        )
        .drop("_path", "_start", "_weight", "_base")
    )


def prefix_sum(df: DataFrame, order: str, weight: Column, target: str) -> DataFrame:
    """``running_sum`` for tables with wide rows: only key and weight are sorted; the rows
    themselves are joined by the unique key."""
    narrow = df.select(order, weight.alias("_value"))
    sums = running_sum(narrow, order, F.col("_value"), target)
    return join_narrow(df, sums.select(order, target), order)


def join_narrow(wide: DataFrame, narrow: DataFrame, key: str) -> DataFrame:
    """Joins a few columns to wide rows by a unique key. Tasks hash the narrow side; the
    wide rows are neither sorted nor taken for the side to broadcast, and keep their
    parallelism."""
    return wide.join(narrow.hint("shuffle_hash"), key)


def number_rows(df: DataFrame, order: str, target: str) -> DataFrame:
    """Adds ``target``: 1 for the row with the smallest ``order``, then 2, 3, ..."""
    return running_sum(df, order, F.lit(1), target).withColumn(target, F.col(target) + 1)


def with_previous(df: DataFrame, order: str, target: str, value: Column) -> DataFrame:
    """Adds ``target``: ``value`` of the row before, by a column without ties; null in the
    first row. The last row of each split is carried on to the split after it."""
    held = df.withColumn("_held", F.struct(value.alias("value"))).orderBy(order)
    rows = _sorted_splits(Workspace(df.sparkSession), held)
    ends = rows.groupBy("_path", "_start").agg(F.max_by("_held", order).alias("_end"))
    carried = ends.select("_path", "_start", F.lag("_end").over(W.orderBy("_path", "_start")).alias("_carried"))
    inside = W.partitionBy("_path", "_start").orderBy(order)
    return (
        rows.join(carried, ["_path", "_start"])
        .withColumn(target, F.coalesce(F.lag("_held").over(inside), F.col("_carried"))["value"])
        .drop("_path", "_start", "_held", "_carried")
    )


def spans(numbers: DataFrame, column: str, most: int, least_gap: int) -> list[tuple[int, int]]:
    """At most ``most`` ranges, in order, that hold every number of a column: all of it, cut
    at the widest gaps of ``least_gap`` and more. None for a table without numbers."""
    distinct = numbers.select(F.col(column).cast("bigint").alias("at")).filter("at IS NOT NULL").distinct()
    ends = distinct.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    if ends["low"] is None:
        return []
    gaps: list = []
    # one pass more only where there can be gaps worth cutting
    if ends["high"] - ends["low"] >= most * least_gap // 8:
        paired = with_previous(distinct, "at", "before", F.col("at")).select("before", "at")
        wide = paired.filter(F.col("at") - F.col("before") >= least_gap)
        gaps = sorted(tuple(r) for r in wide.orderBy(F.desc(F.col("at") - F.col("before")), "at").limit(most - 1).collect())
    lows = [ends["low"], *(after for _, after in gaps)]
    highs = [*(before for before, _ in gaps), ends["high"]]
    return list(zip(lows, highs))


def within(column: str, ranges: list[tuple[int, int]]) -> Column:
    """The number lies in one of the ranges, as a balanced tree of comparisons that the
    Parquet reader takes to skip row groups and pages."""
    if not ranges:
        return F.lit(False)
    if len(ranges) == 1:
        return F.col(column).between(*map(F.lit, ranges[0]))
    half = len(ranges) // 2
    return within(column, ranges[:half]) | within(column, ranges[half:])


def in_file_order(read: DataFrame, target: str, first: int = 1) -> DataFrame:
    """Numbers the rows of a file scan in the order (file, position in file).

    ``read`` carries ``_path`` and ``_start`` (file and first byte of the split). Rows of
    one split sit next to each other in one task, so the increasing id gives the place
    inside the split and only one row per split has to be summed up.
    """
    marked = read.withColumn("_id", F.monotonically_increasing_id())
    before = W.orderBy("_path", "_start").rowsBetween(W.unboundedPreceding, -1)
    splits = (
        marked.groupBy("_path", "_start")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return (
        marked.join(splits, ["_path", "_start"])
        .withColumn(target, F.col("_base") + F.col("_id") - F.col("_first") + first)
        .drop("_path", "_start", "_id", "_first", "_base")
    )


def number_written(workspace: Workspace, ordered: DataFrame, target: str) -> DataFrame:
    """Numbers the rows of an ordered table from 1: they are written in their order, then
    numbered in file order."""
    return in_file_order(_sorted_splits(workspace, ordered), target)


def number_sorted(workspace: Workspace, df: DataFrame, order: list[Column], target: str) -> DataFrame:
    """Row numbers by any sort order."""
    return number_written(workspace, df.orderBy(*order), target)

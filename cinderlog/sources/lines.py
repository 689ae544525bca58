"""Line sources: files of text or NDJSON, and tables with text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import let, split_breaks
from ..operators.numbering import in_file_order, prefix_sum

# Narrow rows of a scan that one task takes on.
ROWS_PER_TASK = 50_000


def split_lines(text: Column) -> Column:
    """Lines of a text; breaks at every line boundary Unicode knows, not only ``\\n``."""
    return let(F.make_valid_utf8(text), split_breaks)


def read_text(
    spark: SparkSession, paths: str | Sequence[str], unicode_breaks: bool = True
) -> DataFrame:
    """Text files as ``(source_name, line_no, raw)``.

    Bytes that are not UTF-8 are replaced. Lines are numbered from 1 through all files,
    in the order of their paths.
    """
    read = spark.read.text(list(paths) if not isinstance(paths, str) else paths).select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.make_valid_utf8("value").alias("raw"),
    )
    if unicode_breaks:
        read = read.withColumn("raw", F.explode_outer(split_lines(F.col("raw"))))
    numbered = in_file_order(read.withColumn("source_name", F.col("_path")), "line_no")
    return numbered.select("source_name", "line_no", "raw")


def spread(scan: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Spreads a scan with fewer splits than cores, such as one small or unsplittable file, or,
    if `rows_per_task` is given, with more rows a split: a small file can hold many narrow rows,
    and what is made of each is much work. Other scans are left as they are."""
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    if rows_per_task:
        wanted = max(wanted, -(-scan.count() // rows_per_task))
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan


def table_lines(df: DataFrame, text: str, order: str) -> DataFrame:
    """Texts of a table as lines ``(order, line_no, raw)``: the texts follow each other in
    the order of a unique whole-number column, numbered from 1."""
    # A text has at least one line, so the outer form gives the same rows; it spares the
    # split that Spark would add to drop empty lists at the scan.
    present = df.filter(F.col(text).isNotNull())
    split = present.select(order, split_lines(F.col(text)).alias("_lines"))
    counted = prefix_sum(split, order, F.size("_lines"), "_before")
    return counted.select(
        order, "_before", F.posexplode_outer("_lines").alias("_place", "raw")
    ).select(order, (F.col("_before") + F.col("_place") + 1).alias("line_no"), "raw")

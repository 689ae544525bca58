"""Time buckets, rates and growth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def bucket_seconds(span_seconds: Column) -> Column:
    """Bucket width for a span of seconds."""
    width = F.lit(fixed.WIDEST_BUCKET)
    for up_to, seconds in reversed(fixed.BUCKET_LADDER):
        width = F.when(span_seconds <= up_to, seconds).otherwise(width)
    return width.cast("bigint")


def analysis_window(bounds: DataFrame, empty_start: str = "1970-01-01") -> DataFrame:
    """One row: window bounds, bucket width, number of buckets, buckets that are recent.

    ``bounds`` has ``first_ts`` and ``last_ts`` (any number of rows: events or partial
    aggregates). Without rows the window is the moment ``empty_start``.
    """
    start = F.coalesce(F.min("first_ts"), F.lit(empty_start).cast("timestamp"))
    end = F.coalesce(F.max("last_ts"), F.lit(empty_start).cast("timestamp"))
    span = (F.unix_micros("window_end") - F.unix_micros("window_start")) / 1_000_000
    buckets = F.floor(F.greatest(span, F.col("bucket_seconds")) / F.col("bucket_seconds")) + 1
    return (
        bounds.agg(start.alias("window_start"), end.alias("window_end"))
        .withColumn("bucket_seconds", bucket_seconds(span))
        .withColumn("n_buckets", buckets.cast("int"))
        .withColumn("n_recent", recent_span(F.col("n_buckets")))
    )


def recent_span(n_buckets: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_buckets / fixed.RECENT_FRACTION).cast("int"))


@dataclass(frozen=True)
class Window:
    """The window's values as columns usable in any table, without a join."""

    start: Column
    seconds: Column
    buckets: Column
    recent: Column

    @classmethod
    def of(cls, window: DataFrame) -> Window:
        """As scalar subqueries of a plan that has not run yet."""
        row = window.select(F.struct("*")).scalar()
        return cls(row["window_start"], row["bucket_seconds"], row["n_buckets"], row["n_recent"])

    @classmethod
    def known(cls, window: DataFrame) -> Window:
        """As literals; runs the plan and fetches its one row."""
        row = window.withColumn("window_start", F.unix_micros("window_start")).first()
        return cls(
            F.timestamp_micros(F.lit(row["window_start"])),
            F.lit(row["bucket_seconds"]).cast("bigint"),
            F.lit(row["n_buckets"]),
            F.lit(row["n_recent"]),
        )


def bucket_index(ts: Column, window: Window) -> Column:
    """Bucket of a moment, counted from the window start and kept inside the window."""
    passed = F.unix_micros(ts) - F.unix_micros(window.start)
    place = F.floor(passed / (window.seconds * 1_000_000))
    return F.greatest(F.lit(0), F.least(window.buckets - 1, place)).cast("int")


def bucket_ts(index: Column, window: Window) -> Column:
    return F.timestamp_micros(
        F.unix_micros(window.start) + index * window.seconds * 1_000_000
    )


def sparse_counts(counted: DataFrame, key: str, window: Window) -> DataFrame:
    """``(key, filled, n_buckets)``: the buckets in which something happened, in order, and
    how many there are in all. Every other bucket counts zero.

    ``counted`` is ``(key, bucket_idx, events)``, any number of rows per bucket. A series
    takes as much room as it has filled buckets, however long the window is.
    """
    entry = F.struct("bucket_idx", F.col("events").cast("bigint").alias("events"))
    return (
        counted.groupBy(key, "bucket_idx")
        .agg(F.sum("events").alias("events"))
        .filter(F.col("events") != 0)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(entry)).alias("filled"))
        .withColumn("n_buckets", window.buckets)
    )


def dense(filled: Column, n_buckets: Column) -> Column:
    """One count per bucket, zeros included; for results that show every bucket."""

    def stretch(entry: Column, place: Column) -> Column:
        """The zeros before a filled bucket, then its count; linear over the whole row."""
        before = F.coalesce(F.get(filled, place - 1)["bucket_idx"], F.lit(-1))
        zeros = F.array_repeat(F.lit(0).cast("bigint"), entry["bucket_idx"] - before - 1)
        return F.concat(zeros, F.array(entry["events"]))

    last = F.coalesce(F.get(filled, F.size(filled) - 1)["bucket_idx"], F.lit(-1))
    zeros_after = F.array_repeat(F.lit(0).cast("bigint"), (n_buckets - 1 - last).cast("int"))
    return F.concat(F.flatten(F.transform(filled, stretch)), zeros_after)


def bucket_rows(series: DataFrame, key: str, window: Window) -> DataFrame:
    """Long form with every bucket: ``(key, bucket_idx, bucket_ts, events)``."""
    counts = dense(F.col("filled"), F.col("n_buckets"))
    return series.select(key, F.posexplode(counts).alias("bucket_idx", "events")).select(
        key, "bucket_idx", bucket_ts(F.col("bucket_idx"), window).alias("bucket_ts"), "events"
    )


def _events_from(filled: Column, start: Column) -> Column:
    """Events of the buckets from `start` on."""
    return F.aggregate(
        filled,
        F.lit(0).cast("bigint"),
        lambda total, e: total + F.when(e["bucket_idx"] >= start, e["events"]).otherwise(0),
    )


def growth(series: DataFrame) -> DataFrame:
    """Adds ``recent_count, baseline_rate, growth_pct`` from ``filled`` and ``n_buckets``."""
    n, filled = F.col("n_buckets"), F.col("filled")
    tail = recent_span(n)
    recent_rate = F.col("recent_count") / tail
    base = F.col("baseline_rate")
    raw = (recent_rate - base) / (base + fixed.EPSILON) * 100.0
    body = _events_from(filled, F.lit(0)) - F.col("recent_count")
    return (
        series.withColumn("recent_count", _events_from(filled, n - tail))
        .withColumn(
            "baseline_rate",
            F.when(n > tail, body / F.greatest(n - tail, F.lit(1))).otherwise(recent_rate),
        )
        .withColumn(
            "growth_pct", F.greatest(F.lit(fixed.MIN_GROWTH), F.least(F.lit(fixed.MAX_GROWTH), raw))
        )
    )

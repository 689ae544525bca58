"""Robust spike detection over the bucket counts of a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .frequency import recent_span


def threshold(sensitivity: float) -> float:
    return fixed.THRESHOLD_AT_ZERO - min(max(sensitivity, 0.0), 1.0) * fixed.THRESHOLD_SLOPE


def _middle(n: Column, at) -> Column:
    """Exact median of n values, `at(k)` being the k-th smallest from 0."""
    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 0, (at(half - 1) + at(half)) / 2.0).otherwise(at(half).cast("double"))


def median(events: Column, n: Column) -> Column:
    """Exact median of a series of n buckets, given the sorted counts of the filled ones:
    the empty ones come first, all zero."""
    zeros = n - F.size(events)
    return _middle(n, lambda k: F.when(k < zeros, 0).otherwise(F.get(events, k - zeros)))


def deviation(deviations: Column, center: Column, n: Column) -> Column:
    """Exact median deviation, given the sorted deviations of the filled buckets: those of the
    empty ones all equal the center, and come between the smaller and the larger ones."""
    below = F.size(F.filter(deviations, lambda d: d < center))
    zeros = n - F.size(deviations)
    return _middle(
        n,
        lambda k: F.when(k < below, F.get(deviations, k))
        .when(k < below + zeros, center)
        .otherwise(F.get(deviations, k - zeros)),
    )


def score(series: DataFrame, sensitivity: float = fixed.DEFAULT_SENSITIVITY) -> DataFrame:
    """Adds the working columns ``center, scale, effective_threshold, peak_idx, peak_count``
    and the results ``zscore, anomaly_score, peak_is_recent, is_anomaly``.

    All of it follows from the filled buckets and the number of empty ones.
    """
    base = threshold(sensitivity)
    softness = max(1.0, base / 2.0)
    n, filled = F.col("n_buckets"), F.col("filled")
    center = F.col("center")
    deviations = F.array_sort(F.transform("_events", lambda c: F.abs(c - F.col("center"))))
    z, bar, peak = F.col("zscore"), F.col("effective_threshold"), F.col("peak_count")
    # buckets are in order, so the first with the highest count is the first peak
    at_peak = F.get(F.filter(filled, lambda e: e["events"] == F.col("peak_count")), F.lit(0))
    return (
        series.withColumn("_events", F.array_sort(F.transform(filled, lambda e: e["events"])))
        .withColumn("center", median(F.col("_events"), n))
        .withColumn("mad", deviation(deviations, center, n))
        .withColumn(
            "scale",
            F.greatest(
                fixed.MAD_TO_SIGMA * F.col("mad"),
                F.sqrt(F.greatest(center, F.lit(1.0))),
                F.lit(1.0),
            ),
        )
        .drop("mad")
        .withColumn(
            "effective_threshold", base + F.sqrt(2.0 * F.log(F.greatest(n, F.lit(2)).cast("double")))
        )
        .withColumn("peak_count", F.coalesce(F.array_max("_events"), F.lit(0).cast("bigint")))
        .withColumn("peak_idx", F.coalesce(at_peak["bucket_idx"], F.lit(0)).cast("int"))
        .drop("_events")
        .withColumn("zscore", F.least(F.lit(fixed.MAX_Z), (peak - center) / F.col("scale")))
        .withColumn("anomaly_score", 1.0 / (1.0 + F.exp(-(z - bar) / softness)))
        .withColumn("peak_is_recent", F.col("peak_idx") >= n - recent_span(n))
        .withColumn(
            "is_anomaly",
            (z >= bar)
            & (peak >= fixed.MIN_PEAK_EVENTS)
            & ((center < fixed.EPSILON) | (peak >= center * fixed.MIN_PEAK_RATIO)),
        )
    )



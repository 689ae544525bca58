"""Numbers and durations as shown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimals(value: Column, places: int) -> Column:
    """Fixed decimals, halves to even, no thousands separators."""
    shape = "0." + "0" * places if places else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(shape))


def signed(value: Column) -> Column:
    """No decimals, always with a sign."""
    text = decimals(value, 0)
    return F.when(F.startswith(text, F.lit("-")), text).otherwise(F.concat(F.lit("+"), text))


def count_text(value: Column) -> Column:
    """``950``, ``1.2K``, ``3.4M``."""
    return (
        F.when(value >= 1_000_000, F.concat(decimals(value / 1_000_000, 1), F.lit("M")))
        .when(value >= 1_000, F.concat(decimals(value / 1_000, 1), F.lit("K")))
        .otherwise(value.cast("bigint").cast("string"))
    )


def duration_text(seconds: Column) -> Column:
    """``42m`` or ``1.5h``."""
    minutes = seconds / 60.0
    return F.when(minutes >= 60, F.concat(decimals(minutes / 60.0, 1), F.lit("h"))).otherwise(
        F.concat(decimals(F.greatest(minutes, F.lit(0.0)), 0), F.lit("m"))
    )


def growth_text(growth_pct: Column, baseline_rate: Column) -> Column:
    """``NEW``, ``▲ 9999%+`` or an arrow and the rounded percentage."""
    off_scale = growth_pct >= 9990
    arrow = F.when(growth_pct > 0, "▲").when(growth_pct < 0, "▼").otherwise("")
    percent = F.abs(half_up(growth_pct)).cast("string")
    return (
        F.when((baseline_rate < 1e-6) & off_scale, "NEW")
        .when(off_scale, "▲ 9999%+")
        .otherwise(F.concat(arrow, F.lit(" "), percent, F.lit("%")))
    )


def half_up(value: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(value + 0.5).cast("bigint")


def plural(n: Column) -> Column:
    return F.when(n != 1, "s").otherwise("")

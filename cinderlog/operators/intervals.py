"""Joins on nearness in time.

Time is cut into ranges as wide as the interval. A left row lies in one range, a right row
is copied to the ranges whose rows it can be near to, and inside a range both sides are
swept in order of time: a row meets exactly the rows of its interval. Ranges with many rows
are split on both sides, each part of the left meeting each part of the right, so that a
storm of rows in one moment spreads over tasks and no task makes more than
`LEFT_ROWS * RIGHT_ROWS` pairs for a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT_ROWS, RIGHT_ROWS = 1_000, 2_000

_CELL = ["_range", "_key", "_i", "_j"]


def _spread(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def _near(left_at, right_at, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs, swept in the order of the right side."""
    order = np.argsort(right_at, kind="stable")
    ordered = right_at[order]
    first = np.searchsorted(ordered, left_at + low, "left")
    last = np.searchsorted(ordered, left_at + high, "right")
    count = last - first
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.arange(len(left_at)), count), order[np.repeat(first, count) + within]


def _sweep(low: int, high: int, apart: bool):
    def sweep(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = pd.concat([t.select(_CELL).to_pandas() for t in (left, right)])
        number = cells.groupby(_CELL, dropna=False, sort=False).ngroup().to_numpy()
        sides = [number[: left.num_rows], number[left.num_rows :]]
        at = [t.column("_at").to_numpy() for t in (left, right)]
        if apart:
            names = pd.concat([t.column("_apart").to_pandas() for t in (left, right)])
            group = pd.factorize(names, use_na_sentinel=False)[0]
        else:
            group = np.zeros(len(cells), np.int64)
        groups = [group[: left.num_rows], group[left.num_rows :]]
        taken = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        parts = [
            pd.DataFrame({"cell": c, "group": g}).groupby(["cell", "group"]).indices
            for c, g in zip(sides, groups)
        ]
        right_parts: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (cell, name), rows in parts[1].items():
            right_parts.setdefault(cell, []).append((name, rows))
        for (cell, name), rows in parts[0].items():
            for other, others in right_parts.get(cell, ()):
                if apart and other == name:
                    continue
                a, b = _near(at[0][rows], at[1][others], low, high)
                taken[0].append(rows[a])
                taken[1].append(others[b])
        columns = {}
        for table, rows in zip((left, right), taken):
            picked = table.take(pa.array(np.concatenate(rows)))
            columns |= {n: picked.column(n) for n in table.column_names if not n.startswith("_")}
        return pa.table(columns)

    return sweep


def interval_join(
    left: DataFrame,
    right: DataFrame,
    at: tuple[str, str],
    low: int,
    high: int,
    on: tuple[str, str] | None = None,
    apart: tuple[str, str] | None = None,
    left_rows: int = LEFT_ROWS,
    right_rows: int = RIGHT_ROWS,
) -> DataFrame:
    """Pairs of rows whose whole numbers ``at`` differ by `low` to `high` (right less left).

    ``on`` names columns that must be equal (null equals nothing), ``apart`` columns that
    must differ (null is a value like others): rows that agree there are never paired. All names
    differ between the sides and none begins with an underscore. Rows without ``at`` have no pairs.
    """
    width = max(high - low, 1)

    def side(df: DataFrame, k: int) -> DataFrame:
        key = F.col(on[k]) if on else F.lit("")
        return df.select(
            *df.columns,
            F.col(at[k]).cast("bigint").alias("_at"),
            key.cast("string").alias("_key"),
            (F.col(apart[k]) if apart else F.lit("")).cast("string").alias("_apart"),
        ).filter(F.col("_at").isNotNull() & F.col("_key").isNotNull())

    def place(value: Column) -> Column:
        return F.floor(value / width).cast("bigint")

    a = side(left, 0).withColumn("_range", place(F.col("_at")))
    reach = F.sequence(place(F.col("_at") - high), place(F.col("_at") - low))
    b = side(right, 1).withColumn("_range", F.explode(reach))
    sizes = (
        a.groupBy("_range", "_key").agg(F.count("*").alias("_n")).join(
            b.groupBy("_range", "_key").agg(F.count("*").alias("_m")), ["_range", "_key"]
        )
    ).select(
        "_range",
        "_key",
        F.ceil(F.col("_n") / left_rows).cast("int").alias("_is"),
        F.ceil(F.col("_m") / right_rows).cast("int").alias("_js"),
    )
    split = F.col("_is") * F.col("_js") > 1
    # ranges met by both sides; small ones share a task up to the limit
    buckets = left.count() // left_rows + 1
    cell = F.xxhash64("_range", "_key", "_i", "_j")
    group = F.when(split, cell).otherwise(F.pmod(cell, F.lit(buckets)))

    def dealt(df: DataFrame, own: str, of: str, other: str, others: str) -> DataFrame:
        # by the row's values, so that a task that runs again deals alike
        drawn = F.xxhash64(F.lit("part"), *[c for c in df.columns if not c.startswith("_")])
        met = df.join(sizes, ["_range", "_key"]).withColumn(own, F.pmod(drawn, F.col(of)).cast("int"))
        return met.withColumn(other, _spread(F.col(others))).withColumn("_group", group).drop("_is", "_js")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for d in (left, right) for f in d.schema)
    b = dealt(b, "_j", "_js", "_i", "_is")
    return (
        dealt(a, "_i", "_is", "_j", "_js")
        .groupBy("_group")
        .cogroup(b.withColumnRenamed("_group", "_met").groupBy("_met"))
        .applyInArrow(_sweep(low, high, apart is not None), schema)
    )

"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinderlog.llm.common import Scratch


def components(edges: DataFrame, work: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge, and the smallest node it can reach.

    Each round first links the larger neighbours of a node to the smallest node next to it,
    then the smaller ones, which halves the distances; rounds end when nothing changes.
    Every round is written to the shared folder; the driver sees one count and one sum.
    Nodes are long numbers; edges of a node to itself are ignored.
    """
    now = work.table(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(),
        "edges",
    )
    before = None
    while True:
        # large star: neighbours above u go to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u > v")
            .distinct()
        )
        # small star: smaller neighbours of u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u > v")
            .distinct()
        )
        now = work.table(small, "edges")
        state = now.agg(
            F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.count_distinct("u")
        ).first()
        if before == state or state[0] == state[2] and _is_star(now):
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_star(edges: DataFrame) -> bool:
    """No centre is itself linked to a smaller node."""
    return edges.select("v").distinct().join(edges.select("u"), F.col("v") == F.col("u")).isEmpty()

"""Substring search over incidents through an index of trigrams.

Stored incidents lie in blocks by rank, a folder each; the index holds every trigram of
the searched texts once per block. A text can hold the needle only if its block holds all
trigrams of the needle, so the others are never opened (partitions are pruned while the
query runs); in the blocks that are left, the texts themselves decide. Needles of fewer
than three characters have no trigram and are looked for in all blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCHED = ("title", "service", "incident_id", "cluster_id")


def joined_text() -> Column:
    """The searched fields as they are shown side by side."""
    return F.concat_ws(" ", "incident_id", "title", F.coalesce("service", F.lit("")), "cluster_id")


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; none of a shorter or null text."""
    found = F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def gram_rows(incidents: DataFrame) -> DataFrame:
    """``(gram, block)`` of the incidents, each field by itself and all of them joined; sorted,
    so that a lookup skips the row groups of other trigrams."""
    texts = F.array(joined_text(), *SEARCHED)
    grams = F.flatten(F.transform(texts, lambda text: trigrams(F.lower(text))))
    rows = incidents.select("block", F.explode(F.array_distinct(grams)).alias("gram")).distinct()
    return rows.select("gram", "block").orderBy("gram", "block")


def may_hold(incidents: DataFrame, grams: DataFrame, needle: str) -> DataFrame:
    """The incidents of the blocks in which all trigrams of the needle occur."""
    wanted = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    if not wanted:
        return incidents
    blocks = (
        grams.filter(F.col("gram").isin(wanted))
        .groupBy("block")
        .agg(F.count("*").alias("met"))
        .filter(F.col("met") == len(wanted))
        .select("block")
    )
    # one row per block, and a block has 65,536 incidents
    return incidents.join(F.broadcast(blocks), "block", "left_semi")

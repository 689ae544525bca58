"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir), docs being all rows its predecessor kept, and
returns a DataFrame. All stages but the last return the columns of `documents`. As docs is
written before a stage begins, the stage first drops what its predecessors left in the
shared folder.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderlog.llm import decontamination, line_dedup, minhash, packing, quality, toxicity
from cinderlog.llm.common import Scratch, free_name, join_on, table
from cinderlog.session import shared_folder


#: Roots of the scratch tables of the stage before, per thread.
_left: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def _stage(function):
    """Drops what the stage before left, and notes what this one leaves."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        Scratch.drop(spark, list(_left.get()))
        _left.set(())
        with Scratch.noting() as roots:
            out = function(spark, docs, sf_dir)
        _left.set(tuple(roots))
        return out

    return run_stage


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier doesn't reject."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "_quality")
    return quality.score(docs, model, out_col=name).where(F.col(name) >= 0.5).drop(name)


@_stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, without the lines that repeat, nearly, an earlier line
    of one of them.

    Toxic documents go before their lines can stand for those of others. A document whose text had a character that isn't white space, and now has none, goes.
    """
    marks = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    docs = docs.where(toxicity.probability(marks) < 0.5)
    before = free_name(docs, "_before")
    less = line_dedup.dedup_lines(docs.withColumn(before, F.col("text")), least_equal=line_dedup.LEAST_EQUAL)
    full = lambda name: F.coalesce(F.col(name).rlike(r"\S"), F.lit(False))
    return (
        less.where(full("text") | ~full(before))
        .drop(before)
        .withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    )


@_stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, on five-word shingles."""
    found = minhash.near_duplicates(docs, shingle_words=5, per_cent=80)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_stage
def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than a twentieth of benchmark text."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    key = free_name(docs, "_row_key")
    gone = found.where(decontamination.is_contaminated()).select("doc_id", F.col("row_key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    return join_on(keyed, gone, ["doc_id", key], "left_anti").select(*docs.columns)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in sequences of at most 1024 tokens, with the token ids."""
    return packing.pack(docs, all_ids=True)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]

#: Training and tokens can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet and read again by the next."""
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs

"""Exact histogram of encoded lengths, and the suffix sums every context limit needs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cinderlog.llm.common import SLICE, Scratch, table, texts
from cinderlog.llm.tokens import encoder, public_tokenizer

#: Lengths per block of the two-level sums.
BLOCK = 1024
#: Context limits and quantiles the query answers.
LIMITS = (128, 256, 512, 1024, 2048, 4096, 8192, 16_384, 32_768, 65_536, 131_072)
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


def length_histogram(
    df: DataFrame,
    text_col: str = "text",
    tokenizer: str | None = None,
) -> DataFrame:
    """(n_tokens, n_docs): documents by the exact number of tokens of their whole text.

    Tasks count their own documents first, so at most one row per task and length is
    shuffled. Null and empty texts have 0 tokens; repeated rows count each time; an empty
    table gives no rows; columns other than the text are not read.
    """
    path = tokenizer or public_tokenizer()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen = encoder(path), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                seen.update(len(code.ids(x)) for x in texts(batch.column(0).slice(at, SLICE)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())],
            ["n_tokens", "n_docs"],
        )

    found = df.select(text_col).mapInArrow(work, "n_tokens long, n_docs long")
    return found.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length n: n_tokens, n_docs, docs_ge, tokens_ge, docs_below, tokens_below,
    truncated_tokens.

    docs_ge and tokens_ge count the documents of at least n tokens and their tokens;
    truncated_tokens is what remains of the corpus when every document is cut at n tokens.
    Between two lengths of the table nothing changes but the limit itself, so
    `truncated_totals` answers every limit from it.

    The sums run within blocks of lengths, and over one total per block.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs")
    )
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block"))
    below = Window.orderBy("block")
    totals = totals.select(
        "block",
        (F.sum("d").over(above) - F.col("d")).alias("d_above"),
        (F.sum("t").over(above) - F.col("t")).alias("t_above"),
        (F.sum("d").over(below) - F.col("d")).alias("d_below"),
        (F.sum("t").over(below) - F.col("t")).alias("t_below"),
    )
    up = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    down = Window.partitionBy("block").orderBy("n_tokens")
    return (
        rows.withColumn("d_up", F.sum("n_docs").over(up))
        .withColumn("t_up", F.sum("tokens").over(up))
        .withColumn("d_down", F.sum("n_docs").over(down) - F.col("n_docs"))
        .withColumn("t_down", F.sum("tokens").over(down) - F.col("tokens"))
        .join(totals, "block")
        .select(
            "n_tokens",
            "n_docs",
            (F.col("d_up") + F.col("d_above")).alias("docs_ge"),
            (F.col("t_up") + F.col("t_above")).alias("tokens_ge"),
            (F.col("d_down") + F.col("d_below")).alias("docs_below"),
            (F.col("t_down") + F.col("t_below")).alias("tokens_below"),
        )
        .withColumn(
            "truncated_tokens", F.col("tokens_below") + F.col("n_tokens") * F.col("docs_ge")
        )
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, tokens): tokens of the corpus with every document cut at the limit.

    The first length at or above a limit tells how many documents are cut; beyond the
    longest document nothing is.
    """
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    low = F.when(F.col("n_tokens") < F.col("limit"), F.col("n_tokens") * F.col("n_docs"))
    many = F.when(F.col("n_tokens") >= F.col("limit"), F.col("n_docs"))
    return (
        F.broadcast(asked)
        .join(sums, F.lit(True), "left")
        .groupBy("limit")
        .agg(
            (
                F.coalesce(F.sum(low), F.lit(0))
                + F.col("limit") * F.coalesce(F.sum(many), F.lit(0))
            ).alias("tokens")
        )
    )


def quantiles(sums: DataFrame, at: Sequence[float]) -> DataFrame:
    """(q, n_tokens): the smallest length that at least the share q of documents stays within."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in at], "q double")
    share = (F.col("docs_below") + F.col("n_docs")) / (F.col("docs_below") + F.col("docs_ge"))
    return (
        F.broadcast(asked)
        .join(sums.withColumn("share", share), F.col("share") >= F.col("q"))
        .groupBy("q")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )


def with_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """The histogram with a row for every limit, of no documents where none has that length,
    so that the sums over it answer the limits too. An empty table has rows for the limits
    alone; a limit that is named twice has one row."""
    asked = histogram.sparkSession.createDataFrame([(int(x), 0) for x in limits], "n_tokens long, n_docs long")
    return histogram.unionByName(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_quantiles(sums: DataFrame, at: Sequence[float]) -> DataFrame:
    """One more column `quantiles`: the shares, joined by commas, of which this is the smallest
    length that at least so many of the documents stay within; mostly empty."""
    total = F.col("docs_below") + F.col("docs_ge")
    below, upto = F.col("docs_below") / total, (F.col("docs_below") + F.col("n_docs")) / total
    here = [F.when((below < q) & (upto >= q), F.lit(str(q))) for q in at]
    return sums.withColumn("quantiles", F.when(total > 0, F.concat_ws(",", *here)).otherwise(""))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums, at the lengths that occur
    and at the usual context limits, and the quantiles."""
    # written, as the sums read it twice and no text should be encoded twice
    histogram = Scratch(spark, "token-counts").table(length_histogram(table(spark, sf_dir, "documents")), "histogram")
    counted = with_limits(histogram, LIMITS)
    return with_quantiles(suffix_sums(counted), QUANTILES).withColumn("is_limit", F.col("n_tokens").isin(*LIMITS))

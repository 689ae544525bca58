"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every k words of a text are hashed; of every `SPAN - K + 1` neighbouring hashes the
smallest is kept. Two texts that share `SPAN` words share all hashes of that window and so
its smallest: no shared span of that length is missed. Fingerprints of documents are
joined with those of benchmark items; in documents with a hit, the windows whose own
fingerprint was hit are extended to their whole span and compared word by word.

Items shorter than the span are one window of their own length; their whole hash is the
fingerprint, and the documents' windows of each such length that occurs are hashed too.

Fingerprints use words in full lower case, which only joins more; the comparison itself
lower-cases A-Z alone, as the words are defined.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinderlog.llm.common import Scratch, join_on, table

SPAN, K = 13, 5
#: What stands between words: ASCII characters other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def exact_words(text: str) -> Column:
    """The words, A-Z lower-cased and nothing else."""
    return _split(
        F.translate(
            F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase
        )
    )


def _starts(n: Column, width: int) -> Column:
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(
        F.array().cast("array<int>")
    )


def window_marks(words: Column, width: int, span: int = SPAN, k: int = K) -> Column:
    """For each window of `width` words, its fingerprint: by winnowing if it is a span."""

    def winnow(h: Column) -> Column:
        grams = F.transform(
            _starts(F.size(h), k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
        )
        return let(
            grams,
            lambda g: F.transform(
                _starts(F.size(g), span - k + 1), lambda i: F.array_min(F.slice(g, i + 1, span - k + 1))
            ),
        )

    def whole(h: Column) -> Column:
        return F.transform(
            _starts(F.size(h), width),
            lambda i: F.xxhash64(F.lit(width), *[F.get(h, i + j) for j in range(width)]),
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, winnow if width == span else whole)


def _all_marks(words: Column, widths: list[int], span: int, k: int) -> Column:
    return let(
        words,
        lambda w: F.array_distinct(F.concat(*[window_marks(w, n, span, k) for n in widths])),
    )


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    k: int = K,
) -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, item_ids, n_items): one row per row of the table.

    A document word is hit if it lies inside an occurrence of a window of an item: `span`
    consecutive words, or all words of a shorter item. `item_ids` are the distinct ids of
    those items as sorted strings; an item with a null id hits words but isn't listed.
    `row_key` is a hash of id and text; (doc_id, row_key) tells rows apart.

    Null and empty texts have no words and no hits, items without words no windows. Rows
    that repeat get the same result each. Empty tables give no rows, or no hits. Other
    columns of either table are not read.
    """
    work = Scratch(df.sparkSession, "winnow")
    items = work.table(
        benchmark.select(
            F.col(item_id_col).cast("string").alias("item_id"),
            exact_words(item_text_col).alias("words"),
        )
        .where(F.size("words") > 0)
        .withColumn("width", F.least(F.size("words"), F.lit(span))),
        "items",
    )
    # at most `span` numbers
    widths = sorted({r["width"] for r in items.select("width").distinct().collect()})
    marks = None
    windows = None
    for n in widths:
        some = items.where(F.col("width") == n)
        mark = some.select(F.explode(window_marks(F.col("words"), n, span, k)).alias("mark"))
        window = some.select(
            "item_id",
            F.explode(
                F.transform(
                    _starts(F.size("words"), n),
                    lambda i: F.array_join(F.slice("words", i + 1, n), " "),
                )
            ).alias("gram"),
        )
        marks = mark if marks is None else marks.unionByName(mark)
        windows = window if windows is None else windows.unionByName(window)

    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"),
    )
    if not widths:
        return rows.select(
            "doc_id",
            "row_key",
            F.size(exact_words("text")).cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"),
            F.array().cast("array<string>").alias("item_ids"),
            F.lit(0).cast("long").alias("n_items"),
        )
    marks = work.table(marks.distinct(), "marks")
    windows = work.table(windows.distinct(), "windows")

    key = ["doc_id", "row_key"]
    prints = work.table(
        rows.select(
            "doc_id",
            "row_key",
            let(
                exact_words("text"),
                lambda w: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    _all_marks(w, widths, span, k).alias("marks"),
                ),
            ).alias("p"),
        ).select("doc_id", "row_key", "p.n_words", "p.marks"),
        "prints",
    )
    hits = work.table(
        prints.select("doc_id", "row_key", F.explode("marks").alias("mark"))
        .join(marks, "mark")
        .groupBy(*key)
        .agg(F.collect_set("mark").alias("hits")),
        "hits",
    )

    # the windows of documents with hits whose own fingerprint was hit, word by word
    def extended(n: int) -> Column:
        at = let(
            window_marks(F.col("words"), n, span, k),
            lambda m: F.filter(
                _starts(F.size(F.col("words")), n),
                lambda i: F.array_contains(F.col("hits"), F.get(m, i)),
            ),
        )
        return F.transform(
            at,
            lambda i: F.struct(
                i.alias("start"),
                F.lit(n).alias("width"),
                F.array_join(F.slice("words", i + 1, n), " ").alias("gram"),
            ),
        )

    held = (
        join_on(rows, hits, key)
        .dropDuplicates(key)
        .select(*key, "hits", exact_words("text").alias("words"))
    )
    found = (
        held.select(*key, F.explode(F.concat(*[extended(n) for n in widths])).alias("w"))
        .select(*key, "w.*")
        .join(windows, "gram")
        .groupBy(*key)
        .agg(
            F.array_sort(F.collect_set(F.struct("start", "width"))).alias("spans"),
            F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["width"] - F.greatest(acc["end"], s["start"]))).alias("n"),
            F.greatest(acc["end"], s["start"] + s["width"]).alias("end"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    found = found.select(*key, covered.alias("n_hit"), "item_ids")
    return (
        join_on(prints.drop("marks"), found, key, "left")
        .select(
            "doc_id",
            "row_key",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
        .withColumn("n_items", F.size("item_ids").cast("long"))
    )


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of all documents against all benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s
        FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), m AS (
  SELECT r, s, dw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.gram = iw.gram
), c AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM m)) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM m) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

"""Toxic documents by the words that mark them, in DataFrame functions only.

Words count by their stem, the first letters. From the labels: a stem, in a document once
or twice, or there more often, is a mark if such documents are toxic more often than chance
allows, by a likelihood-ratio test whose level is divided by the number of cases tried. Each
mark weighs the logarithm of how much likelier it is in a toxic document. The whole text of
every document is searched for the marks, and the strongest one found is added to the
log-odds of a toxic label: the others are mostly part of it or come with it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from cinderlog.llm.decontamination import let

#: Most labelled rows the words are counted in.
LABELLED = 40_000
#: Marks expected by chance, over all that are tried.
BY_CHANCE = 0.1
#: Letters of a stem.
STEM = 6
#: From how many occurrences a stem counts as frequent in a document, and how it is written then.
OFTEN, SIGN = 3, "+"


@dataclass
class Marks:
    """Weights of the marks, and the log-odds of a toxic label without any."""

    weights: dict[str, float] = field(default_factory=dict)
    prior: float = -math.inf


def stems(text: Column) -> Column:
    """The stems of all words of a text, in lower case; null counts as empty."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.transform(words, lambda w: F.substring(w, 1, STEM))


def cases(text: Column) -> Column:
    """The distinct stems of a text, with the sign if it has the stem often."""

    def of(all_: Column) -> Column:
        often = F.array_distinct(
            F.filter(all_, lambda w, i: w.eqNullSafe(F.get(all_, i + (OFTEN - 1))))
        )
        return F.concat(F.array_except(all_, often), F.transform(often, lambda w: F.concat(w, F.lit(SIGN))))

    return let(F.sort_array(stems(text)), of)


def _evidence(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """The likelihood ratio (G) of a case in `a` of the toxic and `b` of the clean documents."""

    def part(seen: Column, of: int, share: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(0.0)

    share = (a + b) / (toxic + clean)
    return 2 * (
        part(a, toxic, share) + part(b, clean, share) + part(toxic - a, toxic, 1 - share) + part(clean - b, clean, 1 - share)
    )


def learn(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    labelled: int = LABELLED,
) -> Marks:
    """The marks of toxic documents, from a sample of about `labelled` labelled rows at most.

    Labels are read as those of the quality: the majority counts; a tie, a null label and
    a null id are no label. Without labels of both kinds there are no marks and no document
    is toxic.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_known"))
        .agg(F.avg(F.col(label_col).cast("double")).alias("_y"))
        .where("_y <> 0.5")
        .select("_known", (F.col("_y") > 0.5).alias("_y"))
    )
    count = known.count()
    if count > labelled:
        draw = F.pmod(F.xxhash64("_known", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
        known = known.where(draw < labelled / count)
    # at most about `labelled` rows of an id and a bit, so no text is shuffled
    told = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(known), F.col("_id") == F.col("_known")
    )
    sizes = {r["_y"]: r["count"] for r in told.groupBy("_y").count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Marks()
    holding = lambda kind: (
        told.where(F.col("_y") == kind)
        .select(F.explode(cases(F.col("_text"))).alias("word"))
        .where(~F.col("word").isin("", SIGN))
        .groupBy("word")
        .agg(F.count("*").alias("docs"))
    )
    in_toxic = holding(True).withColumnRenamed("docs", "a")
    tried = max(1, in_toxic.count())
    least = 2 * math.log(tried / BY_CHANCE)
    # a case in fewer toxic documents can't reach this, whatever the clean ones hold
    fewest = max(2.0, least / (2 * math.log((toxic + clean) / toxic) + 2))
    found = (
        in_toxic.where(F.col("a") >= fewest)
        .join(holding(False).withColumnRenamed("docs", "b"), "word", "left")
        .na.fill(0, ["b"])
        .where(F.col("a") * clean > F.col("b") * toxic)
        .withColumn("evidence", _evidence(F.col("a"), F.col("b"), toxic, clean))
        .where(F.col("evidence") >= least)
        .orderBy(F.desc("evidence"), "word")
        .collect()  # cases of at most about `labelled` documents
    )
    weight = lambda r: math.log((r["a"] + 0.5) / (toxic + 1)) - math.log((r["b"] + 0.5) / (clean + 1))
    return Marks({r["word"]: weight(r) for r in found}, math.log(toxic / clean))


def probability(marks: Marks, text_col: str = "text") -> Column:
    """The probability that a document is toxic; 0 for one without marks."""
    if not marks.weights:
        return F.lit(0.0)
    names = F.array(*[F.lit(w) for w in sorted({w.removesuffix(SIGN) for w in marks.weights})])
    weights = F.map_from_arrays(
        F.array(*[F.lit(w) for w in marks.weights]), F.array(*[F.lit(x) for x in marks.weights.values()])
    )

    def of(all_: Column) -> Column:
        def weight(w: Column) -> Column:
            often = F.size(all_) - F.size(F.array_remove(all_, w)) >= OFTEN
            return F.coalesce(F.element_at(weights, F.when(often, F.concat(w, F.lit(SIGN))).otherwise(w)), F.lit(0.0))

        strongest = F.array_max(F.transform(F.array_intersect(all_, names), weight))
        return F.when(strongest > 0, 1 / (1 + F.exp(-marks.prior - strongest))).otherwise(0.0)

    return let(stems(F.col(text_col)), of)

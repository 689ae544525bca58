"""Quality of documents by co-training a text view and a metadata view.

The text view sees only what a text looks like (symbols, capitals, repetition, words and
lines); the metadata view only the columns beside it. Both are logistic regressions. They
start from a bounded sample of the labelled rows. Then, in rounds, every document one view
is confident about becomes, with half the weight of a labelled row, a training row of the
other view; confidence is judged after calibration on labelled rows kept apart. At the end
both calibrated views are combined by a third regression on those rows, and all documents
are scored.

Rounds run over all documents: each step of Newton's method is one pass over the written
features, in which tasks send on sums whose size is the square of the number of features.

Neither view sees a word. Toxic documents, which mostly are good ones otherwise, are found
apart, by `toxicity`; a document's score is the lower of the probabilities that it is good
and that it isn't toxic.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cinderlog.llm import toxicity
from cinderlog.llm.common import free_name, in_slices, Scratch, table

#: Most labelled rows to start from, and most to calibrate on.
LABELLED, APART = 40_000, 10_000
ROUNDS, STEPS = 2, 3
#: A view teaches the other where its calibrated probability is this close to 0 or 1.
CONFIDENT, WEIGHT = 0.97, 0.5
RIDGE = 1e-3
#: Buckets for the values of each text column of the metadata.
VALUES = 16

_MARKS = re.compile(rb"[#$%&*<>{}\\^~@=_]+")


def text_features(text: str | None) -> list[float]:
    """What a whole text looks like; null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.strip()]
    many, chars = max(1, len(words)), max(1, n)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = by[65:91].sum() + by[97:123].sum() + by[128:].sum()
    digits = by[48:58].sum()
    spaces = by[32] + by[9:14].sum()
    seen = Counter(words)
    common = max(seen.values(), default=0)
    share = lambda x, of: math.log(0.002 + x / of)
    return [
        math.log1p(len(words)),
        share(n - letters - digits - spaces, chars),
        share(by[65:91].sum(), chars),
        share(digits, chars),
        share(by[33], many),
        share(by[124], many),
        share(len(_MARKS.findall(raw)), many),
        share(by[46], many),
        share(by[44], many),
        math.log1p(len(seen)) / math.log1p(many),
        share(sum(map(eq, words, words[1:])), many),
        share(common, many),
        math.log(sum(map(len, words)) / many + 0.1),
        share(len(lines) - len(set(lines)), max(1, len(lines))),
        math.log1p(n / max(1, len(lines))),
    ]


TEXT_SIZE = len(text_features(""))


def meta_features(values: Sequence) -> list[float]:
    """Numbers as their logarithm and whether they are there; other values by hash bucket."""
    out: list[float] = []
    for value, is_number in values:
        if is_number:
            good = value is not None and math.isfinite(float(value))
            out += [math.copysign(math.log1p(abs(float(value))), float(value)) if good else 0.0, float(good)]
        else:
            one = [0.0] * VALUES
            if value is not None:
                one[zlib.crc32(str(value).encode("utf-8", "replace")) % VALUES] = 1.0
            out += one
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def newton_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the weighted log-likelihood, over rows of x with a 1 at the end."""
    p = _sigmoid(x @ beta)
    return x.T @ (weight * (y - p)), (x * (weight * p * (1 - p))[:, None]).T @ x


def newton_step(beta: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    ridge = np.eye(len(beta)) * RIDGE * max(1.0, curvature[-1, -1])
    ridge[-1, -1] = 1e-9
    step = np.linalg.solve(curvature + ridge + 1e-9 * np.eye(len(beta)), gradient - ridge @ beta)
    size = np.abs(step).max()
    return beta + step * min(1.0, 5.0 / size if size else 1.0)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 12) -> np.ndarray:
    x = _with_one(x)
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        beta = newton_step(beta, *newton_sums(x, y, np.ones(len(y)), beta))
    return beta


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b): a * margin + b is the log-odds, with Platt's targets short of 0 and 1."""
    good, bad = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    beta = fit(margin[:, None], target)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (0.0, math.log((good + 1) / (bad + 1)))


@dataclass
class View:
    """One view: scaling, weights and calibration."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    line: tuple[float, float] = (1.0, 0.0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return _with_one(self.scaled(x)) @ self.beta

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.line[0] * self.margin(x) + self.line[1]


@dataclass
class Model:
    """`meta` names the metadata columns and whether each is a number."""

    meta: list[tuple[str, bool]]
    views: tuple[View, View] | None
    mix: np.ndarray
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.full(len(text), self.prior)
        odds = np.stack([v.log_odds(x) for v, x in zip(self.views, (text, meta))], 1)
        return _sigmoid(_with_one(odds) @ self.mix)


def _meta_of(df: DataFrame, names: Sequence[str]) -> list[tuple[str, bool]]:
    return [(n, isinstance(df.schema[n].dataType, T.NumericType)) for n in names]


def _rows_of(batch: pa.RecordBatch, meta: list[tuple[str, bool]], first: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a batch whose text is column `first - 1` and whose metadata follows it."""
    text = [text_features(x) for x in batch.column(first - 1).to_pylist()]
    columns = [batch.column(first + k).to_pylist() for k in range(len(meta))]
    other = [
        meta_features([(c[i], number) for c, (_, number) in zip(columns, meta)]) for i in range(batch.num_rows)
    ]
    width = len(meta_features([(None, number) for _, number in meta]))
    return np.array(text, float).reshape(-1, TEXT_SIZE), np.array(other, float).reshape(-1, width)


def features(df: DataFrame, id_col: str, text_col: str, meta: list[tuple[str, bool]]) -> DataFrame:
    """(doc_id, text, meta): the features of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, other = _rows_of(batch, meta, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())) for x in (text, other))],
            ["doc_id", "text", "meta"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    named = df.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(n).alias(f"_{k}") for k, (n, _) in enumerate(meta)]
    )
    return named.mapInArrow(in_slices(work), f"doc_id {kind}, text array<float>, meta array<float>")


def _arrays(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = rows.column(name)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten(), float).reshape(len(column), -1)


def learn(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: Sequence[str] = ("lang", "source", "n_chars"),
    label_col: str = "quality",
    labelled: int = LABELLED,
    apart: int = APART,
    rounds: int = ROUNDS,
) -> Model:
    """Co-train on all rows of the table.

    A document with several labels takes their majority; a tie, a null label and a null id
    are no label. Without labels of both kinds nothing is learned, and every document gets
    the share of good labels, 1 without any.
    """
    spark = df.sparkSession
    work = Scratch(spark, "quality")
    meta = _meta_of(df, meta_cols)
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.avg(F.col(label_col).cast("double")).alias("y"))
        .where("y <> 0.5")
        .select("doc_id", (F.col("y") > 0.5).cast("double").alias("y"))
    )
    rows = features(df, id_col, text_col, meta).join(known, "doc_id", "left")
    # one labelled row in five is kept apart; of both parts a bounded sample is used, by hash
    draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) / (1 << 30)
    rows = work.table(
        rows.withColumn("part", F.when(F.col("y").isNotNull(), (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).cast("int")))
        .withColumn("draw", draw),
        "features",
    )
    sizes = {r["part"]: r["count"] for r in rows.where("y is not null").groupBy("part").count().collect()}
    good = rows.agg(F.avg("y")).first()[0]
    taken = {p: min(1.0, most / sizes[p]) for p, most in ((0, labelled), (1, apart)) if sizes.get(p)}
    used = F.lit(False)
    for part, share in taken.items():
        used = used | ((F.col("part") == part) & (F.col("draw") < share))
    told = rows.where(used).select("text", "meta", "y", "part").toArrow()  # at most labelled + apart rows
    y, part = (np.array(told.column(c).to_pylist(), float) for c in ("y", "part"))
    train, test = part == 0, part == 1
    if len({*y[train]}) < 2 or len({*y[test]}) < 2:
        return Model(meta, None, np.zeros(0), 1.0 if good is None else float(good))

    # scaling over all documents
    views, x = [], {}
    for name in ("text", "meta"):
        x[name] = _arrays(told, name)
        width = x[name].shape[1]
        stats = rows.select(
            *[F.col(name)[k].cast("double").alias(f"c{k}") for k in range(width)]
        ).agg(
            *[F.avg(f"c{k}") for k in range(width)], *[F.stddev_pop(f"c{k}") for k in range(width)]
        ).first()
        mean, sd = np.array(stats[:width], float), np.array(stats[width:], float)
        view = View(mean, np.where(sd > 1e-6, sd, 1.0))
        view.beta = fit(view.scaled(x[name][train]), y[train])
        view.line = calibrate(view.margin(x[name][test]), y[test])
        views.append(view)

    edge = math.log(CONFIDENT / (1 - CONFIDENT))
    for _ in range(rounds):
        teachers = [View(v.mean, v.scale, v.beta.copy(), v.line) for v in views]
        for _ in range(STEPS):
            sums = _sums(rows, teachers, views, edge, taken)
            for k, view in enumerate(views):
                view.beta = newton_step(view.beta, *sums[k])
        for view, name in zip(views, ("text", "meta")):
            view.line = calibrate(view.margin(x[name][test]), y[test])
    odds = np.stack([v.log_odds(x[n][test]) for v, n in zip(views, ("text", "meta"))], 1)
    return Model(meta, (views[0], views[1]), fit(odds, y[test]), float(good))


def _sums(rows: DataFrame, teachers: list[View], views: list[View], edge: float, taken: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradient and curvature of both views, over all documents."""
    names, sizes = ("text", "meta"), [len(v.beta) for v in views]
    share = taken.get(0, 0.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[np.zeros(n), np.zeros((n, n))] for n in sizes]
        for batch in batches:
            x = [_arrays(batch, n) for n in names]
            y = np.array([np.nan if v is None else v for v in batch.column("y").to_pylist()])
            part = np.array([-1 if v is None else v for v in batch.column("part").to_pylist()])
            draw = np.array(batch.column("draw"))
            real = (part == 0) & (draw < share)
            free = part != 1  # rows kept apart teach nobody
            odds = [t.log_odds(v) for t, v in zip(teachers, x)]
            for k in range(2):
                told = odds[1 - k]
                sure = free & ~real & (np.abs(told) >= edge)
                weight = np.where(real, 1.0, np.where(sure, WEIGHT, 0.0))
                keep = weight > 0
                target = np.where(real, y, told > 0)[keep]
                g, h = newton_sums(_with_one(views[k].scaled(x[k][keep])), target, weight[keep], views[k].beta)
                totals[k][0] += g
                totals[k][1] += h
        flat = np.concatenate([v.ravel() for pair in totals for v in pair])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])

    got = (
        rows.select("text", "meta", "y", "part", "draw")
        .mapInArrow(work, "place long, value double")
        .groupBy("place")
        .agg(F.sum("value").alias("value"))
        .toArrow()
    )
    flat = np.zeros(sum(n + n * n for n in sizes))
    flat[np.array(got.column("place"))] = np.array(got.column("value"))
    out, at = [], 0
    for n in sizes:
        out.append((flat[at : at + n], flat[at + n : at + n + n * n].reshape(n, n)))
        at += n + n * n
    return out


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """The table with one more column: the probability that a document is good.

    Null and empty texts, null metadata and repeated rows are scored like any other row;
    an empty table stays empty.
    """
    meta = model.meta
    names = [n for n, _ in meta]
    columns = df.columns
    if out_col in columns:
        raise ValueError(f"the table has a column {out_col}")
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.DoubleType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = [columns.index(n) for n in (text_col, *names)]
        part = pa.RecordBatch.from_arrays([batch.column(k) for k in at], [str(k) for k in range(len(at))])
        found = model.score(*_rows_of(part, meta, 1))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*columns, out_col])

    return df.mapInArrow(in_slices(work), schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from all of them and their labels; toxic
    documents are not kept."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, marks = learn(docs, labels), toxicity.learn(docs, labels)
    harmless, good = free_name(docs, "_harmless"), free_name(docs, "quality_score")
    told = docs.withColumn(harmless, 1 - toxicity.probability(marks))
    return score(told, model, out_col=good).select(
        "doc_id", F.least(good, harmless).alias("score")
    ).withColumn("kept", F.col("score") >= 0.5)

"""Packing documents into fixed windows by non-negative least squares.

Every document is cut into whole windows and one remainder. The lengths of all pieces
form a histogram with at most `window` bars. Every way to fill a window with up to
`depth` lengths is a column of a matrix; non-negative least squares finds how often to
repeat each column so that the repeats use up the histogram. The solution is rounded down
to what the histogram can pay, and what is left over is packed greedily, longest first,
into consecutive windows, cutting a piece where a window ends. The last, partly filled
window is cut into sequences whose lengths are powers of two, which need no padding.

Only the histogram and the plan made from it, both bounded by the window, reach the
driver. Pieces get their places by their rank among the pieces of equal length; a length
that many pieces share is ranked in buckets.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from cinderlog.llm.common import Scratch, in_slices, table, texts
from cinderlog.llm.tokens import encoder, public_tokenizer

WINDOW = 1024
DEPTH = 3
#: Pieces of one length that are ranked together in one group.
RANKED_TOGETHER = 20_000
#: Steps of the accelerated projected gradient; each costs one pass over the columns.
STEPS = 400

PIECE = "length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fillings(lengths: np.ndarray, window: int, depth: int) -> np.ndarray:
    """All multisets of up to `depth` (at most 3) of the lengths that sum to the window.

    One row each, longest first, unused places 0.
    """
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    rows = [np.array([[window, 0, 0]])] if has[window] else []
    if depth >= 2:
        a = np.arange((window + 1) // 2, window)
        a = a[has[a] & has[window - a]]
        rows.append(np.stack([a, window - a, 0 * a], 1))
    if depth >= 3:
        a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
        c = window - a - b
        good = (a >= b) & (b >= c) & (c >= 1)
        a, b, c = a[good], b[good], c[good]
        good = has[a] & has[b] & has[c]
        rows.append(np.stack([a[good], b[good], c[good]], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def solve(columns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|², by accelerated projection.

    `columns` holds the up to three lengths of each column of A; `counts[n]` is the number
    of pieces of length n and counts[0] is not used.
    """
    if not len(columns):
        return np.zeros(0)
    size, used = len(counts), columns > 0
    scale = max(1.0, counts[1:].max())
    target = counts / scale
    target[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for k in range(columns.shape[1]):
            out += np.bincount(columns[:, k], x * used[:, k], size)
        return out

    def back(y: np.ndarray) -> np.ndarray:
        y[0] = 0
        return y[columns].sum(1)

    # the largest eigenvalue of AᵀA, by power iteration, with a margin
    v = np.ones(len(columns))
    for _ in range(12):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.2 * norm)
    x = np.zeros(len(columns))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(forward(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


@dataclass
class Plan:
    """Places of the pieces, by length and rank among the pieces of that length.

    `key` holds length << 40 | first rank, ascending; a piece belongs to the last entry
    that isn't above its own key. In an entry with seq >= 0 the piece of rank r is whole,
    in sequence seq + (r - first) at `at`; else it lies in the stream of residuals at
    `at` + (r - first) * length. The stream starts at sequence `stream`; `cuts` are the
    places where its last window is cut.
    """

    key: np.ndarray
    seq: np.ndarray
    at: np.ndarray
    stream: int
    full: int
    cuts: np.ndarray


def make_plan(counts: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> Plan:
    """`counts[n]`: pieces of length n, for n up to the window."""
    counts = counts.astype(np.int64)
    columns = fillings(np.flatnonzero(counts[1:]) + 1, window, depth)
    x = solve(columns, counts.astype(float))
    left, entries, sequence = counts.copy(), [], 0
    taken = np.zeros_like(counts)

    def use(row: np.ndarray, most: int) -> int:
        parts, times = np.unique(row[row > 0], return_counts=True)
        m = min(most, int((left[parts] // times).min()))
        if m > 0:
            at = 0
            for n in row[row > 0]:
                entries.append((int(n) << 40 | int(taken[n]), sequence, at))
                taken[n] += m
                left[n] -= m
                at += int(n)
        return max(0, m)

    for k in np.argsort(-x, kind="stable"):
        if x[k] < 1:
            break
        sequence += use(columns[k], int(x[k]))
    # rounding left some of most lengths: whole fillings first, longest lengths first
    for k in np.lexsort((-columns[:, 1], -columns[:, 0])) if len(columns) else []:
        if left[columns[k][columns[k] > 0]].all():
            sequence += use(columns[k], int(left[columns[k][0]]))
    position = 0
    for n in range(window, 0, -1):
        if left[n]:
            entries.append((n << 40 | int(taken[n]), -1, position))
            position += n * int(left[n])
    full, rest = divmod(position, window)
    cuts, at = [], 0
    for bit in range(window.bit_length(), -1, -1):
        if rest >> bit & 1:
            cuts.append(at)
            at += 1 << bit
    entries.sort()
    key, seq, at = (np.array([e[i] for e in entries], np.int64) for i in range(3))
    return Plan(key, seq, at, sequence, full, np.array(cuts or [0], np.int64))


def _cut(total: int, at: int, plan: Plan, window: int):
    """The parts of a residual piece of `total` ids that begins at `at` of the stream.

    Yields (ids of the piece before it, length, sequence, offset).
    """
    done = 0
    while done < total:
        number, offset = divmod(at + done, window)
        end = window
        sequence = plan.stream + number
        if number == plan.full:
            k = int(np.searchsorted(plan.cuts, offset, "right")) - 1
            sequence += k
            end = int(plan.cuts[k + 1]) if k + 1 < len(plan.cuts) else window
            offset -= (base := int(plan.cuts[k]))
            end -= base
        n = min(total - done, end - offset)
        yield done, n, sequence, offset
        done += n


def placing(plan: Plan, window: int):
    """A function of a piece's length and rank: its parts in the order of their ids."""
    part = pa.struct([(name, pa.int64()) for name in ("skip", "length", "sequence_id", "offset")])

    @F.arrow_udf("array<struct<skip long, length long, sequence_id long, offset long>>")
    def parts(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        entry = np.searchsorted(plan.key, (length << 40) | rank, "right") - 1
        step = rank - (plan.key[entry] & ((1 << 40) - 1))
        seq, at = plan.seq[entry], plan.at[entry]
        whole = seq >= 0
        # a whole window in the stream: the stream's longest pieces come first, so it starts a
        # sequence and isn't cut
        alone = ~whole & (length == window)
        skip, sizes = np.zeros_like(length), length
        sequence = np.where(whole, seq + step, plan.stream + step)
        offset = np.where(whole, at, 0)
        counts = np.ones(len(length), np.int32)
        cut = {i: list(_cut(int(length[i]), int(at[i] + step[i] * length[i]), plan, window))
               for i in np.flatnonzero(~whole & ~alone).tolist()}
        if cut:
            for i, found in cut.items():
                counts[i] = len(found)
            first = np.cumsum(counts) - counts
            columns = [np.repeat(x, counts) for x in (skip, sizes, sequence, offset)]
            for i, found in cut.items():
                for column, values in zip(columns, zip(*found)):
                    column[first[i] : first[i] + len(found)] = values
            skip, sizes, sequence, offset = columns
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        values = [pa.array(x, pa.int64()) for x in (skip, sizes, sequence, offset)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, fields=list(part)))

    return parts


def pieces(df: DataFrame, id_col: str, text_col: str, path: str, window: int, all_ids: bool) -> DataFrame:
    """Whole windows and the remainder of every document; a remainder keeps its ids, a whole
    window only if asked to."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
        + [T.StructField("ids", T.BinaryType())]
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, step = encoder(path), 4 * window
        rows: list[list] = [[] for _ in range(6)]
        take: list[int] = []
        for k, text in enumerate(texts(batch.column(1))):
            ids = code.packed(text) + b"\0\0\0\0"
            for at in range(0, len(ids), step):
                part = ids[at : at + step]
                take.append(k)
                for to, value in zip(
                    rows[1:],
                    (at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if all_ids or len(part) < step else None),
                ):
                    to.append(value)
        columns = [batch.column(0).take(pa.array(take, pa.int64()))]
        columns += [pa.array(x, pa.int64()) for x in rows[1:5]] + [pa.array(rows[5], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(id_col, text_col).mapInArrow(in_slices(work, column=1), schema)


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    depth: int = DEPTH,
    all_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    `ids` (little-endian unsigned 32-bit) is given for pieces shorter than the window, as
    only those come from a cut that isn't on a multiple of it; the others are the ids
    start .. start + window of their document. With `all_ids` every piece carries its ids,
    at the price of moving them all. The window is a power of two.

    Null text counts as empty, and an empty text is the closing id alone. Rows that repeat,
    ids included, are packed as often as they occur. A null id is kept. An empty table gives
    no rows. Columns other than the two named are not read.
    """
    spark = df.sparkSession
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    work = Scratch(spark, "pack")
    cut = work.table(pieces(df, id_col, text_col, tokenizer or public_tokenizer(), window, all_ids), "pieces")

    bars = cut.groupBy("length").count().collect()  # at most one row per length up to the window
    counts = np.zeros(window + 1, np.int64)
    for bar in bars:
        counts[bar["length"]] = bar["count"]
    plan = make_plan(counts, window, depth)

    # rank among the pieces of a length: in buckets, each after the buckets before it
    sizes = F.broadcast(
        spark.createDataFrame(
            [(int(n), int(-(-c // RANKED_TOGETHER))) for n, c in enumerate(counts) if c] or [(0, 1)],
            "length long, buckets long",
        )
    )
    dealt = cut.join(sizes, "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets"))
    )
    before = (
        dealt.groupBy("length", "bucket")
        .count()
        .withColumn(
            "first",
            F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count"),
        )
        .drop("count")
    )
    group = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("rank", F.row_number().over(group))
        .join(before, ["length", "bucket"])
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids",
            (F.col("first") + F.col("rank") - 1).alias("rank"),
        )
    )
    # only lengths and ranks reach Python: with the ids, its batches would be tens of MB
    placed = ranked.withColumn("part", F.explode(placing(plan, window)("length", "rank")))
    skip, length = F.col("part.skip").cast("int"), F.col("part.length").cast("int")
    ids = F.substring("ids", 4 * skip + 1, 4 * length)
    whole = F.col("part.length") == F.col("length")
    return placed.select(
        "doc_id",
        (F.col("start") + F.col("part.skip")).alias("start"),
        "part.length",
        F.when(whole, F.col("ids_crc32")).otherwise(F.crc32(ids)).alias("ids_crc32"),
        "doc_tokens",
        "part.sequence_id",
        "part.offset",
        F.when(whole, F.col("ids")).otherwise(ids).alias("ids"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")

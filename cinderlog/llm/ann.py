"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree hashes a vector to a string of `bits` signs of random projections; vectors are
first lifted to equal length (a further component fills up to the longest), so that the
largest inner product is the smallest angle. The rows are dealt into blocks, and the
strings of a block's vectors are one sorted array per tree.

A search descends in every tree to the longest prefix that matches, and then ascends in
all trees at once, one bit at a time, until the ranges of rows that share the prefix hold
enough candidates. As ranges of all blocks add up, the level to stop at is found first
from the sizes of the ranges alone. Then each block scores its candidates exactly and
sends on its best.

How many candidates are enough is measured: for a bounded sample of queries the true
neighbours are found by brute force, and the smallest number that reaches the wanted
recall on them is taken for all queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cinderlog.llm.common import Scratch, in_slices, table

TREES, BITS = 64, 24
#: Rows whose sorted arrays one task holds, and queries it is asked at a time.
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
#: Recall wanted on the sample, and the most queries in it.
RECALL, SAMPLE = 0.95, 128
SEED = 20


def _planes(size: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size + 1, trees * bits))


def _strings(vectors: np.ndarray, extra: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """The hash strings, a row per vector and a column per tree, as numbers."""
    signs = (vectors @ planes[:-1] + extra[:, None] * planes[-1]) > 0
    powers = 1 << np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return signs.reshape(len(vectors), -1, bits).astype(np.uint32) @ powers


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


@dataclass
class Forest:
    """`rows`: (block, vec_id, vector, strings), the last two as bytes."""

    rows: DataFrame
    count: int
    size: int
    blocks: int
    trees: int
    bits: int
    seed: int
    work: Scratch


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a finite, non-zero vector of the
    commonest size (of equally common ones the smallest)."""
    v = F.col("v")
    rows = df.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    ).where(
        F.col("vec_id").isNotNull()
        & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)


def build(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    bits: int = BITS,
    block_rows: int = BLOCK_ROWS,
    seed: int = SEED,
) -> Forest:
    """Index every usable row."""
    work = Scratch(df.sparkSession, "forest")
    rows = usable(df, id_col, vector_col)
    told = rows.agg(F.count("*"), F.max(_norm2(F.col("v"))), F.max(F.size("v"))).first()
    count, longest, size = told[0], told[1] or 0.0, told[2] or 0
    blocks = max(1, -(-count // block_rows))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def work_on(batch: pa.RecordBatch) -> pa.RecordBatch:
        planes = _planes(size, trees, bits, seed)
        x = np.array(batch.column(1).flatten(), np.float64).reshape(-1, size)
        extra = np.sqrt(np.maximum(0, longest - (x * x).sum(1)))
        strings = _strings(x, extra, planes, bits)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array([r.tobytes() for r in x], pa.binary()),
                pa.array([r.tobytes() for r in strings], pa.binary()),
            ],
            ["vec_id", "block", "vector", "strings"],
        )

    dealt = rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
    index = dealt.mapInArrow(
        in_slices(work_on, 1024), f"vec_id {kind}, block int, vector binary, strings binary"
    )
    return Forest(work.table(index, "index"), count, size, blocks, trees, bits, seed, work)


def _asked(forest: Forest, queries: DataFrame) -> DataFrame:
    """(q, chunk, vec_id, vector, strings) of the query rows; a query needs no lifting."""
    size, trees, bits, seed = forest.size, forest.trees, forest.bits, forest.seed
    kind = queries.schema["vec_id"].dataType.simpleString()

    def work_on(batch: pa.RecordBatch) -> pa.RecordBatch:
        planes = _planes(size, trees, bits, seed)
        x = _matrix(batch.column(1), "<f8", size)
        strings = _strings(x, np.zeros(len(x)), planes, bits)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([r.tobytes() for r in strings], pa.binary())],
            ["vec_id", "vector", "q", "chunk", "strings"],
        )

    count = queries.count()
    chunks = max(1, -(-count // QUERY_ROWS))
    numbered = queries.select("vec_id", "vector").withColumn("q", F.monotonically_increasing_id())
    return forest.work.table(
        numbered.withColumn("chunk", F.pmod("q", F.lit(chunks)).cast("int")).mapInArrow(
            in_slices(work_on, 1024), f"vec_id {kind}, vector binary, q long, chunk int, strings binary"
        ),
        "queries",
    )


def _in_blocks(forest: Forest, asked: DataFrame, body: Callable, schema: str) -> DataFrame:
    """`body(index rows, query rows)` for every block and every chunk of the stated queries."""
    chunks = sorted(r["chunk"] for r in asked.select("chunk").distinct().collect())  # a row per 4096 queries
    index = forest.rows.withColumn("chunk", F.explode(F.array(*[F.lit(c) for c in chunks] or [F.lit(0)])))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(forest.blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return body(left, right)

    return index.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(run, schema)


def _range_sizes(forest: Forest, asked: DataFrame) -> DataFrame:
    """(q, level, rows): how many rows of all trees share the first `level` bits."""
    trees, bits = forest.trees, forest.bits

    def body(left: pa.Table, right: pa.Table) -> pa.Table:
        q = np.array(right["q"].to_pylist(), np.int64)
        sizes = np.zeros((len(q), bits + 1), np.int64)
        if len(q) and left.num_rows:
            rows = np.sort(_matrix(left["strings"], "<u4", trees), 0)
            asks = _matrix(right["strings"], "<u4", trees)
            for t in range(trees):
                column = np.ascontiguousarray(rows[:, t])
                for level in range(bits + 1):
                    low = asks[:, t] >> np.uint32(bits - level) << np.uint32(bits - level)
                    high = low + np.uint32(1 << (bits - level))
                    sizes[:, level] += np.searchsorted(column, high) - np.searchsorted(column, low)
        return pa.table({"q": pa.array(q), "sizes": pa.array(list(sizes), pa.list_(pa.int64()))})

    return (
        _in_blocks(forest, asked, body, "q long, sizes array<long>")
        .select("q", F.posexplode("sizes").alias("level", "n"))
        .groupBy("q", "level")
        .agg(F.sum("n").alias("rows"))
    )


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _within_reach(scores: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of the scores that could be among the k best, each being off by `slack` at most."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, -k)[-k] - slack)


def _scored(forest: Forest, asked: DataFrame, k: int, everything: bool) -> DataFrame:
    """(q, query_id, rank, vec_id, score, depth): the k best candidates of each query.

    Candidates share `level` bits (a column of `asked`) in a tree, or are all rows if
    `everything`; then `depth` is the longest prefix shared in any tree, else null.
    """
    trees, bits, size = forest.trees, forest.bits, forest.size
    kind = forest.rows.schema["vec_id"].dataType.simpleString()

    def body(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        if left.num_rows and right.num_rows:
            strings = _matrix(left["strings"], "<u4", trees)
            vectors = _matrix(left["vector"], "<f8", size)
            ids = np.array(left["vec_id"].to_pylist())
            asks, points = _matrix(right["strings"], "<u4", trees), _matrix(right["vector"], "<f8", size)
            # twice the rounding error of either way to sum up a product
            longest = np.sqrt((vectors * vectors).sum(1).max())
            slack = 4 * (size + 1) * np.finfo(np.float64).eps * longest * np.sqrt((points * points).sum(1))
            if not everything:
                order = np.argsort(strings, 0, kind="stable")
                ordered = np.take_along_axis(strings, order, 0)
                order, ordered = np.ascontiguousarray(order.T), np.ascontiguousarray(ordered.T)
                shift = bits - np.array(right["level"].to_pylist(), np.int64)
                low = asks >> shift[:, None].astype(np.uint32) << shift[:, None].astype(np.uint32)
                high = low + (1 << shift[:, None]).astype(np.uint32)
                first = np.stack([np.searchsorted(ordered[t], low[:, t]) for t in range(trees)], 1)
                last = np.stack([np.searchsorted(ordered[t], high[:, t]) for t in range(trees)], 1)
            for n, (q, own) in enumerate(zip(right["q"].to_pylist(), right["vec_id"].to_pylist())):
                if everything:
                    near = np.arange(len(ids))
                else:
                    met = np.zeros(len(ids), bool)
                    for t in range(trees):
                        met[order[t, first[n, t] : last[n, t]]] = True
                    near = np.flatnonzero(met)
                near = near[ids[near] != own]
                if not len(near):
                    continue
                # the product's last bits depend on a row's place: what could be among the best
                # is scored again, term by term in order, so that equal vectors tie
                near = near[_within_reach(vectors[near] @ points[n], k, slack[n])]
                scores = np.cumsum(vectors[near] * points[n], axis=1)[:, -1]
                top = _best(scores, ids[near], k)
                chosen = near[top]
                out[0] += [q] * len(top)
                out[1] += [own] * len(top)
                out[2] += ids[chosen].tolist()
                out[3] += scores[top].tolist()
                if everything:
                    apart = (strings[chosen] ^ asks[n]).min(1)
                    out[4] += [bits - int(x).bit_length() for x in apart]
                else:
                    out[4] += [None] * len(top)
        return pa.table(
            [pa.array(out[0], pa.int64()), pa.array(out[1], left["vec_id"].type), pa.array(out[2], left["vec_id"].type),
             pa.array(out[3], pa.float64()), pa.array(out[4], pa.int32())],
            ["q", "query_id", "vec_id", "score", "depth"],
        )

    found = _in_blocks(
        forest, asked, body, f"q long, query_id {kind}, vec_id {kind}, score double, depth int"
    )
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floors(forest: Forest, asked: DataFrame, k: int) -> DataFrame:
    """(q, least): a query's ranges with so many rows hold k rows of other ids; a row is met
    once in each tree at most, and rows with the query's own id are none."""
    own = forest.rows.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").count()
    return asked.join(own, "vec_id").select("q", (forest.trees * (k + F.col("count"))).alias("least"))


def enough_candidates(forest: Forest, asked: DataFrame, sizes: DataFrame, k: int, recall: float, sample: int) -> int:
    """The fewest rows of ranges with which the sampled queries reach the recall."""
    some = asked.orderBy(F.xxhash64("vec_id"), "q").limit(sample)
    some = forest.work.table(some, "sample")
    floors = dict(_floors(forest, some, k).collect())  # at most `sample` rows
    true = _scored(forest, some, k, True).select("q", "depth").collect()  # sample * k rows
    held = sizes.join(F.broadcast(some.select("q")), "q").collect()  # sample * (bits + 1) rows
    depths: dict[int, list[int]] = {}
    for r in true:
        depths.setdefault(r["q"], []).append(r["depth"])
    rows: dict[int, dict[int, int]] = {}
    for r in held:
        rows.setdefault(r["q"], {})[r["level"]] = r["rows"]

    def reached(enough: int) -> float:
        shares = []
        for q, found in depths.items():
            level = max([lv for lv, n in rows[q].items() if n >= max(enough, floors[q])], default=0)
            shares.append(sum(d >= level for d in found) / len(found))
        return sum(shares) / len(shares) if shares else 1.0

    enough = k
    while enough < forest.count * forest.trees and reached(enough) < recall:
        enough = enough + max(1, enough // 8)
    return enough


def search(
    forest: Forest,
    queries: DataFrame,
    k: int = 20,
    recall: float = RECALL,
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best candidates found.

    `queries` holds rows of `forest.rows`. The score is the inner product in double
    precision, ties go to the smaller vec_id; rows with the query's own id are no
    candidates. Where fewer rows exist, all are returned; else every query gets k rows.
    """
    asked = _asked(forest, queries)
    sizes = forest.work.table(_range_sizes(forest, asked), "sizes")
    enough = enough_candidates(forest, asked, sizes, k, recall, sample)
    least = F.greatest(F.lit(enough), F.col("least"))
    level = sizes.join(_floors(forest, asked, k), "q").groupBy("q").agg(
        F.coalesce(F.max(F.when(F.col("rows") >= least, F.col("level"))), F.lit(0)).alias("level")
    )
    found = _scored(forest, asked.join(level, "q"), k, False)
    return found.select("query_id", "rank", "vec_id", "score")


def nearest(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    **how,
) -> DataFrame:
    """`search` of the rows for which `is_query` (on the column vec_id) holds, among all rows.

    Rows with a null id, and vectors that are null, zero, of another than the commonest
    size, or hold a null or non-finite component, take no part. Rows that repeat are
    queries and candidates each; an empty table gives no rows; other columns are not read.
    """
    forest = build(df, id_col, vector_col, **how)
    return search(forest, forest.rows.where(is_query), k)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

"""Near-duplicate documents: one-permutation hashing, densified, with star candidates.

Every document becomes the set of its distinct word shingles, hashed to 64 bits. One
permutation deals the set into `bands * rows` bins and keeps the smallest hash of each;
an empty bin takes the value of another bin that a two-universal hash of (bin, attempt)
names, the same for all documents, until it meets a filled one (optimal densification).
`rows` bins make a band, and documents that agree on a band share a bucket.

Documents with equal sets are one class from the start. In a bucket, every class is
paired with one centre only: the member whose buckets are largest over all bands, so the
original of a group of edited copies is the centre of all its buckets. The similarity of
each star pair is computed on the full sets; those at the threshold are links.

Members of a bucket that are still in different components could be linked past their
centre. Every class belongs to the cell of the centre it is most similar to, or of that centre's
own, and the pairs
of cells that share a bucket are compared in chunks of some megabytes a side: signatures rule out most pairs, the full sets confirm the rest. Chunks of one and
the same component are never compared, pairs are never written out, and of the links
found one per class and component is kept, as that is all a component needs.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderlog.llm.common import Scratch, clean_bytes, in_slices, table
from cinderlog.llm.components import components

BANDS, ROWS = 48, 6
#: Hashes per side when cells are compared, and the standard deviations by which the share
#: of equal bins may fall short of the threshold before a pair is ruled out unseen.
CHUNK, MARGIN = 500_000, 6.0
#: How many centres up a cell is named; any number gives the same links.
JUMPS = 3

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, remembered in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `size`-word shingles of a whole text.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased.
    A text of fewer words is one shingle; one without words, or null, has none.
    """
    words = clean_bytes(text).lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    mixed = np.full(len(codes) - width + 1, np.uint64(width))
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = _mix(mixed * _MIX + codes[k : len(codes) - width + 1 + k])
    return np.unique(mixed)


def _deputies(bins: int, attempts: int = 64) -> np.ndarray:
    """For each bin, the bins it asks in turn while it is empty."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(attempts)
    with np.errstate(over="ignore"):
        drawn = _mix((at + np.arange(attempts, dtype=np.uint64)[None, :] + np.uint64(1)) * _MIX)
    return (drawn % np.uint64(bins)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int, deputies: np.ndarray) -> np.ndarray:
    """The smallest hash per bin of a sorted, non-empty set, empty bins densified."""
    edges = (np.arange(bins, dtype=object) * (1 << 64) // bins).astype(np.uint64)
    first = np.searchsorted(hashes, edges)
    last = np.append(first[1:], len(hashes))
    filled = first < last
    out = np.where(filled, hashes[np.minimum(first, len(hashes) - 1)], np.uint64(0))
    empty = np.flatnonzero(~filled)
    source = np.full(len(empty), -1)
    for k in range(deputies.shape[1]):
        ask = deputies[empty, k]
        new = (source < 0) & filled[ask]
        source[new] = ask[new]
    if (source < 0).any():
        # every deputy was empty: the next filled bin, as few bins are filled
        there = np.flatnonzero(filled)
        left = source < 0
        source[left] = there[np.searchsorted(there, empty[left]) % len(there)]
    out[empty] = out[source]
    return out


def set_key(hashes: np.ndarray) -> int:
    """Identifies a set of hashes."""
    with np.errstate(over="ignore"):
        mixed = _mix(np.bitwise_xor.reduce(_mix(hashes)) + np.uint64(len(hashes)))
    return int(mixed.astype(np.int64))


def sketches(df: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, low): one row per document.

    `set_key` identifies the set, `bands` holds a 64-bit key per band and `low` one byte of
    every bin for a cheap estimate; both are null for an empty set.
    """
    bins = bands * rows
    deputies = _deputies(bins)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, keys, bucket, low = [], [], [], []
        for text in batch.column(1).to_pylist():
            found = shingle_set(text, size)
            counts.append(len(found))
            if not len(found):
                keys.append(None), bucket.append(None), low.append(None)
                continue
            with np.errstate(over="ignore"):
                keys.append(set_key(found))
                signed = signature(found, bins, deputies)
                key = np.arange(bands, dtype=np.uint64)
                for row in signed.reshape(bands, rows).T:
                    key = _mix(key * _MIX + row)
            bucket.append(key.astype(np.int64))
            low.append((signed >> np.uint64(8)).astype(np.uint8).tobytes())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array(bucket, pa.list_(pa.int64())),
                pa.array(low, pa.binary()),
            ],
            ["doc_id", "n_shingles", "set_key", "bands", "low"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        in_slices(work),
        f"doc_id {kind}, n_shingles long, set_key long, bands array<long>, low binary",
    )


def _sets(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """(set_key, hashes): the full sets of texts, as sorted 64-bit numbers; only of texts that
    have the set named, as rows of one id can hold different texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sets = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = shingle_set(text, size)
            if len(found) and set_key(found) == key:
                keys.append(key), sets.append(found.tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["set_key", "hashes"]
        )

    return df.select("set_key", text_col).mapInArrow(in_slices(work), "set_key long, hashes binary")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either): the sizes of intersection and union of the pairs' full sets."""
    left = sets.select(F.col("set_key").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("set_key").alias("b"), F.col("hashes").alias("y"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        both, either = [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            n = len(np.intersect1d(x, y, assume_unique=True))
            both.append(n)
            either.append(len(x) + len(y) - n)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())],
            ["a", "b", "both", "either"],
        )

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(in_slices(work), "a long, b long, both long, either long")


def compare(left: pa.Table, right: pa.Table, bins: int, per_cent: int) -> tuple[list[int], list[int]]:
    """Links between two chunks, one per class of the left and component of the right.

    What is linked is one component from then on, and not compared again.
    Rows are (set_key, component, low, hashes). The share of equal bins of two sets at the
    threshold varies with the number of bins their hashes fill; pairs more than `MARGIN`
    standard deviations below it are not looked at.
    """

    def read(table: pa.Table):
        sets = [np.frombuffer(z.as_buffer(), np.uint64) for z in table.column("hashes")]
        low = np.frombuffer(b"".join(z.as_py() for z in table.column("low")), np.uint8).reshape(-1, bins)
        keys, comps = (np.array(table.column(c).to_pylist(), np.int64) for c in ("set_key", "component"))
        return sets, low, keys, comps, np.array([len(x) for x in sets])

    xs, x_low, x_keys, x_comps, x_sizes = read(left)
    ys, y_low, y_keys, y_comps, y_sizes = read(right)
    flat = np.concatenate(ys)
    starts = np.concatenate([[0], np.cumsum(y_sizes)[:-1]])
    share = per_cent / 100
    out_a: list[int] = []
    out_b: list[int] = []
    for k, x in enumerate(xs):
        n = len(x)
        fits = (y_comps != x_comps[k]) & (100 * np.minimum(n, y_sizes) >= per_cent * np.maximum(n, y_sizes))
        if not fits.any():
            continue
        filled = 0.8 * bins * (1 - np.exp(-np.minimum(n, y_sizes) / bins))
        least = share - MARGIN * np.sqrt(share * (1 - share) / np.maximum(filled, 1))
        near = np.flatnonzero(fits)
        near = near[np.count_nonzero(x_low[k] == y_low[near], 1) >= bins * least[near]]
        if not len(near):
            continue
        if 2 * len(near) > len(ys):
            part, at = flat, starts
        else:
            part = np.concatenate([ys[j] for j in near])
            at = np.concatenate([[0], np.cumsum(y_sizes[near])[:-1]])
        place = np.minimum(np.searchsorted(x, part), n - 1)
        both = np.add.reduceat((x[place] == part).astype(np.int64), at)
        if part is flat:
            both = both[near]
        linked = near[100 * both >= per_cent * (n + y_sizes[near] - both)]
        if not len(linked):
            continue
        met, first = np.unique(y_comps[linked], return_index=True)
        out_a += [int(x_keys[k])] * len(first)
        out_b += y_keys[linked[first]].tolist()
        for comps in (x_comps, y_comps):
            comps[np.isin(comps, met)] = x_comps[k]
    return out_a, out_b


def _beyond_centres(
    members: DataFrame, cells: DataFrame, named: DataFrame, classes: DataFrame, sets: DataFrame,
    bins: int, per_cent: int, work: Scratch,
) -> DataFrame:
    """(a, b): links between components that share a bucket."""
    placed = (
        classes.select("set_key", "n")
        .join(members.select("set_key").distinct(), "set_key")
        .join(cells, "set_key", "left")
        .join(named, "set_key", "left")
        .select("set_key", "n", F.coalesce("cell", "set_key").alias("cell"), F.coalesce("component", "set_key").alias("component"))
    )
    # a component that fills a chunk of its cell has chunks of its own
    per = placed.groupBy("cell", "component").agg(F.sum("n").alias("hashes"))
    big = F.col("hashes") >= CHUNK
    own = per.where(big).select("cell", "component", F.ceil(F.col("hashes") / CHUNK).alias("own"))
    mixed = per.where(~big).groupBy("cell").agg(F.ceil(F.sum("hashes") / CHUNK).alias("mixed"))
    placed = work.table(
        placed.join(own, ["cell", "component"], "left")
        .join(mixed, "cell", "left")
        .withColumn("part", F.pmod(F.xxhash64("set_key"), F.coalesce("own", "mixed")))
        .withColumn("of", F.when(F.col("own").isNotNull(), F.col("component")))
        .withColumn("chunk", F.xxhash64("cell", "of", "part"))
        .select("set_key", "n", "cell", "component", "of", "chunk"),
        "placed",
    )
    chunks = placed.groupBy("cell", "chunk").agg(
        F.first("of").alias("of"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    # pairs of cells that share a bucket which holds several components
    seen = members.select("set_key", "bucket").join(placed.select("set_key", "cell", "component"), "set_key")
    seen = seen.groupBy("bucket", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    apart = seen.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    seen = seen.join(apart.select("bucket"), "bucket")
    one = seen.select("bucket", F.col("cell").alias("c"), F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"))
    two = seen.select(F.col("bucket").alias("b2"), F.col("cell").alias("d"), F.col("lo").alias("d_lo"), F.col("hi").alias("d_hi"))
    together = F.least("c_lo", "d_lo") < F.greatest("c_hi", "d_hi")
    pairs = one.join(two, (F.col("bucket") == F.col("b2")) & (F.col("c") <= F.col("d")) & together)
    pairs = pairs.select("c", "d").distinct()
    c, d = (
        chunks.select(*[F.col(x).alias(f"{p}_{x}") for x in chunks.columns]) for p in ("c", "d")
    )
    fit = (100 * F.col("c_most") >= per_cent * F.col("d_least")) & (100 * F.col("d_most") >= per_cent * F.col("c_least"))
    differ = F.col("c_of").isNull() | F.col("d_of").isNull() | (F.col("c_of") != F.col("d_of"))
    chunk_pairs = work.table(
        pairs.join(c, F.col("c") == F.col("c_cell"))
        .join(d, F.col("d") == F.col("d_cell"))
        .where(fit & differ & ((F.col("c") < F.col("d")) | (F.col("c_chunk") <= F.col("d_chunk"))))
        .select("c_chunk", "d_chunk")
        .distinct(),
        "chunk-pairs",
    )
    sides = chunk_pairs.select(
        F.xxhash64("c_chunk", "d_chunk").alias("pair"),
        F.explode(
            F.when(F.col("c_chunk") == F.col("d_chunk"), F.array(F.struct(F.lit(2).alias("side"), F.col("c_chunk").alias("chunk")))).otherwise(
                F.array(
                    F.struct(F.lit(0).alias("side"), F.col("c_chunk").alias("chunk")),
                    F.struct(F.lit(1).alias("side"), F.col("d_chunk").alias("chunk")),
                )
            )
        ).alias("s"),
    ).select("pair", "s.side", "s.chunk")

    def run(table: pa.Table) -> pa.Table:
        side = np.array(table.column("side"))
        left = table.filter(pa.array(side != 1))
        right = table.filter(pa.array(side != 0))
        a, b = compare(left, right, bins, per_cent) if left.num_rows and right.num_rows else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = (
        sides.join(placed.select("set_key", "component", "chunk"), "chunk")
        .join(classes.select("set_key", "low"), "set_key")
        .join(sets, "set_key")
        .select("pair", "side", "set_key", "component", "low", "hashes")
    )
    return rows.groupBy("pair").applyInArrow(run, "a long, b long")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    per_cent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of the table.

    Documents are linked when 100 * |intersection| >= per_cent * |union| of their shingle
    sets; component_id is the smallest doc_id reachable over links. A document without
    words, or with a null text, is linked with nothing. `kept` marks the first document of
    each component; rows that repeat with the same id are kept or dropped together. The id
    is a long; rows with a null id have component_id null and are kept. An empty table
    gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    work = Scratch(spark, "minhash")
    docs = work.table(sketches(df, id_col, text_col, shingle_words, bands, rows), "sketches")

    # one class per distinct set
    found = docs.where("set_key is not null and doc_id is not null")
    classes = work.table(
        found.groupBy("set_key").agg(
            F.min("doc_id").alias("first"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("low").alias("low"),
        ),
        "classes",
    )
    # buckets of two classes or more, and for each class the mass of its buckets
    dealt = classes.select("set_key", "n", F.posexplode("bands").alias("band", "key")).select(
        "set_key", "n", F.xxhash64("band", "key").alias("bucket")
    )
    sizes = dealt.groupBy("bucket").count().where("count > 1")
    members = work.table(dealt.join(sizes, "bucket"), "members")
    mass = members.groupBy("set_key").agg(F.sum("count").alias("mass"))
    ordered = members.join(mass, "set_key")
    centres = ordered.groupBy("bucket").agg(
        F.max(F.struct("mass", "set_key", "n")).alias("centre")
    )
    stars = (
        ordered.join(centres, "bucket")
        .where(F.col("set_key") != F.col("centre.set_key"))
        .select(F.col("set_key").alias("a"), F.col("centre.set_key").alias("b"))
        .distinct()
    )
    # full sets of the classes that take part, from the texts of their first documents
    taking = members.select("set_key").distinct().join(classes.select("set_key", "first"), "set_key")
    firsts = df.select(F.col(id_col).alias("first"), F.col(text_col).alias("text"))
    sets = work.table(
        _sets(firsts.join(taking, "first"), "text", shingle_words).dropDuplicates(["set_key"]), "sets"
    )
    compared = work.table(_similar(stars, sets), "stars")
    links = compared.where(100 * F.col("both") >= per_cent * F.col("either")).select("a", "b")
    found_so_far = work.table(components(links, work), "components")
    cells = compared.groupBy(F.col("a").alias("set_key")).agg(
        F.max_by("b", F.col("both") / F.col("either")).alias("cell")
    )
    # a centre has a centre too, of larger buckets: cells that meet at one become one
    up = work.table(cells, "cells").select(F.col("set_key").alias("cell"), F.col("cell").alias("up"))
    for _ in range(JUMPS):
        cells = cells.join(up, "cell", "left").select("set_key", F.coalesce("up", "cell").alias("cell"))
    cells = work.table(cells, "cells")
    named = found_so_far.select(F.col("node").alias("set_key"), "component")
    more = work.table(
        _beyond_centres(members, cells, named, classes, sets, bands * rows, per_cent, work), "more"
    )
    if not more.isEmpty():
        found_so_far = components(links.unionByName(more), work)

    # back to ids: a component is named by its smallest document
    labels = found_so_far.join(
        classes.select(F.col("set_key").alias("node"), "first"), "node"
    )
    names = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    by_set = labels.join(names, "component").select(F.col("node").alias("set_key"), "component_id")
    return (
        docs.select("doc_id", "n_shingles", "set_key")
        .join(
            classes.select("set_key", "first")
            .join(by_set, "set_key", "left")
            .select("set_key", F.coalesce("component_id", "first").alias("component_id")),
            "set_key",
            "left",
        )
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * k >= 80 * (nx.n + ny.n - k)
), both_ways AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(y) AS component_id, d.doc_id = min(y) AS kept
FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n
"""

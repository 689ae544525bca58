"""Sharding by fixed virtual slots and a stored, versioned map of slots to shards.

Records are hashed into a fixed number of slots, thousands of them, whatever the number of
shards is. Bytes are summed per slot, and a small table, the slot map, says which shard
holds a slot. Rebalancing edits that table: a new version moves the fewest slots it needs
and leaves all others where they are. Version 1 deals the slots out evenly; the next one
moves slots until the shards hold nearly equal bytes; adding a shard moves slots into the
new shard only.

A slot too heavy to be moved as a whole (one key with a third of all rows) is split into
pieces by a salt of the record's place in the written table, and its pieces are moved like
slots. Only the map, one row per slot or piece, ever reaches the driver. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cinderlog.llm.common import Scratch, table

SLOTS = 4096
#: Shards may differ from the fair share by this part of it before slots are split.
TOLERANCE = 0.01
#: A piece of a split slot is at most this part of a shard's fair share.
FINEST = 1 / 256
#: A slot's numbering goes in parts if it has more rows than this many average slots, but
#: not in parts of fewer rows than `LEAST_PART`.
WIDE, LEAST_PART = 4, 1_000


@dataclass(frozen=True)
class Unit:
    """A slot, or one piece of a split slot, with the bytes it holds."""

    slot: int
    piece: int
    pieces: int
    size: int


def even(units: Sequence[Unit], shards: int) -> dict[Unit, int]:
    """The map before any edit: slots in turn."""
    return {u: (u.slot + u.piece) % shards for u in units}


def rebalanced(held: dict[Unit, int], shards: int, into: Sequence[int] | None = None) -> dict[Unit, int]:
    """The map after moving one unit at a time from the heaviest shard to the lightest
    (of `into`, if given), as long as that evens them out. Equal inputs give equal maps."""
    out = dict(held)
    totals = [0] * shards
    units: list[list[tuple[int, int, int, Unit]]] = [[] for _ in range(shards)]
    for u, shard in held.items():
        totals[shard] += u.size
        units[shard].append((u.size, u.slot, u.piece, u))
    for row in units:
        row.sort(key=lambda x: x[:3])
    targets = range(shards) if into is None else into
    for _ in range(8 * len(held)):
        low = min(targets, key=lambda s: (totals[s], s))
        for high in sorted(range(shards), key=lambda s: (-totals[s], s)):
            gap = totals[high] - totals[low]
            # the largest unit that doesn't overshoot, or the smallest that still helps
            fits = [x for x in units[high] if x[0] * 2 <= gap and x[0]]
            helps = [x for x in units[high] if gap > x[0] > gap // 2]
            pick = fits[-1] if fits else None
            if helps and (pick is None or gap - helps[0][0] < pick[0]):
                pick = helps[0]
            if pick is not None or into is None:
                break
        if pick is None:
            break
        units[high].remove(pick)
        units[low].append(pick)
        units[low].sort(key=lambda x: x[:3])
        totals[high] -= pick[0]
        totals[low] += pick[0]
        out[pick[3]] = low
    return out


def spread(held: dict[Unit, int], shards: int) -> float:
    """Heaviest less lightest shard, as a part of the fair share."""
    totals = [0] * shards
    for u, shard in held.items():
        totals[shard] += u.size
    fair = sum(totals) / shards
    return (max(totals) - min(totals)) / fair if fair else 0.0


def pieces_needed(seen: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """slot -> pieces, for slots (with bytes and rows) that must be split so that the shards
    can be even.

    No slot is split if moving whole ones is enough; else the limit on what stays whole is
    halved, down to `FINEST` of the fair share. At most `shards / FINEST` pieces are added.
    """
    fair = sum(size for size, _ in seen.values()) / shards
    limit = fair
    while True:
        pieces = {s: min(max(1, -int(-size // max(limit, 1))), max(1, rows)) for s, (size, rows) in seen.items()}
        units = [Unit(s, k, p, seen[s][0] // p) for s, p in pieces.items() for k in range(p)]
        moved = rebalanced(even(units, shards), shards)
        if spread(moved, shards) <= TOLERANCE or limit <= fair * FINEST:
            return {s: p for s, p in pieces.items() if p > 1}
        limit /= 2


class SlotMap:
    """The stored map: one folder per version, each holding the whole map of that version.

    A version is written once and never changed; writing one that exists fails, so of two
    writers one has to read the newer version and edit that.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, version: int) -> str:
        return f"{self.path}/version={version:08d}"

    def store(self, version: int, held: dict[Unit, int]) -> DataFrame:
        rows = [(u.slot, u.piece, u.pieces, u.size, shard) for u, shard in sorted(held.items(), key=lambda x: (x[0].slot, x[0].piece))]
        made = self.spark.createDataFrame(rows, "slot int, piece int, pieces int, bytes long, shard int")
        made.coalesce(1).write.mode("errorifexists").parquet(self.folder(version))
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        stored = self.spark.read.parquet(self.folder(version))
        return stored.select(F.lit(version).cast("long").alias("version"), *stored.columns)

    def held(self, version: int) -> dict[Unit, int]:
        """At most slots + pieces rows."""
        return {Unit(r.slot, r.piece, r.pieces, r.bytes): r.shard for r in self.read(version).collect()}

    def grow(self, version: int, shards: int) -> DataFrame:
        """The next version, with one more shard than `shards`: units move into the new one
        only, until it holds its share."""
        held = rebalanced(self.held(version), shards + 1, into=[shards])
        return self.store(version + 1, held)

    def moves(self, old: int, new: int) -> DataFrame:
        """(slot, piece, bytes, from_shard, to_shard): the edits between two versions."""
        a = self.read(old).select("slot", "piece", F.col("shard").alias("from_shard"))
        b = self.read(new).select("slot", "piece", "bytes", F.col("shard").alias("to_shard"))
        return b.join(a, ["slot", "piece"]).where("from_shard <> to_shard").select(
            "slot", "piece", "bytes", "from_shard", "to_shard"
        )


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def shard(
    df: DataFrame,
    key: Column,
    size: Column,
    shards: int = 8,
    slots: int = SLOTS,
    path: str | None = None,
) -> tuple[DataFrame, SlotMap]:
    """The rows of `df` with shard, place, virtual_slot, slot_piece and map_version, and
    the stored map.

    `key` is hashed into `slots` slots, `size` are a record's bytes. `place` numbers the
    rows of a shard from 0 without gaps. Rows of equal keys share a shard unless their slot
    has to be split; a null key is a key like others; a null size counts 0. Rows that repeat are
    rows of their own. An empty table gives no rows and a map of empty slots. The five
    names are taken: columns of `df` so named are replaced.

    `df` is written once with its slots, so pass the columns the result needs.
    """
    spark = df.sparkSession
    work = Scratch(spark, "shards")
    own = ["shard", "place", "virtual_slot", "slot_piece", "map_version"]
    kept = [c for c in df.columns if c.lower() not in own]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    dealt = work.table(
        df.select(
            row,
            slot_of(key, slots).alias("_slot"),
            F.coalesce(size.cast("long"), F.lit(0)).alias("_size"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "dealt",
    )
    per_slot = dealt.groupBy("_slot").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"))
    # one row per slot
    seen = {r["_slot"]: (r["bytes"], r["rows"]) for r in per_slot.collect()}
    pieces = pieces_needed(seen, shards)
    # pieces of the map, and for numbering alone parts of slots of very many rows
    part_rows = max(LEAST_PART, WIDE * sum(rows for _, rows in seen.values()) // slots)
    parts = {s: -(-rows // part_rows) for s, (_, rows) in seen.items()}
    cuts = [(s, pieces.get(s, 1), max(1, -(-parts.get(s, 1) // pieces.get(s, 1)))) for s in range(slots)]
    cut = F.broadcast(spark.createDataFrame(cuts, "_slot int, _pieces int, _parts int"))
    salt = F.xxhash64(F.lit("piece"), "_at")
    placed = dealt.join(cut, "_slot").select(
        "_row", "_slot", "_size", "_at", "_pieces",
        F.pmod(salt, F.col("_pieces")).cast("int").alias("_piece"),
        F.pmod(F.xxhash64(F.lit("part"), "_at"), F.col("_parts")).cast("int").alias("_part"),
    )
    per_part = work.table(
        placed.groupBy("_slot", "_piece", "_part").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")), "parts"
    )
    per_unit = per_part.groupBy("_slot", "_piece").agg(F.sum("bytes").alias("bytes"))
    found = {(r["_slot"], r["_piece"]): r["bytes"] for r in per_unit.collect()}
    units = [Unit(s, k, p, found.get((s, k), 0)) for s, p, _ in cuts for k in range(p)]
    stored = SlotMap(spark, path or work.path("map"))
    first = even(units, shards)
    stored.store(1, first)
    stored.store(2, rebalanced(first, shards))
    now = stored.read(2).select("version", F.col("slot").alias("_slot"), F.col("piece").alias("_piece"), "shard")
    # where each part begins in its shard: one row per part, by shard
    begins = per_part.join(F.broadcast(now), ["_slot", "_piece"]).select(
        "_slot", "_piece", "_part", "shard", "version",
        (F.sum("rows").over(Window.partitionBy("shard").orderBy("_slot", "_piece", "_part")) - F.col("rows")).alias("begin"),
    )
    begins = work.table(begins, "begins")
    at = Window.partitionBy("_slot", "_piece", "_part").orderBy("_at")
    numbered = placed.withColumn("_n", F.row_number().over(at).cast("long") - 1)
    return (
        numbered.join(begins, ["_slot", "_piece", "_part"]).select(
            "_row.*",
            "shard",
            (F.col("begin") + F.col("_n")).alias("place"),
            F.col("_slot").alias("virtual_slot"),
            F.col("_piece").alias("slot_piece"),
            F.col("version").alias("map_version"),
        ),
        stored,
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """The records, in one folder per shard."""
    sharded.write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes; equal texts share a slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    sharded, _ = shard(docs, F.col("text_key"), F.col("size"), shards=8)
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "slot_piece",
        "map_version",
    )

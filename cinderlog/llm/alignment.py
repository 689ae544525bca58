"""Alignment of two tokenizers' tokens, with corpus-wide counts by minimal perfect hashing.

A document's tokens under both tokenizers cover the same bytes. Every stretch between two
neighbouring token ends, of either side, is the overlap of exactly one token of A with one
of B: a link. Offsets where tokens of both end cut the document into groups.

Neither tokenizer merges anything over a space that follows another character, so texts are cut
there, and a worker encodes each distinct stretch once, as long as it remembers it.

First pass: documents are aligned, and each task counts, for the pairs of ids it meets, its
documents that hold them. The distinct pairs are dealt into parts by hash; the tasks' sets
of a part are united in a tree, and a minimal perfect hash numbers them from 0 without gaps:
levels of bit arrays, a pair's place being its first level without collision. Counts
become dense vectors indexed by that hash, one per part and branch of tasks, and are
summed up the tree. The pairs are kept in the order of their numbers, so that a lookup
verifies them.

Second pass: documents are aligned again and each link's count looked up. The hash is
broadcast if it holds at most `BROADCAST_PAIRS` pairs; else the links of a document are sent to the
parts of the hash, and their sums come back. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderlog.llm.common import Scratch, in_slices, table
from cinderlog.llm.tokens import _byte_letters, _ranks, encoder, public_tokenizer

#: Parts of the distinct pairs, and branches that meet at a node of the trees.
PARTS, FAN = 256, 16
BROADCAST_PAIRS = 4_000_000
#: Pairs a task holds before it sums them up.
HELD = 2_000_000
#: Bytes of texts that are aligned together.
SLICE_BYTES = 2_000_000
#: Stretches a worker remembers, the characters of the longest it does, and how many new ones
#: are encoded together.
REMEMBERED, LONGEST, TOGETHER = 400_000, 64, 2_000
#: Places per pair and level of the hash; levels end when no pair is left.
SPARSE, LEVELS = 1.6, 64

_SHIFT = np.int64(24)  # ids are below 2**24
_LOW = np.int64((1 << 24) - 1)


# --- tokens --------------------------------------------------------------------------------


class Side:
    """One tokenizer: ids of a text, and the bytes of each id."""

    def __init__(self, encode: Callable[[str], list[int]], pieces: list[bytes], cuts_at_spaces: bool):
        self.encode, self.pieces, self.cuts_at_spaces = encode, pieces, cuts_at_spaces
        self.sizes = np.array([len(x) for x in pieces], np.int64)

    @classmethod
    def byte_level(cls, path: str) -> Side:
        """A byte-level BPE; a space is put before the text."""
        import json

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = _byte_letters()
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            pieces[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        ids = encoder(path).ids
        # run by rank, it first cuts texts by a pattern that never goes on from a word into a space
        return cls(lambda text: ids(" " + text), pieces, _ranks(path) is not None)

    @classmethod
    def sentence_pieces(cls, path: str) -> Side:
        """A SentencePiece model, which puts the space before the text itself."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        pieces = [
            bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
        # a merged piece with a space after another character would have to be in the vocabulary
        return cls(model.encode, pieces, not any("▁" in name.lstrip("▁") for name in names))


_STRETCH = re.compile(r" +[^ ]+(?:(?<=\s) +[^ ]+)*")


def stretches(text: str) -> list[str]:
    """The text with a space before it, cut where a space follows anything but white space."""
    said = " " + text
    body = said.rstrip(" ")
    found = _STRETCH.findall(body)
    if not found:
        return [said]
    found[-1] += said[len(body) :]
    return found


class Encoders:
    """Both tokenizers, and the stretches they have encoded."""

    def __init__(self, left: Side, right: Side):
        self.left, self.right = left, right
        by_stretch = left.cuts_at_spaces and right.cuts_at_spaces
        self.cut = stretches if by_stretch else lambda text: [" " + text]
        n = max(len(left.pieces), len(right.pieces))
        self.names = {end: _labels(n, end) for end in ",|;"}
        #: stretch -> its ids on both sides (64-bit), None if they don't spell it
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def _encoded(self, said: str) -> tuple[np.ndarray, np.ndarray] | None:
        a, b, wanted = self.left.encode(said[1:]), self.right.encode(said[1:]), said.encode("utf-8", "surrogatepass")
        if b"".join(map(self.left.pieces.__getitem__, a)) != wanted or b"".join(map(self.right.pieces.__getitem__, b)) != wanted:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def _learn(self, new: list[str]) -> None:
        # stretches that end in a word and begin with a space may follow each other in one text
        plain = [x for x in new if len(x) <= LONGEST and not x[-1].isspace()] if self.cut is stretches else []
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            both = self._encoded("".join(some))
            if both is None:
                continue  # some stretch isn't spelled: each by itself, below
            ends = np.cumsum([len(x.encode("utf-8", "surrogatepass")) for x in some])
            cuts = [[0, *np.searchsorted(np.cumsum(side.sizes[ids]), ends, "right").tolist()] for side, ids in zip((self.left, self.right), both)]
            a, b = (ids.tobytes() for ids in both)
            for x, i, j, k, m in zip(some, cuts[0], cuts[0][1:], cuts[1], cuts[1][1:]):
                self.known[x] = a[8 * i : 8 * j], b[8 * k : 8 * m]
        for x in new:
            if x not in self.known:
                one = self._encoded(x) if len(x) > 1 else None
                self.known[x] = one and (one[0].tobytes(), one[1].tobytes())

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Per text its ids on both sides; None if it is null or empty, or isn't spelled."""
        cut = [self.cut(x) if x else [] for x in texts]
        known = self.known
        new = [x for x in dict.fromkeys(y for row in cut for y in row) if x not in known]
        self._learn(new)
        out = []
        for row in cut:
            told = [known[x] for x in row]
            spelled = told and None not in told
            out.append((b"".join([x[0] for x in told]), b"".join([x[1] for x in told])) if spelled else None)
        for x in new:
            if len(x) > LONGEST:
                del known[x]
        if len(known) > REMEMBERED:
            # frequent stretches were met early: the older half stays
            for x in list(islice(reversed(known), len(known) - REMEMBERED // 2)):
                del known[x]
        return out


_ENCODERS: dict[tuple[str, str], Encoders] = {}


def encoders(path_a: str, path_b: str) -> Encoders:
    """Once per Python worker."""
    if (path_a, path_b) not in _ENCODERS:
        _ENCODERS[path_a, path_b] = Encoders(Side.byte_level(path_a), Side.sentence_pieces(path_b))
    return _ENCODERS[path_a, path_b]


@dataclass
class Aligned:
    """Texts aligned together, end to end. `docs` numbers the texts that have tokens."""

    docs: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_common: np.ndarray  # does the token end where one of B ends?
    b_common: np.ndarray
    pairs: np.ndarray  # of links, in order
    a_cuts: np.ndarray  # where each text begins, and the end
    b_cuts: np.ndarray
    group_cuts: np.ndarray
    link_cuts: np.ndarray


def align(texts: list[str | None], both: Encoders) -> Aligned:
    """Texts that are null or empty, or whose tokens don't spell the text with a space before
    it, have no tokens."""
    told = both.ids(texts)
    docs = [k for k, ids in enumerate(told) if ids]
    left, right = both.left, both.right
    ids_a, ids_b = ([np.frombuffer(told[k][side], np.int64) for k in docs] for side in (0, 1))
    nothing = np.zeros(0, np.int64)
    a, b = np.concatenate([nothing, *ids_a]), np.concatenate([nothing, *ids_b])
    a_ends, b_ends = np.cumsum(left.sizes[a]), np.cumsum(right.sizes[b])
    length = int(a_ends[-1]) if len(a) else 0
    in_a, in_b = np.zeros(length + 1, bool), np.zeros(length + 1, bool)
    in_a[a_ends] = True
    in_b[b_ends] = True
    at = np.flatnonzero(in_a | in_b)
    a_here, b_here = in_a[at], in_b[at]
    a_at = np.cumsum(a_here) - a_here
    b_at = np.cumsum(b_here) - b_here
    common = np.flatnonzero(in_a & in_b)
    a_cuts, b_cuts = (np.cumsum([0, *map(len, ids)]) for ids in (ids_a, ids_b))
    cuts = np.concatenate([[0], a_ends])[a_cuts]
    return Aligned(
        np.array(docs, np.int64), a, b, in_b[a_ends], in_a[b_ends], (a[a_at] << _SHIFT) | b[b_at], a_cuts, b_cuts,
        np.searchsorted(common, cuts, "right"), np.searchsorted(at, cuts, "right"),
    )


def _labels(n: int, end: str) -> np.ndarray:
    return np.array([f"{i}{end}" for i in range(n)], "S")


def group_texts(found: Aligned, names: dict[str, np.ndarray]) -> Iterator[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text: ids of A and B, group by group."""
    a_group = np.cumsum(found.a_common) - found.a_common
    b_group = np.cumsum(found.b_common) - found.b_common
    n = int(found.group_cuts[-1]) if len(found.docs) else 0
    a_in, b_in = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    b_before, a_until = np.cumsum(b_in) - b_in, np.cumsum(a_in)
    width = max(x.dtype.itemsize for x in names.values())
    out = np.empty(len(found.a) + len(found.b), f"S{width}")
    out[np.arange(len(found.a)) + b_before[a_group]] = np.where(found.a_common, names["|"][found.a], names[","][found.a])
    out[np.arange(len(found.b)) + a_until[b_group]] = np.where(found.b_common, names[";"][found.b], names[","][found.b])
    cuts = found.a_cuts + found.b_cuts
    for k in range(len(found.docs)):
        yield out[cuts[k] : cuts[k + 1]].tobytes().translate(None, b"\0")[:-1]


# --- minimal perfect hash ------------------------------------------------------------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _place(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """A place below `size` (under 2**32) in the bit array of a level."""
    return ((_mixed(keys, level + 1) >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)).astype(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return _place(keys, -1, parts)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(bits, sizes): the bit arrays of all levels one after another, and their sizes, for
    distinct keys. The number of a key is the number of bits set before its own."""
    bits, sizes, left = [], [], keys
    for level in range(LEVELS):
        if not len(left):
            return np.concatenate([np.zeros(0, bool), *bits]), sizes
        size = int(len(left) * SPARSE) + 1
        at = _place(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        left = left[~alone[at]]
    raise ValueError("keys are not distinct")


class PerfectHash:
    """The hashes of some parts, their numbers following each other, with verified keys."""

    def __init__(self, parts: int, hashes: dict[int, tuple[np.ndarray, list[int], np.ndarray]]):
        """hashes: part -> (bits, sizes of levels, keys in the order of their numbers)"""
        levels = max([len(s) for _, s, _ in hashes.values()], default=0)
        self.parts = parts
        self.base, self.size = np.zeros((levels, parts), np.int64), np.zeros((levels, parts), np.int64)
        at = 0
        for part, (bits, sizes, _) in hashes.items():
            starts = np.cumsum([0, *sizes])
            self.base[: len(sizes), part] = at + starts[:-1]
            self.size[: len(sizes), part] = sizes
            at += len(bits)
        bits = np.concatenate([np.zeros(0, bool), *[x[0] for x in hashes.values()]])
        self.slot = np.where(bits, np.cumsum(bits) - 1, -1).astype(np.int32)
        self.keys = np.concatenate([np.zeros(0, np.int64), *[x[2] for x in hashes.values()]])

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for keys that aren't among the hashed ones."""
        out = np.full(len(keys), -1, np.int64)
        left, part = np.arange(len(keys)), part_of(keys, self.parts)
        for level in range(len(self.size)):
            size = self.size[level][part]
            if not size.all():
                held = size > 0
                left, keys, part, size = left[held], keys[held], part[held], size[held]
            if not len(left):
                break
            slot = self.slot[self.base[level][part] + _place(keys, level, size)]
            out[left] = slot
            missed = slot < 0
            left, keys, part = left[missed], keys[missed], part[missed]
        return out

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """Numbers, -1 where the key kept under the number is another one."""
        at = self.numbers(keys)
        if len(self.keys):
            at[(at >= 0) & (self.keys[at] != keys)] = -1
        return at


# --- first pass: counts ------------------------------------------------------------------------


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _documents_with(found: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the number of texts that hold each."""
    if not len(found.pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = [np.unique(found.pairs[lo:hi]) for lo, hi in zip(found.link_cuts, found.link_cuts[1:])]
    return np.unique(np.concatenate(held), return_counts=True)


def pair_counts(df: DataFrame, text_col: str, path_a: str, path_b: str, parts: int) -> DataFrame:
    """(part, task, keys, counts): per task and part, pairs and the documents with them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = encoders(path_a, path_b)
        task = TaskContext.get().partitionId()
        keys, counts = [], []

        def count(batch: pa.RecordBatch) -> None:
            k, c = _documents_with(align(batch.column(0).to_pylist(), both))
            keys.append(k), counts.append(c)
            if sum(map(len, keys)) > HELD:
                k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                keys[:], counts[:] = [k], [c]

        for _ in in_slices(count, column=0, size=SLICE_BYTES)(batches):
            pass
        if keys:
            k, c = _summed(np.concatenate(keys), np.concatenate(counts))
            at = part_of(k, parts)
            for part in np.unique(at).tolist():
                mine = at == part
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([task], pa.int32()),
                        pa.array([k[mine].tobytes()], pa.binary()),
                        pa.array([c[mine].tobytes()], pa.binary()),
                    ],
                    ["part", "task", "keys", "counts"],
                )

    return df.select(text_col).mapInArrow(work, "part int, task int, keys binary, counts binary")


def _numbers(value) -> np.ndarray:
    return np.frombuffer(value, np.int64)


def _union(rows: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([_numbers(x) for x in rows.column("keys").to_pylist()]))
    return pa.table({
        "part": pa.array(rows.column("part").to_pylist()[:1], pa.int32()),
        "task": pa.array([rows.column("task")[0].as_py() // FAN], pa.int32()),
        "keys": pa.array([keys.tobytes()], pa.binary()),
    })


def _sum(rows: pa.Table) -> pa.Table:
    total = None
    for x in rows.column("counts").to_pylist():
        x = _numbers(x)
        total = x.copy() if total is None else total + x
    return pa.table({
        "part": pa.array(rows.column("part").to_pylist()[:1], pa.int32()),
        "task": pa.array([rows.column("task")[0].as_py() // FAN], pa.int32()),
        "counts": pa.array([total.tobytes()], pa.binary()),
    })


def _up_the_tree(df: DataFrame, tasks: int, node: Callable[[pa.Table], pa.Table], schema: str, work: Scratch, name: str) -> DataFrame:
    """One row per part, from one row per part and task, at most `FAN` meeting at a node."""
    while tasks > 1:
        df = work.table(
            df.withColumn("_node", F.floor(F.col("task") / FAN)).groupBy("part", "_node").applyInArrow(lambda t: node(t.drop_columns(["_node"])), schema),
            name,
        )
        tasks = -(-tasks // FAN)
    return df


def _hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The hash of each part's keys, and the keys in the order of their numbers."""
    out_bits, out_sizes, out_keys, out_n = [], [], [], []
    for value in batch.column(1):
        keys = _numbers(value.as_buffer())
        bits, sizes = build_hash(keys)
        one = PerfectHash(1, {0: (bits, sizes, keys)})
        ordered = np.empty(len(keys), np.int64)
        # within one part, all keys are in part 0
        ordered[one.numbers(keys)] = keys
        out_bits.append(np.packbits(bits).tobytes())
        out_sizes.append(sizes)
        out_keys.append(ordered.tobytes())
        out_n.append(len(keys))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(out_n, pa.int64()), pa.array(out_bits, pa.binary()), pa.array(out_sizes, pa.list_(pa.int64())), pa.array(out_keys, pa.binary())],
        ["part", "n", "bits", "sizes", "keys"],
    )


def _unpacked(row: dict) -> tuple[np.ndarray, list[int], np.ndarray]:
    sizes = list(row["sizes"])
    return np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool), sizes, _numbers(row["keys"])


def _dense(rows: pa.Table, hashes: pa.Table) -> pa.Table:
    """The counts of several tasks as one vector, indexed by the hash of their part."""
    told = hashes.slice(0, 1).to_pylist()[0]
    one = PerfectHash(1, {0: _unpacked(told | {"keys": told["hashed"]})})
    out = np.zeros(len(one.keys), np.int64)
    for keys, counts in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist()):
        at = one.verified(_numbers(keys))
        if (at < 0).any():
            raise ValueError("a counted pair is not among the hashed ones")
        out[at] += _numbers(counts)
    return pa.table({
        "part": pa.array(rows.column("part").to_pylist()[:1], pa.int32()),
        "task": pa.array([rows.column("node")[0].as_py()], pa.int32()),
        "counts": pa.array([out.tobytes()], pa.binary()),
    })


_HASHED = "part int, n long, bits binary, sizes array<long>, keys binary"


def pair_table(df: DataFrame, text_col: str, path_a: str, path_b: str, parts: int, work: Scratch) -> DataFrame:
    """(part, n, bits, sizes, keys, counts): per part the minimal perfect hash of its distinct pairs, the pairs
    and their corpus-wide document counts in the order of their numbers."""
    counted = work.table(pair_counts(df, text_col, path_a, path_b, parts), "counted")
    tasks = (counted.agg(F.max("task")).first()[0] or 0) + 1
    united = _up_the_tree(counted.select("part", "task", "keys"), max(tasks, 2), _union, "part int, task int, keys binary", work, "pairs")
    hashes = work.table(united.select("part", "keys").mapInArrow(in_slices(_hashed, rows=1), _HASHED), "hash")
    nodes = counted.withColumn("node", F.floor(F.col("task") / FAN).cast("int"))
    wanted = nodes.select("part", "node").distinct().join(hashes, "part")
    wanted = wanted.select(F.col("part").alias("_part"), F.col("node").alias("_node"), "bits", "sizes", F.col("keys").alias("hashed"))
    vectors = work.table(
        nodes.groupBy("part", "node").cogroup(wanted.groupBy("_part", "_node")).applyInArrow(_dense, "part int, task int, counts binary"),
        "vectors",
    )
    total = _up_the_tree(vectors, -(-tasks // FAN), _sum, "part int, task int, counts binary", work, "sums")
    return work.table(hashes.join(total.select("part", "counts"), "part"), "pair-table")


def most_documents(pairs: DataFrame) -> DataFrame:
    """(a, most): the highest count of a pair of each id of A."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = _numbers(batch.column(0)[0].as_buffer()), _numbers(batch.column(1)[0].as_buffer())
        a, at = np.unique(keys >> _SHIFT, return_inverse=True)
        most = np.zeros(len(a), np.int64)
        np.maximum.at(most, at, counts)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(most)], ["a", "most"])

    return pairs.select("keys", "counts").mapInArrow(in_slices(work, rows=1), "a long, most long").groupBy("a").agg(F.max("most").alias("most"))


def pair_rows(pairs: DataFrame) -> DataFrame:
    """(a, b, documents): the table of counts in the open, one row per pair."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = _numbers(batch.column(0)[0].as_buffer()), _numbers(batch.column(1)[0].as_buffer())
        return pa.RecordBatch.from_arrays([pa.array(keys >> _SHIFT), pa.array(keys & _LOW), pa.array(counts)], ["a", "b", "documents"])

    return pairs.select("keys", "counts").mapInArrow(in_slices(work, rows=1), "a long, b long, documents long")


# --- second pass: lookups ---------------------------------------------------------------------

_COUNTED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _facts(found: Aligned, n: int, names: dict[str, np.ndarray]) -> list[pa.Array]:
    """The columns of `_COUNTED` for n texts."""
    columns = []
    for cuts in (found.a_cuts, found.b_cuts, found.group_cuts, found.link_cuts):
        column = np.zeros(n, np.int64)
        column[found.docs] = np.diff(cuts)
        columns.append(pa.array(column))
    hashes = [""] * n
    for k, text in zip(found.docs.tolist(), group_texts(found, names)):
        hashes[k] = hashlib.sha256(text).hexdigest()
    return [*columns, pa.array(hashes, pa.string())]


def _sums(found: Aligned, n: int, counts: np.ndarray, best: np.ndarray) -> list[pa.Array]:
    """n_best and count_sum of n texts, from the links' counts and whether they are best."""
    out = []
    for values in (best, counts):
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        column = np.zeros(n, np.int64)
        column[found.docs] = np.diff(total[found.link_cuts])
        out.append(pa.array(column))
    return out


def aligned_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_a: str | None = None,
    path_b: str | None = None,
    parts: int = PARTS,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per row.

    Texts that are null or empty, or that the tokens of either side don't spell, have zeros and ''.
    A link is best if its pair's document count is the highest of its A id, ties included. Rows that
    repeat are documents of their own; ids aren't read but passed on. An empty table gives no
    rows. Other columns are not read.
    """
    spark = df.sparkSession
    work = Scratch(spark, "alignment")
    path_a = path_a or public_tokenizer("byte_bpe_50k.json")
    path_b = path_b or public_tokenizer("piece_bpe_32k.model")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pairs = pair_table(rows, "text", path_a, path_b, parts, work)
    # one row per id of A
    most = {r["a"]: r["most"] for r in most_documents(pairs).collect()}
    highest = np.zeros(max(most, default=0) + 1, np.int64)
    for a, n in most.items():
        highest[a] = n
    n_pairs = pairs.agg(F.sum("n")).first()[0] or 0
    if n_pairs <= broadcast_pairs:
        return _by_broadcast(rows, pairs, highest, path_a, path_b, parts)
    return _by_parts(rows, pairs, highest, path_a, path_b, parts, work)


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def _by_broadcast(rows: DataFrame, pairs: DataFrame, highest: np.ndarray, path_a: str, path_b: str, parts: int) -> DataFrame:
    """For at most `broadcast_pairs` pairs."""
    held = {r["part"]: r for r in pairs.toArrow().to_pylist()}
    hashes = PerfectHash(parts, {part: _unpacked(r) for part, r in held.items()})
    counts = np.concatenate([np.zeros(0, np.int64), *[_numbers(r["counts"]) for r in held.values()]])
    counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    known = rows.sparkSession.sparkContext.broadcast((hashes, counts, highest))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts, highest = known.value
        both = encoders(path_a, path_b)
        found = align(batch.column(1).to_pylist(), both)
        at = hashes.verified(found.pairs)
        if (at < 0).any():
            raise ValueError("a link has no count: the documents changed between the passes")
        count = counts[at].astype(np.int64) if len(at) else at
        best = count == highest[found.pairs >> _SHIFT]
        n = batch.num_rows
        *facts, sha = _facts(found, n, both.names)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *facts, *_sums(found, n, count, best), sha],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        )

    schema = f"doc_id {_kind(rows)}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.mapInArrow(in_slices(work, column=1, size=SLICE_BYTES), schema)


def _by_parts(rows: DataFrame, pairs: DataFrame, highest: np.ndarray, path_a: str, path_b: str, parts: int, work: Scratch) -> DataFrame:
    """The links of each slice of documents go to the parts of the hash; sums come back."""
    kind = _kind(rows)
    known = rows.sparkSession.sparkContext.broadcast(highest)  # one number per id of A

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = encoders(path_a, path_b)
        found = align(batch.column(2).to_pylist(), both)
        n = batch.num_rows
        doc = np.repeat(found.docs, np.diff(found.link_cuts))
        at = part_of(found.pairs, parts)
        places, sent, docs = [], [], []
        for part in np.unique(at).tolist():
            mine = at == part
            places.append(part), sent.append(found.pairs[mine].tobytes()), docs.append(doc[mine].astype("<i8").tobytes())
        m = len(places)
        rids = np.array(batch.column(0).to_pylist(), np.int64)
        facts = [pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in _facts(found, n, both.names)]
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([batch.column(0).cast(pa.int64()), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([batch.column(1), pa.nulls(m, batch.column(1).type)]),
                *facts,
                pa.array([None] * n + places, pa.int32()),
                pa.array([None] * n + sent, pa.binary()),
                pa.array([None] * n + [rids[np.frombuffer(d, "<i8")].tobytes() for d in docs], pa.binary()),
            ],
            ["rid", "doc_id", *[x.split()[0] for x in _COUNTED.split(", ")], "part", "links", "docs"],
        )

    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    sent = work.table(
        numbered.mapInArrow(
            in_slices(send, column=2, size=SLICE_BYTES),
            f"rid long, doc_id {kind}, {_COUNTED}, part int, links binary, docs binary",
        ),
        "links",
    )

    def look_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.to_pylist()[0]
        one = PerfectHash(1, {0: _unpacked(row)})
        links, docs = _numbers(row["links"]), _numbers(row["docs"])
        at = one.verified(links)
        if (at < 0).any():
            raise ValueError("a link has no count: the documents changed between the passes")
        count = _numbers(row["counts"])[at]
        best = count == known.value[links >> _SHIFT]
        rid, where = np.unique(docs, return_inverse=True)
        sums = np.zeros((2, len(rid)), np.int64)
        np.add.at(sums[0], where, best)
        np.add.at(sums[1], where, count)
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(sums[0]), pa.array(sums[1])], ["rid", "n_best", "count_sum"])

    links = sent.where("part is not null").select("part", "links", "docs")
    sums = (
        links.join(pairs, "part")
        .select("sizes", "bits", "keys", "counts", "links", "docs")
        .mapInArrow(in_slices(look_up, rows=1), "rid long, n_best long, count_sum long")
        .groupBy("rid")
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        sent.where("part is null")
        .join(sums, "rid", "left")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between the two public tokenizers."""
    return aligned_counts(table(spark, sf_dir, "documents"))

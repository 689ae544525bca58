"""Template mining.

Lines are mined in order: a token sequence is routed to a leaf by its length and its
first tokens, compared with the leaf's templates, and merged into the best one or made
a new template. The result depends on the order, yet almost all of the work does not:

* Leaves do not influence each other, and routing needs only first arrivals per node.
* Once a sequence is absorbed, its template covers it (every position equal or
  wildcard) for good, so only the first occurrence of a sequence can change anything.
  Mining runs on distinct sequences with their first line.
* The first sequence of a leaf always founds its first template, which is a plain
  aggregate. What is left is folded leaf by leaf in line order. An inverted index from
  position and token to templates finds the best one: a sequence meets only the
  templates it shares a token with, not all of its leaf.
* A leaf of up to `LARGEST_BLOCK` sequences is folded at once, so the number of rounds does
  not depend on it. A wider one takes a block a round, and what its templates now cover is dropped.

A round gives a task at most one block per leaf and the templates that block can touch.
Every state change is kept as a version ``(leaf, created, from_line, tokens)``; a
template is named by the line that created it.

Tokens are written, shuffled and passed to Python joined into one text, which costs far less
than a list of them; they are split where they are used.

Which templates cover a sequence is found by walking a trie of the leaf's wildcard
patterns, along the sequence's token and along the wildcard at each position. A walk yields
the steps of the sequence alone, so rows stay in proportion to the sequences.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..functions.masks import tokens as split_tokens
from ..functions.regex import has_digit
from ..session import Workspace
from .numbering import join_narrow

# Never part of a token: tokens are split on it.
_STEP = "\x1f"
VERSION_SCHEMA = "leaf string, created bigint, from_line bigint, tokens array<string>"
PACKED_VERSION_SCHEMA = "leaf string, created bigint, from_line bigint, tokens string"

FIRST_BLOCK = LARGEST_BLOCK = 50_000
LEAF_TEMPLATES = 50_000
ROWS_PER_FOLD = 20_000
ROWS_PER_WALK = 50_000
# Agreements counted one by one; more are counted by numpy.
FEW = 64
BROADCAST_STEPS = 100_000
# Full nodes, each with a list of keys, that are sent to all tasks.
BROADCAST_NODES = 20_000
# Ranges of lines per block that the sequences of a wide leaf are counted in.
RANGES_PER_BLOCK = 16


# --- token level -------------------------------------------------------------------


def routing_key(token: Column) -> Column:
    """A mask sign routes as itself, any other token with a digit as the wildcard."""
    is_sign = F.startswith(token, F.lit("<")) & F.endswith(token, F.lit(">"))
    return F.when(~is_sign & has_digit(token), fixed.WILDCARD).otherwise(token)


def routing_keys(tokens: Column, depth: int = fixed.MAX_DEPTH) -> Column:
    return F.transform(F.slice(tokens, 1, depth), routing_key)


def similarity(template: Column, tokens: Column) -> Column:
    """Share of positions where the template has the same token or the wildcard."""
    agrees = F.zip_with(template, tokens, lambda t, s: (t == fixed.WILDCARD) | (t == s))
    return F.size(F.filter(agrees, lambda ok: ok)) / F.size(tokens)


def merge(template: Column, tokens: Column) -> Column:
    """The template with the wildcard wherever the tokens differ."""
    return F.zip_with(
        template, tokens, lambda t, s: F.when(t == s, t).otherwise(fixed.WILDCARD)
    )


def pattern(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


# --- token lists as one text ---------------------------------------------------------


def packed(df: DataFrame) -> DataFrame:
    """The table with its token lists joined; a list holds at least one token."""
    return df.withColumn("tokens", F.array_join("tokens", _STEP))


def unpacked(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", F.split("tokens", _STEP, -1))


def _has_wildcard(tokens: Column) -> Column:
    return F.contains(F.concat(F.lit(_STEP), tokens, F.lit(_STEP)), F.lit(f"{_STEP}{fixed.WILDCARD}{_STEP}"))


# --- distinct sequences and routing --------------------------------------------------


def sequence_text(masked: Column) -> Column:
    """Masked text as the name of its token sequence."""
    return F.when(masked == "", fixed.EMPTY_TOKEN).otherwise(masked)


def distinct_sequences(events: DataFrame) -> DataFrame:
    """``(sequence, first_line, events, tokens)`` per distinct masked text. Repeats are
    folded on the map side, so a text that makes up most of the log costs nothing."""
    return (
        events.groupBy(sequence_text(F.col("masked")).alias("sequence"))
        .agg(F.min("line_no").alias("first_line"), F.count("*").alias("events"))
        .withColumn("tokens", split_tokens(F.col("sequence")))
    )


def digest(sequence: Column) -> Column:
    """What stands for the name of a sequence where names would be shuffled: 128 bits of its SHA-256."""
    return F.unhex(F.left(F.sha2(sequence, 256), F.lit(32)))


def by_digest(named: DataFrame) -> DataFrame:
    """The table with its sequences named by their digests, if they aren't yet."""
    if dict(named.dtypes)["sequence"] == "binary":
        return named
    return named.withColumn("sequence", digest(F.col("sequence")))


def full_nodes(children: DataFrame, max_children: int) -> DataFrame:
    """Nodes with more children than allowed, and the keys that still got their own child:
    those that arrived first. Input ``(node, key, line)``.

    The row number keeps at most ``max_children + 1`` rows per node and map task (group
    limit before the shuffle), so no task sees all children of a wide node.
    """
    arrival = W.partitionBy("node").orderBy("line")
    return (
        children.groupBy("node", "key")
        .agg(F.min("line").alias("line"))
        .withColumn("rank", F.row_number().over(arrival))
        .filter(F.col("rank") <= max_children + 1)
        .groupBy("node")
        .agg(
            F.max("rank").alias("children"),
            F.collect_list(F.when(F.col("rank") <= max_children, F.col("key"))).alias("own"),
        )
        .filter(F.col("children") > max_children)
        .select("node", "own")
    )


def _first_full_level(sequences: DataFrame, max_children: int) -> int | None:
    """The first level at which some node overflows, in one pass over all levels. Above
    it every key has its own child, so routing is the identity there. Nodes are counted by
    their hash: should two share one, the level is found too early, which costs time only."""
    levels = F.transform(
        F.col("_keys"),
        lambda key, i: F.struct(
            i.alias("level"),
            F.xxhash64(F.concat_ws(_STEP, F.col("leaf"), F.slice(F.col("_keys"), F.lit(1), i))).alias("node"),
            key.alias("key"),
        ),
    )
    return (
        sequences.select(F.explode(levels).alias("at"))
        .select("at.*")
        .distinct()
        .groupBy("level", "node")
        .count()
        .filter(F.col("count") > max_children)
        .agg(F.min("level"))
        .first()[0]
    )


def keyed(sequences: DataFrame, max_depth: int = fixed.MAX_DEPTH) -> DataFrame:
    """What routing reads of the tokens, instead of them: ``_keys``, one per level, and ``leaf``,
    which is the token count so far."""
    return (
        sequences.withColumn("_keys", routing_keys(F.col("tokens"), max(2, max_depth)))
        .withColumn("leaf", F.size("tokens").cast("string"))
        .drop("tokens")
    )


def route(
    workspace: Workspace,
    sequences: DataFrame,
    max_depth: int = fixed.MAX_DEPTH,
    max_children: int = fixed.MAX_CHILDREN,
) -> DataFrame:
    """Adds ``leaf``: token count, then one key per level; a node that is full sends new
    keys to the wildcard child. The tokens of sequences given without their text are dropped;
    sequences may be ``keyed`` already."""
    depth = max(2, max_depth)
    # Written once: each level reads the few keys, not the tokens they come from.
    routed = workspace.table(
        sequences if "_keys" in sequences.columns else keyed(sequences, max_depth), "keys"
    )

    def full_at(level: int) -> DataFrame:
        children = routed.filter(F.size("_keys") > level).select(
            F.col("leaf").alias("node"), F.get("_keys", F.lit(level)).alias("key"), F.col("first_line").alias("line")
        )
        return workspace.table(full_nodes(children, max_children), f"full-nodes-{level}")

    # where texts hardly repeat, the top is full, and the keys of all levels need not be counted
    full = full_at(0)
    first_full = 0 if (known := full.count()) else _first_full_level(routed, max_children)
    for level in range(depth):
        key = F.get("_keys", F.lit(level))
        own_child = key
        if first_full is not None and level >= first_full:
            if level:
                full = full_at(level)
                known = full.count()
            full = full.withColumnRenamed("node", "leaf")
            routed = routed.join(F.broadcast(full) if known <= BROADCAST_NODES else full, "leaf", "left")
            own_child = F.when(
                F.col("own").isNull() | F.array_contains(F.col("own"), key), key
            ).otherwise(fixed.WILDCARD)
        routed = routed.withColumn("leaf", F.concat_ws(_STEP, "leaf", own_child)).drop("own")
    if ("sequence", "string") in sequences.dtypes:
        routed = routed.withColumn("tokens", split_tokens(F.col("sequence")))
    kept = [c for c in sequences.columns if c in routed.columns and c not in ("_keys", "leaf")]
    return routed.select(*kept, "leaf")


def with_founders(sequences: DataFrame) -> DataFrame:
    """Adds ``founds``, whether a sequence is the first of its leaf, and ``alone``, whether it is
    the only one. ``founds`` is null if the line founds another leaf only.

    They are found by line, so wide leaves meet in no task."""
    leaves = sequences.groupBy("leaf").agg(
        F.min("first_line").alias("first_line"), (F.count("*") == 1).alias("alone")
    )
    founded = leaves.groupBy("first_line").agg(F.collect_set(F.struct("leaf", "alone")).alias("_founded"))
    own = F.get(F.filter("_founded", lambda found: found["leaf"] == F.col("leaf")), F.lit(0))
    return (
        sequences.join(founded, "first_line", "left")
        .withColumn("_own", own)
        .withColumn(
            "founds", F.when(F.col("_founded").isNull(), False).when(F.col("_own").isNotNull(), True)
        )
        .withColumn("alone", F.coalesce(F.col("_own.alone"), F.lit(False)))
        .select(*sequences.columns, "founds", "alone")
    )


def _with_tokens(written: DataFrame) -> DataFrame:
    return written.withColumn("tokens", split_tokens(F.col("sequence")))


def routed_table(workspace: Workspace, sequences: DataFrame, *limits: int) -> DataFrame:
    """``route``, written with the founders; the tokens are split off the text again where they
    are read."""
    routed = with_founders(route(workspace, sequences, *limits).drop("tokens"))
    return _with_tokens(workspace.table(routed, "routed"))


def routed_lines(
    workspace: Workspace, lines: DataFrame, max_depth: int = fixed.MAX_DEPTH, *limits: int
) -> DataFrame:
    """``routed_table`` of the distinct texts of ``(line_no, masked)``, which may hardly repeat:
    texts go by their digests until all of them are routed, and are then fetched, once, from
    the lines they come first in."""
    texts = lines.select("line_no", sequence_text(F.col("masked")).alias("_text"))
    named = texts.select("line_no", digest(F.col("_text")).alias("sequence"), split_tokens(F.col("_text")).alias("tokens"))
    sequences = (
        keyed(named, max_depth)
        .groupBy("sequence", "_keys", "leaf")
        .agg(F.min("line_no").alias("first_line"), F.count("*").alias("events"))
    )
    routed = with_founders(route(workspace, sequences, max_depth, *limits))
    found = join_narrow(texts.withColumnRenamed("line_no", "first_line"), routed, "first_line")
    # a line number that comes twice may bring other texts, or this one twice
    own = F.max(F.when(digest(F.col("_text")) == F.col("sequence"), F.col("_text")))
    fetched = found.groupBy(*routed.columns).agg(own.alias("_text"))
    fetched = fetched.drop("sequence").withColumnRenamed("_text", "sequence")
    columns = ("sequence", "first_line", "events", "leaf", "founds", "alone")
    return _with_tokens(workspace.table(fetched.select(*columns), "routed"))


# --- folding -----------------------------------------------------------------------------


class _Leaf:
    """Templates of one leaf, oldest first, with an index of their fixed tokens."""

    def __init__(self) -> None:
        self.created: list[int] = []
        self.tokens: list[list[str]] = []
        self.wild = array("i")  # wildcards per template
        self.postings: dict[tuple[int, str], array] = {}  # (position, token) -> templates
        self.widest = -1  # the oldest template with the most wildcards

    def add(self, created: int, tokens: list[str]) -> None:
        number = len(self.created)
        self.created.append(created)
        self.tokens.append(tokens)
        self.wild.append(0)
        for key in enumerate(tokens):
            if key[1] == fixed.WILDCARD:
                self.wild[number] += 1
            elif key in self.postings:
                self.postings[key].append(number)
            else:
                self.postings[key] = array("i", (number,))
        self._widen(number)

    def _widen(self, number: int) -> None:
        """Keeps `widest` right after a template has been added or got wildcards."""
        most = self.wild[self.widest] if self.widest >= 0 else -1
        if (self.wild[number], -number) > (most, -self.widest):
            self.widest = number

    def best(self, tokens: list[str]) -> tuple[int, int]:
        """The template most positions agree with, the oldest of equals, and their number.

        A template agrees at its wildcards and where it has the same token. One without a
        token in common agrees at its wildcards only, so of those the widest is enough.
        """
        if self.widest < 0:
            return -1, 0
        met = [self.postings[key] for key in enumerate(tokens) if key in self.postings]
        most, best = self.wild[self.widest], self.widest
        if sum(map(len, met)) <= FEW:
            same: dict[int, int] = defaultdict(int)
            for numbers in met:
                for number in numbers:
                    same[number] += 1
            for number, count in same.items():
                count += self.wild[number]
                if count > most or count == most and number < best:
                    most, best = count, number
            return best, most
        counts = np.bincount(np.concatenate([np.frombuffer(numbers, np.intc) for numbers in met]))
        numbers = np.flatnonzero(counts)
        agreement = counts[numbers] + np.frombuffer(self.wild, np.intc)[numbers]
        top = int(agreement.argmax())  # the oldest of equals
        if agreement[top] > most or agreement[top] == most and numbers[top] < best:
            most, best = int(agreement[top]), int(numbers[top])
        return best, most

    def absorb(self, line: int, tokens: list[str], threshold: float) -> tuple[int, list[str]] | None:
        """Folds the sequence in; the changed template, if one has changed."""
        best, most = self.best(tokens)
        if best < 0 or most / len(tokens) < threshold:
            self.add(line, tokens)
            return line, tokens
        if most == len(tokens):
            return None
        merged = list(self.tokens[best])
        for place, (own, token) in enumerate(zip(merged, tokens)):
            if own != token and own != fixed.WILDCARD:
                merged[place] = fixed.WILDCARD
                self.wild[best] += 1
                self.postings[place, own].remove(best)
        self.tokens[best] = merged
        self._widen(best)
        return self.created[best], merged


def _values(table: pa.Table, name: str) -> list:
    values = table.column(name).to_pylist()
    return [text.split(_STEP) for text in values] if name == "tokens" else values


def _rows(table: pa.Table, *names: str, by: str):
    ordered = table.sort_by([("leaf", "ascending"), (by, "ascending")])
    return zip(*[_values(ordered, name) for name in names])


def _indexed(old: pa.Table) -> dict[str, _Leaf]:
    leaves: dict[str, _Leaf] = defaultdict(_Leaf)
    for leaf, created, tokens in _rows(old, "leaf", "created", "tokens", by="created"):
        leaves[leaf].add(created, tokens)
    return leaves


def _fold(threshold: float):
    def fold(block: pa.Table, old: pa.Table) -> pa.Table:
        leaves, changes = _indexed(old), []
        for leaf, line, tokens in _rows(block, "leaf", "first_line", "tokens", by="first_line"):
            change = leaves[leaf].absorb(line, tokens, threshold)
            if change:
                changes.append((leaf, change[0], line, _STEP.join(change[1])))
        columns = list(zip(*changes)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.table(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["leaf", "created", "from_line", "tokens"]
        )

    return fold


def _best_in_part(threshold: float):
    def best(block: pa.Table, old: pa.Table) -> pa.Table:
        leaves, found = _indexed(old), []
        for leaf, line, tokens in _rows(block, "leaf", "first_line", "tokens", by="first_line"):
            number, most = leaves[leaf].best(tokens)
            if number >= 0 and most / len(tokens) >= threshold:
                found.append((line, leaves[leaf].created[number], most))
        columns = list(zip(*found)) or [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.int32())
        return pa.table(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["first_line", "created", "agreement"]
        )

    return best


def _touchable(
    workspace: Workspace, block: DataFrame, old: DataFrame, threshold: float, leaf_templates: int
) -> DataFrame:
    """The templates a block can touch, for leaves with too many to fold in one task. Tokens
    are joined.

    Within a block a sequence is won by a template that has already changed, a new one,
    or the best unchanged one; the last is the best match at the start of the block.
    (A template changed meanwhile agrees at least as well as before, so it keeps its
    lead over all that trailed it.) So the best match of every sequence is enough. It is
    searched over parts of bounded size and then maximised.
    """
    parts = (
        old.groupBy("leaf")
        .count()
        .filter(F.col("count") > leaf_templates)
        .select("leaf", F.ceil(F.col("count") / leaf_templates).cast("int").alias("parts"))
    )
    small = old.join(parts, "leaf", "left_anti")
    large = workspace.table(
        old.join(parts, "leaf").withColumn(
            "part", F.pmod(F.xxhash64("created"), F.col("parts")).cast("int")
        ),
        "parts",
    )
    asked = block.join(parts, "leaf").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    best = (
        asked.groupBy("leaf", "part")
        .cogroup(large.groupBy("leaf", "part"))
        .applyInArrow(
            _best_in_part(threshold), "first_line bigint, created bigint, agreement int"
        )
        .groupBy("first_line")
        .agg(F.max_by("created", F.struct("agreement", -F.col("created"))).alias("created"))
        .select("created")
        .distinct()
    )
    wanted = large.join(best, "created", "left_semi").select(*old.columns)
    return small.select(*old.columns).unionByName(wanted)


def latest(versions: DataFrame) -> DataFrame:
    """Templates as they are after their last change."""
    return versions.groupBy("leaf", "created").agg(
        F.max("from_line").alias("from_line"), F.max_by("tokens", "from_line").alias("tokens")
    )


class _Trie:
    """Wildcard patterns of one leaf; a walk finds those that cover a token sequence."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, tokens: list[str], version: tuple[int, int]) -> None:
        node = self.root
        for token in tokens:
            node = node.setdefault(token, {})
        node.setdefault(None, []).append(version)  # None is no token

    def covering(self, tokens: list[str]) -> list[tuple[int, int]]:
        """The versions ``(from_line, created)`` whose pattern covers the sequence."""
        nodes = [self.root]
        for token in tokens:
            branches = (token, fixed.WILDCARD) if token != fixed.WILDCARD else (token,)
            nodes = [node[branch] for node in nodes for branch in branches if branch in node]
            if not nodes:
                return []
        return [version for node in nodes for version in node[None]]


def _oldest_over_lines(versions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of versions ``(from_line, created)`` those that are the oldest template yet."""
    kept: list[tuple[int, int]] = []
    for from_line, created in sorted(versions):
        if not kept or created < kept[-1][1]:
            kept.append((from_line, created))
    return kept


def _walk(texts: pa.Table, patterns: pa.Table) -> pa.Table:
    tries: dict[tuple, _Trie] = defaultdict(_Trie)
    names = ("leaf", "part", "salt", "from_line", "created", "tokens")
    for *group, from_line, created, tokens in zip(*[_values(patterns, n) for n in names]):
        tries[tuple(group)].add(tokens, (from_line, created))
    steps = []
    names = ("leaf", "part", "salt", "first_line", "tokens")
    for *group, first_line, tokens in zip(*[_values(texts, n) for n in names]):
        group = tuple(group)
        if group in tries:
            steps += [(first_line, *s) for s in _oldest_over_lines(tries[group].covering(tokens))]
    columns = list(zip(*steps)) or [()] * 3
    return pa.table(
        [pa.array(c, pa.int64()) for c in columns], ["first_line", "from_line", "created"]
    )


def covering_versions(
    sequences: DataFrame, versions: DataFrame, rows_per_walk: int = ROWS_PER_WALK
) -> DataFrame:
    """``(first_line, from_line, created)``: the wildcard versions that cover a sequence and
    are the oldest template to do so yet."""
    return _covering(packed(sequences), packed(versions), rows_per_walk)


def _covering(sequences: DataFrame, versions: DataFrame, rows_per_walk: int = ROWS_PER_WALK) -> DataFrame:
    """``covering_versions`` of joined tokens.

    Leaves share a task up to `rows_per_walk` rows. The sequences of a wider leaf are
    salted, each salt with the leaf's patterns; patterns beyond that number are walked in parts.
    """
    patterns = versions.filter(_has_wildcard(F.col("tokens"))).select(
        "leaf", "created", "from_line", "tokens"
    )

    def shares(count: str) -> Column:
        return F.ceil(F.count("*") / rows_per_walk).cast("int").alias(count)

    # written, so that few leaves are broadcast and the texts of all others are not shuffled
    walks = Workspace(sequences.sparkSession).table(
        patterns.groupBy("leaf").agg(shares("parts"))
        .join(sequences.groupBy("leaf").agg(shares("salts")), "leaf"),
        "pattern-parts",
    )

    def spread(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def dealt(key: str, count: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    texts = (
        sequences.select("leaf", "first_line", "tokens")
        .join(walks, "leaf")
        .withColumn("salt", dealt("first_line", "salts"))
        .select("leaf", spread("parts").alias("part"), "salt", "first_line", "tokens")
    )
    patterns = (
        patterns.join(walks, "leaf")
        .withColumn("part", dealt("created", "parts"))
        .select("leaf", "part", spread("salts").alias("salt"), "from_line", "created", "tokens")
    )
    # at least as many as the rows need, of which a group has no more than both sides' limit
    buckets = (sequences.count() + versions.count()) // rows_per_walk + 1
    bucket = F.pmod(F.xxhash64("leaf", "part", "salt"), F.lit(buckets))
    return (
        texts.withColumn("_bucket", bucket)
        .groupBy("_bucket")
        .cogroup(patterns.select(*patterns.columns, bucket.alias("_walk")).groupBy("_walk"))
        .applyInArrow(_walk, "first_line bigint, from_line bigint, created bigint")
    )


def uncovered(sequences: DataFrame, versions: DataFrame) -> DataFrame:
    """Sequences that no version covers; tokens are joined."""
    covered = _covering(sequences, versions).select("first_line").distinct()
    return sequences.join(covered, "first_line", "left_anti")


def reached_lines(remaining: DataFrame, size: int) -> DataFrame:
    """The first `size` sequences of every leaf, by line, and those of the range of lines the
    last of them is in. Adds ``_last``, the last line, null in leaves that are no wider.

    The lines of a wider leaf are counted by range, so the leaf itself is never sorted.
    """
    wide = (
        remaining.groupBy("leaf")
        .agg(F.count("*").alias("_n"), F.min("first_line").alias("_low"), F.max("first_line").alias("_high"))
        .filter(F.col("_n") > size)
        .select("leaf", "_low", (F.col("_high") - F.col("_low") + 1).alias("_span"),
                (F.ceil(F.col("_n") / size) * RANGES_PER_BLOCK).alias("_ranges"))
    )
    place = (F.col("first_line") - F.col("_low")).cast("decimal(20,0)") * F.col("_ranges").cast("decimal(18,0)")
    at = F.floor(place / F.col("_span").cast("decimal(20,0)")).cast("bigint")
    counted = (
        remaining.select("leaf", "first_line")
        .join(wide, "leaf")
        .groupBy("leaf", at.alias("_at"))
        .agg(F.count("*").alias("_n"), F.max("first_line").alias("_last"))
    )
    upto = W.partitionBy("leaf").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    last = (
        counted.withColumn("_upto", F.sum("_n").over(upto))
        .filter(F.col("_upto") >= size)
        .groupBy("leaf")
        .agg(F.min("_last").alias("_last"))
    )
    # each of these leaves has more than `size` sequences, so they are few
    return remaining.join(F.broadcast(last), "leaf", "left").filter(
        F.col("_last").isNull() | (F.col("first_line") <= F.col("_last"))
    )


def first_of_leaves(remaining: DataFrame, size: int) -> DataFrame:
    """The first `size` sequences of every leaf, by line; little more than them is sorted."""
    reached = reached_lines(remaining, size)
    narrow, over = reached.filter("_last IS NULL"), reached.filter("_last IS NOT NULL")
    order = W.partitionBy("leaf").orderBy("first_line")
    cut = over.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= size)
    return narrow.drop("_last").unionByName(cut.drop("_last", "_place"))


def _parted(workspace: Workspace, sequences: DataFrame) -> DataFrame:
    """``(leaf, first_line, tokens, founds, alone)`` with joined tokens, as a written table."""
    columns = ("leaf", "first_line", "tokens", "founds", "alone")
    if "founds" in sequences.columns:
        return packed(sequences.select(*columns)).filter("founds IS NOT NULL")
    # The first lines are narrow, so tokens move once to tell founders from the rest.
    parted = with_founders(packed(sequences.select(*columns[:3]))).filter("founds IS NOT NULL")
    return workspace.table(parted, "parted")


def mine(
    workspace: Workspace,
    sequences: DataFrame,
    sim_threshold: float = fixed.SIM_THRESHOLD,
    first_block: int = FIRST_BLOCK,
    largest_block: int = LARGEST_BLOCK,
    leaf_templates: int = LEAF_TEMPLATES,
) -> DataFrame:
    """All template versions of routed distinct sequences (a written table)."""
    if sim_threshold > 1:
        raise ValueError("sim_threshold must not exceed 1")
    parted = _parted(workspace, sequences)

    def founders(some: str) -> DataFrame:
        line = F.col("first_line")
        # under names of their own: they are joined with the sequences they come from
        columns = {"leaf": F.col("leaf"), "created": line, "from_line": line, "tokens": F.col("tokens")}
        found = parted.filter(f"founds AND {some}")
        return found.select(*[column.alias(name) for name, column in columns.items()])

    remaining = parted.filter("NOT founds").drop("founds", "alone")
    if remaining.isEmpty():
        return unpacked(founders("true"))
    # nothing meets the templates of leaves with one sequence
    done = [founders("NOT alone")]
    size = first_block
    while True:
        per_leaf = remaining.groupBy("leaf").count()
        left, widest = per_leaf.agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
        if not left:
            break
        block = remaining
        if widest > size:
            block = workspace.table(first_of_leaves(remaining, size), "block")
        versions = reduce(DataFrame.unionByName, done)
        active = remaining.select("leaf").distinct()
        old = workspace.table(latest(versions.join(active, "leaf", "left_semi")), "templates")
        known = old.count()
        if known > leaf_templates:
            old = _touchable(workspace, block, old, sim_threshold, leaf_templates)
        # Several leaves share one call; a bucket is bounded as each leaf is.
        bucket = F.pmod(F.xxhash64("leaf"), F.lit((left + known) // ROWS_PER_FOLD + 1))
        changed = workspace.table(
            block.withColumn("_bucket", bucket)
            .groupBy("_bucket")
            .cogroup(old.withColumn("_bucket", bucket).groupBy("_bucket"))
            .applyInArrow(_fold(sim_threshold), PACKED_VERSION_SCHEMA),
            "versions",
        )
        done.append(changed)
        if widest <= size:
            break
        rest = remaining.join(block.select("first_line"), "first_line", "left_anti")
        remaining = workspace.table(uncovered(rest, latest(changed)), "remaining")
        if len(done) > 8:
            done = [workspace.table(reduce(DataFrame.unionByName, done), "versions")]
        size = min(2 * size, largest_block)
    return unpacked(reduce(DataFrame.unionByName, [founders("alone"), *done]))


# --- assignment -----------------------------------------------------------------------------


def sequence_steps(sequences: DataFrame, versions: DataFrame) -> DataFrame:
    """Which template a sequence belongs to, by line: ``(sequence, from_line, to_line,
    created)``, ``to_line`` exclusive and null at the end.

    At a line the oldest template covering the sequence wins. Nearly every sequence has
    one step; it has more when an older template later widens enough to cover it.
    """
    by_wildcards = covering_versions(sequences, versions)
    by_founding = versions.filter(F.col("created") == F.col("from_line")).select(
        F.col("created").alias("first_line"), "from_line", "created"
    )
    order = W.partitionBy("first_line").orderBy("from_line")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    oldest_before = F.min("created").over(earlier)
    return (
        by_wildcards.unionByName(by_founding)
        .groupBy("first_line", "created")
        .agg(F.min("from_line").alias("from_line"))
        .withColumn("_oldest", oldest_before)
        .filter(F.col("_oldest").isNull() | (F.col("created") < F.col("_oldest")))
        .withColumn("to_line", F.lead("from_line").over(order))
        .filter(F.col("to_line").isNull() | (F.col("to_line") > F.col("first_line")))
        .join(sequences.select("sequence", "first_line"), "first_line")
        .select("sequence", "from_line", "to_line", "created")
    )


def at_line() -> Column:
    """Whether a step holds at the line."""
    return (F.col("line_no") >= F.col("from_line")) & (
        F.col("to_line").isNull() | (F.col("line_no") < F.col("to_line"))
    )


def assign_events(
    events: DataFrame, sequences: DataFrame, steps: DataFrame, hot_share: float = 1 / 512
) -> DataFrame:
    """Every event with ``created``, the template it belongs to at its line.

    Sequences with more than ``hot_share`` of the events (at most 512 of them, by
    arithmetic) are joined by broadcast, so their events stay where they are; no key of
    the remaining shuffle join is larger than that share. Should they have so many steps
    that a broadcast does not pay, the shuffle join's skew handling splits them.

    Texts meet by their digests, so the join shuffles none.
    """
    named = events.withColumn("sequence", digest(sequence_text(F.col("masked"))))
    sequences, steps = by_digest(sequences), by_digest(steps)
    total = sequences.agg(F.sum("events").alias("total")).scalar()
    hot = sequences.filter(F.col("events") > total * hot_share).select("sequence")
    hot_steps = steps.join(F.broadcast(hot), "sequence", "left_semi")
    cold_steps = steps.join(F.broadcast(hot), "sequence", "left_anti")

    def joined(part: DataFrame, part_steps: DataFrame) -> DataFrame:
        return (
            part.join(part_steps, "sequence")
            .filter(at_line())
            .drop("from_line", "to_line", "sequence")
        )

    if hot_steps.count() <= BROADCAST_STEPS:
        hot_steps = F.broadcast(hot_steps)
    return joined(named.join(F.broadcast(hot), "sequence", "left_semi"), hot_steps).unionByName(
        joined(named.join(F.broadcast(hot), "sequence", "left_anti"), cold_steps)
    )

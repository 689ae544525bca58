"""Repair of conversation structure by a secondary-sorted stream.

Rows are repartitioned by conversation and sorted by turn; `mapInPandas` reads them in that
order and carries the state of a dynamic program across Arrow batches. A conversation is
legal if its roles, by initial, are `(s?(ua)+)?`. Four states tell how far such a string has come;
a row may be kept, get another role or be deleted, and empty turns may be inserted before
it. For each state the cheapest edits so far are known by their cost and, among equal
costs, by rank of their initials; the differences of cost are few, so what a row of
some class does to them is a step of a small finite automaton (`_Automaton`). A row's
backpointers are therefore one small number, the step that was taken.

An ordinary conversation is held until its end and traced back at once. One with more rows
or text than `MOST_ROWS` or `MOST_CHARS` is left by the first pass and handled by three more that
hold none of it: the steps are written out in chunks of `CHUNK` rows (2 bytes each) to the shared
folder, a second stream reads the chunks last to first and turns them into edits, a third
merges these with the rows. Both ways give the same edits.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinderlog.llm.common import Scratch, table

MOST_ROWS = 20_000
MOST_CHARS = 16_000_000
CHUNK = 65_536
#: Rows and characters of a batch that goes back to Spark.
OUT_ROWS, OUT_CHARS = 4_096, 8_000_000

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: An undeleted truncated row adds this.
TRUNCATED = 3

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: state -> the initials that may follow, and the state they lead to.
NEXT = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
#: state -> (role of an inserted or reroled turn, state after it).
GIVEN = {START: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
#: states in which a conversation may end.
ENDING = (START, AFTER_A)

#: A state that costs this much more than another never wins: from any state two inserted turns
#: (6) lead after an assistant's turn, and what can follow the start but not that is one kept
#: system row, which can be deleted instead (4).
HOPELESS = 2 * INSERT + DELETE

#: Classes of rows: to be deleted, or initial (s, u, a, other) and whether truncated.
GONE, INITIALS = 0, "sua"
CLASSES = 9


def _inserts() -> dict[int, list[tuple[int, int]]]:
    """state -> (inserted turns, state after them); a third would only repeat a state."""
    out = {}
    for state in range(4):
        path, at = [(0, state)], state
        for k in (1, 2):
            at = GIVEN[at][1]
            path.append((k, at))
        out[state] = path
    return out


class _Automaton:
    """All steps the dynamic program can take, numbered the same in every process.

    A vector holds, per state, the cost above the cheapest and the rank of its edits among
    the states' edits. Edits up to a row end with what is done to the row, so no state's edits are
    the beginning of another's, and ranks decide all ties.
    """

    def __init__(self) -> None:
        self.inserts = _inserts()
        first = ((0, None, None, None), (0, None, None, None))
        self.vectors = {first: 0}
        self.steps: list[tuple] = []  # (per state (state before, edits) or None)
        self.table: list[list[tuple[int, int, int]]] = []  # vector, class -> (vector, cost, step)
        numbers: dict[tuple, int] = {}
        todo = deque([first])
        while todo:
            vector = todo.popleft()
            row = []
            for kind in range(CLASSES):
                after, cost, step = self._step(vector, kind)
                if after not in self.vectors:
                    self.vectors[after] = len(self.vectors)
                    todo.append(after)
                if step not in numbers:
                    numbers[step] = len(self.steps)
                    self.steps.append(step)
                row.append((self.vectors[after], cost, numbers[step]))
            self.table.append(row)
        self.ends = [self._end(v) for v in self.vectors]

    def _choices(self, state: int, kind: int) -> Iterator[tuple[int, int, str]]:
        """(state after, cost, edits) of the row and the turns inserted before it."""
        late = TRUNCATED if kind and (kind - 1) % 2 else 0
        initial = (INITIALS + "?")[(kind - 1) // 2] if kind else ""
        for k, at in self.inserts[state]:
            yield at, k * INSERT + DELETE, "I" * k + "D"
            if kind == GONE:
                continue
            if initial in NEXT[at]:
                yield NEXT[at][initial], k * INSERT + KEEP + late, "I" * k + "K"
            yield GIVEN[at][1], k * INSERT + REROLE + late, "I" * k + "R"

    def _step(self, vector: tuple, kind: int) -> tuple[tuple, int, tuple]:
        costs, ranks = vector
        best: list[tuple | None] = [None] * 4
        for state in range(4):
            if costs[state] is None:
                continue
            for after, cost, edits in self._choices(state, kind):
                found = (costs[state] + cost, ranks[state], edits, state)
                if best[after] is None or found < best[after]:
                    best[after] = found
        least = min(b[0] for b in best if b)
        best = [b if b and b[0] <= least + HOPELESS else None for b in best]
        order = sorted(b[1:] for b in best if b)
        return (
            (
                tuple(b and b[0] - least for b in best),
                tuple(b and order.index(b[1:]) for b in best),
            ),
            least,
            tuple(b and (b[3], b[2]) for b in best),
        )

    def _end(self, vector: tuple) -> tuple[int, int, str]:
        """(cost, state before the end, inserted turns) of the best way to end."""
        costs, ranks = vector
        ways = [
            (costs[s] + k * INSERT, ranks[s], "I" * k, s)
            for s in range(4)
            if costs[s] is not None
            for k, at in self.inserts[s]
            if at in ENDING
        ]
        cost, _, edits, state = min(ways)
        return cost, state, edits


_RULES: list[_Automaton] = []


def rules() -> _Automaton:
    if not _RULES:
        _RULES.append(_Automaton())
    return _RULES[0]


# --- rows ----------------------------------------------------------------------------------


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, turn, role, text, dropped): rows damaged by the CRC-32 of `conversation:turn`.

    Of twenty remainders, 0 drops a row (it stays, marked, so that its conversation isn't
    forgotten), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 gives it to the user. Nulls
    are read as one space, but a null conversation or turn stays null. Rows that repeat are damaged alike.
    """
    drawn = F.crc32(F.concat(_or_space(conv_col), F.lit(":"), _or_space(turn_col)).cast("binary")) % 20
    text = _or_space(text_col)
    return (
        df.select(
            F.col(conv_col).alias("conv"),
            F.col(turn_col).cast("long").alias("turn"),
            F.when(drawn == 4, "user").otherwise(_or_space(role_col)).alias("role"),
            F.when(drawn <= 1, "").when(drawn == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
            (drawn == 0).alias("dropped"),
            drawn.alias("_drawn"),
        )
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("_drawn") == 3, 2).otherwise(1))))
        .drop("_drawn", "_copy")
    )


def _classed(rows: DataFrame) -> DataFrame:
    """The stream's columns: conversation and turn as text, and each row's class."""
    said = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    cut = (~F.right(said, F.lit(1)).isin(*ENDS)).cast("int")
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    return rows.select(
        F.col("conv").cast("string").alias("conv"),
        F.col("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        dropped.alias("dropped"),
    ).withColumn("kind", F.when(F.col("dropped"), -1).when(said == "", GONE).otherwise(1 + 2 * place + cut))


def _in_order(rows: DataFrame) -> DataFrame:
    """By conversation, sorted by turn (nulls first); rows of one turn by role and text."""
    order = ["conv", "turn", "role", "text"]
    more = [c for c in ("chunk",) if c in rows.columns]
    sorted_rows = rows.repartition("conv").sortWithinPartitions(*order, *[F.col(c).asc_nulls_last() for c in more])
    return sorted_rows.withColumn("turn", F.col("turn").cast("string"))


class _Out:
    """Rows on their way back to Spark, in bounded batches."""

    def __init__(self, names: list[str], sized: str | None = None):
        self.names, self.rows, self.chars = names, [], 0
        self.at = names.index(sized) if sized else None

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if self.at is not None:
            self.chars += len(row[self.at] or "")

    def full(self) -> bool:
        return len(self.rows) >= OUT_ROWS or self.chars >= OUT_CHARS

    def batch(self) -> pd.DataFrame:
        made = pd.DataFrame(self.rows, columns=self.names, dtype=object)
        self.rows, self.chars = [], 0
        return made


def _rows(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch[c].tolist() for c in batch.columns])


EDITS = "conv string, place long, edit string, fault string, turn string, role string, text string, was string"
_EDIT_NAMES = ["conv", "place", "edit", "fault", "turn", "role", "text", "was"]
#: The edit of a mark row: the conversation has no rows, or is left for the passes that hold nothing.
LEFT = "left"


def _digest(role: str, text: str) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))


def _told(conv, held: list[tuple], edits: list[str], end: str) -> Iterator[tuple]:
    """Edit rows of rows (turn, role, text, fault) and the edits of each."""
    state, place = START, 0
    for (turn, role, text, fault), done in zip([*held, _NO_ROW], [*edits, end]):
        for edit in done:
            state, row = _one(state, edit, turn, role, text, fault)
            yield (conv, place, *row)
            place += 1


_NO_ROW = (None, None, None, None)


def _one(state: int, edit: str, turn, role, text, fault) -> tuple[int, tuple]:
    """The state after one edit, and what its row tells."""
    if edit == "I":
        given, state = GIVEN[state]
        return state, (edit, None, None, given, "", None)
    if edit == "D":
        return state, (edit, fault, turn, None, text, role)
    if edit == "R":
        given, state = GIVEN[state]
        return state, (edit, fault, turn, given, text, role)
    return NEXT[state][role[:1]], (edit, fault, turn, role, text, role)


def _fault(kind: int, seen: bool) -> tuple[int, str | None]:
    """The class a row is edited as, and its first fault."""
    if kind == GONE:
        return GONE, "blank"
    if seen:
        return GONE, "duplicate"
    return kind, "truncated" if (kind - 1) % 2 else None


def _repair(most_rows: int, most_chars: int):
    """Edits of the conversations of a sorted stream, held one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto, out = rules(), _Out(_EDIT_NAMES, "text")
        open_, conv = False, None
        held: list[tuple] = []
        taken: list[int] = []
        seen: set[bytes] = set()
        chars, vector, left = 0, 0, False

        def finish() -> Iterator[tuple]:
            if left:
                yield (conv, 0, LEFT, *[None] * 5)
                return
            if not held:
                yield (conv, 0, *[None] * 6)
                return
            _, state, end = auto.ends[vector]
            edits = []
            for step in reversed(taken):
                state, done = auto.steps[step][state]
                edits.append(done)
            yield from _told(conv, held, edits[::-1], end)

        for c, turn, role, text, _, kind in _rows(batches):
            if not open_ or c != conv:
                if open_:
                    for row in finish():
                        out.add(row)
                        if out.full():
                            yield out.batch()
                open_, conv = True, c
                held, taken, seen, chars, vector, left = [], [], set(), 0, 0, False
            if left or kind < 0:
                continue
            key = _digest(role, text) if kind != GONE else b""
            kind, fault = _fault(kind, key in seen)
            seen.add(key)
            vector, _, step = auto.table[vector][kind]
            held.append((turn, role, text, fault))
            taken.append(step)
            chars += len(text)
            if len(held) > most_rows or chars > most_chars:
                left, held, taken, seen = True, [], [], set()
        if open_:
            for row in finish():
                out.add(row)
                if out.full():
                    yield out.batch()
        yield out.batch()

    return run


# --- giant conversations ---------------------------------------------------------------------


_STEPS = "conv string, chunk long, turn long, role string, text string, steps binary, vector int"


def _write_steps(size: int):
    """Chunks of backpointers, each under the sort key of its first row; the last one of a
    conversation tells the vector it ends with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto, out = rules(), _Out(["conv", "chunk", "turn", "role", "text", "steps", "vector"], "text")
        open_, conv, vector, chunk = False, None, 0, 0
        taken: list[int] = []
        first, before = None, None

        def close(last: bool) -> tuple:
            packed = np.array(taken, "<u2").tobytes()
            turn, role, text = first
            return conv, chunk, None if turn is None else int(turn), role, text, packed, vector if last else None

        for c, turn, role, text, kind, dup in _rows(batches):
            if not open_ or c != conv:
                if open_ and first:
                    out.add(close(True))
                open_, conv, vector, chunk, taken, first, before = True, c, 0, 0, [], None, None
            if kind < 0:
                continue
            kind, _ = _fault(kind, dup or (role, text) == before)
            before = (role, text)
            if len(taken) == size:
                out.add(close(False))
                chunk, taken, first = chunk + 1, [], None
                if out.full():
                    yield out.batch()
            first = first or (turn, role, text)
            vector, _, step = auto.table[vector][kind]
            taken.append(step)
        if open_ and first:
            out.add(close(True))
        yield out.batch()

    return run


_CHOSEN = "conv string, chunk long, turn long, role string, text string, edits string, end string"


def _trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of each chunk, a text with one word per row, from chunks last to first."""
    auto, out = rules(), _Out(["conv", "chunk", "turn", "role", "text", "edits", "end"], "edits")
    state = START
    for conv, chunk, turn, role, text, steps, vector in _rows(batches):
        end = None
        if vector is not None and vector == vector:
            _, state, end = auto.ends[int(vector)]
        edits = []
        for step in np.frombuffer(steps, "<u2")[::-1].tolist():
            state, done = auto.steps[step][state]
            edits.append(done)
        turn = None if turn is None or turn != turn else int(turn)
        out.add((conv, chunk, turn, role, text, " ".join(edits[::-1]), end))
        if out.full():
            yield out.batch()
    yield out.batch()


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edit rows of a stream in which each chunk's edits come before its rows."""
    out = _Out(_EDIT_NAMES, "text")
    open_, conv, state, place, before = False, None, START, 0, None
    waiting: deque = deque()
    current: list[str] = []
    at, end = 0, ""
    for c, turn, role, text, kind, dup, edits, last in _rows(batches):
        if not open_ or c != conv:
            open_, conv, state, place, before = True, c, START, 0, None
            waiting, current, at, end = deque(), [], 0, ""
        if edits is not None:
            waiting.append((edits.split(" "), last))
            continue
        if kind < 0:
            continue
        if at == len(current):
            (current, end), at = waiting.popleft(), 0
        _, fault = _fault(int(kind), dup or (role, text) == before)
        before = (role, text)
        todo = [((turn, role, text, fault), current[at])]
        at += 1
        if at == len(current):
            todo.append((_NO_ROW, end or ""))
        for told, done in todo:
            for edit in done:
                state, row = _one(state, edit, *told)
                out.add((conv, place, *row))
                place += 1
        if out.full():
            yield out.batch()
    yield out.batch()


def _giants(rows: DataFrame, names: DataFrame, work: Scratch, chunk: int) -> DataFrame:
    """Edit rows, in order, of the conversations in `names`, none of which is held."""
    mine = work.table(rows.join(names, rows["conv"].eqNullSafe(names["_name"]), "left_semi"), "giant-rows")
    words = mine.where("kind > 0").select("conv", "role", F.sha2("text", 256).alias("_text"), "turn")
    first = words.groupBy("conv", "role", "_text").agg(F.min(F.struct("turn")).alias("_first"))
    first = first.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("_text").alias("_t"), "_first")
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.sha2("text", 256) == F.col("_t"))
    later = F.coalesce(~F.col("turn").eqNullSafe(F.col("_first.turn")), F.lit(False))
    flagged = work.table(
        mine.join(first, same, "left").select(
            "conv", "turn", "role", "text", "kind",
            (F.col("_first").isNotNull() & later & (F.col("kind") > 0)).alias("dup"),
        ),
        "giant-flags",
    )
    steps = work.table(_in_order(flagged).mapInPandas(_write_steps(chunk), _STEPS), "giant-steps")
    backward = steps.repartition("conv").sortWithinPartitions("conv", F.desc("chunk"))
    chosen = work.table(backward.mapInPandas(_trace, _CHOSEN), "giant-edits")
    both = flagged.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("chunk", "long"), ("edits", "string"), ("end", "string"))])
    both = both.unionByName(
        chosen.select("conv", "turn", "role", "text", F.lit(0).alias("kind"), F.lit(False).alias("dup"), "chunk", "edits", "end")
    )
    return _in_order(both).drop("chunk").mapInPandas(_merge, EDITS)


def _edits(rows: DataFrame, work: Scratch, most_rows: int, most_chars: int, chunk: int) -> list[DataFrame]:
    """Streams of edit rows; each conversation's rows follow each other in one of them."""
    rows = _classed(rows)
    all_ = _in_order(rows).mapInPandas(_repair(most_rows, most_chars), EDITS)
    whole = work.table(all_, "edits")
    names = whole.where(F.col("edit") == LEFT).select(F.col("conv").alias("_name"))
    if names.isEmpty():
        return [whole]
    return [whole.where(~F.col("edit").eqNullSafe(LEFT)), work.table(_giants(rows, names, work, chunk), "giant-told")]


def repair(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    most_rows: int = MOST_ROWS,
    most_chars: int = MOST_CHARS,
) -> DataFrame:
    """(conv, place, edit, fault, turn, role, text, was): one row per edit of each conversation.

    `place` orders the edits from 0; `edit` is K (kept), R (another role), D (deleted) or I (an inserted empty turn); `role` is the
    role after it (null if deleted), `was` the role before (null if inserted); `fault` is
    blank, duplicate, truncated or null. A blank row or one whose role and text were seen
    earlier in the conversation is always deleted. Of the cheapest edits those whose initials
    are least in ASCII are taken.

    Turns are read in order, null ones first; rows of one turn by role and text. Null roles
    and texts are one space. A null conversation is one like others; it is named by null. An empty
    table gives no rows. Other columns are not read. `conv` and `turn` are texts.
    """
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    parts = _edits(rows, Scratch(df.sparkSession, "repair"), most_rows, most_chars, CHUNK)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# --- digests ---------------------------------------------------------------------------------

DIGESTS = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
_LEGAL = {"su", "ua", "au"}
_COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation, from its edit rows in order."""
    out = _Out([x.split()[0] for x in DIGESTS.split(", ")], "audit")
    open_, conv = False, None

    def fresh():
        return {
            "faults": {"blank": 0, "duplicate": 0, "truncated": 0}, "illegal": 0, "cost": 0, "audit": [],
            "sha": hashlib.sha256(), "any": False, "initial": None, "low": None, "high": 0, "turns": 0,
        }

    now = fresh()

    def row() -> tuple:
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
        return (conv, gaps, *now["faults"].values(), now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest())

    for c, _, edit, fault, turn, role, text, was in _rows(batches):
        if not open_ or c != conv:
            if open_:
                out.add(row())
                if out.full():
                    yield out.batch()
            open_, conv, now = True, c, fresh()
        if edit is None:
            continue
        now["audit"].append(edit)
        now["cost"] += _COST[edit]
        if edit != "D":
            now["sha"].update(("\n" * now["any"] + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            now["any"] = True
            now["cost"] += TRUNCATED * (fault == "truncated")
        if edit == "I":
            continue
        if fault:
            now["faults"][fault] += 1
        initial = was[:1]
        now["illegal"] += now["initial"] is not None and now["initial"] + initial not in _LEGAL
        now["initial"] = initial
        if turn is not None:
            number = int(turn)
            if now["low"] is None:
                now["low"], now["high"], now["turns"] = number, number, 1
            elif number != now["high"]:
                now["high"], now["turns"] = number, now["turns"] + 1
    if open_:
        out.add(row())
    yield out.batch()


def repaired_digests(
    rows: DataFrame, kind: str = "long", most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS, chunk: int = CHUNK
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per
    conversation of rows (conv, turn, role, text and, if there, dropped).

    A conversation whose rows are all dropped has zeros, no audit and the hash of the empty
    text. gaps counts the missing turns between the first and the last.
    """
    work = Scratch(rows.sparkSession, "repair")
    rows = _classed(rows)
    told = _in_order(rows).mapInPandas(_repair(most_rows, most_chars), EDITS)
    # the digest reads the edits as they stream past; marks of what was left pass through
    done = work.table(told.mapInPandas(_digests_or_left, DIGESTS), "digests")
    names = done.where(F.col("audit") == LEFT).select(F.col("conv").alias("_name"))
    if not names.isEmpty():
        giant = _giants(rows, names, work, chunk).mapInPandas(_digests, DIGESTS)
        done = done.where(~F.col("audit").eqNullSafe(LEFT)).unionByName(work.table(giant, "giant-digests"))
    return done.select(F.col("conv").cast(kind).alias("conv_id"), *done.columns[1:])


def _digests_or_left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests; a conversation that was left is passed on as a mark (no audit spells it)."""
    left: list = []

    def rest() -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = batch["edit"] == LEFT
            left.extend(batch.loc[gone, "conv"].tolist())
            yield batch[~gone]

    for done in _digests(rest()):
        yield done
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    yield pd.DataFrame([(c, 0, 0, 0, 0, 0, 0, LEFT, "") for c in left], columns=names, dtype=object)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all conversations, damaged first."""
    source = table(spark, sf_dir, "conversations")
    kind = source.schema["conv_id"].dataType.simpleString()
    return repaired_digests(damaged(source), kind)

"""Repair of conversation structure by a Viterbi search that emits edits as soon as its survivors agree.

A conversation is in order if its roles are an optional system turn and then pairs of user and assistant, or if it is empty. Edits: a row is
kept, given another role (user or assistant), or deleted, and rows without text are inserted before it. The cheapest edits are wanted, and of
several the letters that come first (D, I, K, R).

The search has four states by what has been written last: nothing, system, user, assistant. After each row, each state has one
survivor: a leaf of a tree of backpointers, whose nodes count what refers to them. Nodes that no survivor leads back to go at once, and once all survivors
share an ancestor, the edits up to it are final and are emitted. So memory holds the unresolved suffixes and their rows, not the conversation.

Ties are broken by comparing whole unresolved suffixes. Rows are inserted before a row only, so that a suffix ends with the letter of a row, and no
suffix over the same rows starts with another one; letters decide the state they lead to. So the order of two suffixes, once different,
never changes, and it is kept as a rank: suffixes of different survivors compare by rank, those from one survivor by their last letters.
A survivor goes as well if another one can do whatever it can at a lower cost, which is what lets survivors meet.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderline.llm.storage import store

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: States after a user or assistant row, and the initials of roles by what they lead to.
AFTER = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT_ROLE = {EMPTY: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
# fixed values: costs of the edits, and of a truncated row that stays
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What it costs at most, from the first state, to do what the second one can do (rows to insert; from EMPTY a system row can be kept, elsewhere it is deleted).
CATCH_UP = {
    (ASSISTANT, EMPTY): DELETE, (USER, EMPTY): INSERT + DELETE, (SYSTEM, EMPTY): 2 * INSERT + DELETE,
    (EMPTY, SYSTEM): 0, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): INSERT,
    (EMPTY, USER): INSERT, (SYSTEM, USER): INSERT, (ASSISTANT, USER): INSERT,
    (EMPTY, ASSISTANT): 0, (USER, ASSISTANT): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT,
}
END = {EMPTY: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
#: Kinds of a fault, of which the first counts.
BLANK, DUPLICATE, CUT = 1, 2, 3
#: What damage() does to a row, by the checksum of its key.
DROP, BLANKED, UNSTOPPED, REPEATED, REROLED = range(5)


def _steps(initial: str, fault: int) -> list[dict[int, tuple[int, str]]]:
    """For each state the states a row leads to, each with the cost and letters of the best way there."""
    stays = TRUNCATED if fault == CUT else 0
    out = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, cost, letters = start, 0, ""
        for _ in range(3):  # inserting more rows than two leads back to the same state
            ways = [(state, cost + DELETE, letters + "D")]
            if fault not in (BLANK, DUPLICATE):
                if (state, initial) in AFTER:
                    ways.append((AFTER[state, initial], cost + KEEP + stays, letters + "K"))
                ways.append((AFTER[state, NEXT_ROLE[state][0]], cost + REROLE + stays, letters + "R"))
            for end, c, x in ways:
                best[end] = min(best.get(end, (c, x)), (c, x))
            state, cost, letters = AFTER[state, NEXT_ROLE[state][0]], cost + INSERT, letters + "I"
        out.append(best)
    return out


_STEPS: dict[tuple[str, int], list[dict[int, tuple[int, str]]]] = {}


class Node:
    """A node of the backpointer tree: the edits of one row, and how many nodes and survivors refer to it."""

    __slots__ = ("parent", "letters", "kids", "alive")

    def __init__(self, parent: Node | None, letters: str) -> None:
        self.parent, self.letters, self.kids, self.alive = parent, letters, [], True


class Search:
    """The search over one conversation; emit(letters, row) is called for each row in order once its edits are final."""

    def __init__(self, emit: Callable[[str, tuple], None]) -> None:
        self.emit, self.root, self.rows = emit, Node(None, ""), deque()
        self.survivors = {EMPTY: (0, 0, self.root)}  # state: cost, rank, leaf
        self.most_open = 0

    def add(self, role: str, fault: int, row: tuple) -> None:
        kind = (role[:1] if role[:1] in "sua" else "", fault)
        steps = _STEPS.get(kind) or _STEPS.setdefault(kind, _steps(*kind))
        best: dict[int, tuple] = {}
        for state, (cost, rank, _) in self.survivors.items():
            for end, (more, letters) in steps[state].items():
                way = (cost + more, rank, letters, state)
                if end not in best or way < best[end]:
                    best[end] = way
        worse = {x for x in best for y in best if y != x and best[x][0] > best[y][0] + CATCH_UP[y, x]}
        order = sorted((best[x][1:3], x) for x in best if x not in worse)
        old, self.survivors = self.survivors, {}
        for rank, (_, end) in enumerate(order):
            cost, _, letters, state = best[end]
            leaf = Node(old[state][2], letters)
            leaf.parent.kids.append(leaf)
            self.survivors[end] = (cost, rank, leaf)
        for _, _, leaf in old.values():
            leaf.alive = False
            while leaf is not self.root and not leaf.alive and not leaf.kids:
                leaf.parent.kids.remove(leaf)
                leaf = leaf.parent
        self.rows.append(row)
        self.most_open = max(self.most_open, len(self.rows))
        while len(self.root.kids) == 1:
            self._step(self.root.kids[0])

    def _step(self, node: Node) -> None:
        node.parent, self.root = None, node
        self.emit(node.letters, self.rows.popleft())

    def finish(self) -> tuple[int, str]:
        """The cost of the whole repair, and the rows to insert at the end; all edits left are emitted."""
        cost, _, state = min((cost + INSERT * len(END[state]), rank, state) for state, (cost, rank, _) in self.survivors.items())
        leaf, way = self.survivors[state][2], []
        while leaf is not self.root:
            way.append(leaf)
            leaf = leaf.parent
        for node in reversed(way):
            self._step(node)
        return cost, END[state]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and `dropped`: rows as they are after damage; dropped ones stay without text, so that their conversation is known.

    The checksum of `conv_id:turn` (a null is one space), modulo 20, decides: 0 drops the row, 1 empties its text, 2 takes its full stops and other marks of
    an end away, 3 repeats it, 4 makes it a user's. A null role or text is one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    x = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), what.alias("_what"))
    text = F.when(F.col("_what").isin(DROP, BLANKED), "").when(F.col("_what") == UNSTOPPED, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_what") == REROLED, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_what") == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_what") == DROP).alias("dropped"), F.explode(copies).alias("_copy")).drop("_copy")


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows with `again`: role and text stand at an earlier turn of the conversation too (copies at one turn are told apart when rows are read in order).

    Counted before anything is joined: only what occurs more than once in a conversation, with its first turn, meets the rows again.
    """
    key = [F.col("conv_id"), F.col("role"), F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), "text").alias("_h2")]
    first = rows.where("not dropped").groupBy(*key).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_first"), F.max(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_last"))
    again = store(first.where("_first < _last").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), "_h1", "_h2", F.col("_first.turn").alias("_turn")), "repeats")
    x = rows.withColumns({"_k1": F.xxhash64("text"), "_k2": F.xxhash64(F.lit(1), "text")})
    joined = x.join(again, x["conv_id"].eqNullSafe(again["_c"]) & (x["role"] == again["_r"]) & (x["_k1"] == again["_h1"]) & (x["_k2"] == again["_h2"]), "left")
    return joined.withColumn("again", F.col("_r").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))).select(*rows.columns, "again")


_SOLID = re.compile("[^\\x20\\x09-\\x0D]")
_BLANKS = " \t\n\v\f\r"


def fault_of(text: str, repeated: bool) -> int:
    """The first fault of a row, or 0."""
    if not _SOLID.search(text):
        return BLANK
    if repeated:
        return DUPLICATE
    return 0 if text.rstrip(_BLANKS)[-1] in ".!?" else CUT


class Repair:
    """One conversation, read row by row: its counts, and its repaired rows handed to `write` (edit, role, text) in order."""

    def __init__(self, write: Callable[[str, str | None, str | None], None]) -> None:
        self.write, self.state = write, EMPTY
        self.search = Search(self._emit)
        self.faults, self.illegal, self.distinct, self.cost = [0, 0, 0, 0], 0, 0, 0
        self.first_turn = self.last_turn = self.before = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.distinct += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        same = self.before == (turn, role, text)
        if self.before is not None and (self.before[1][:1] + role[:1]) not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = (turn, role, text)
        fault = fault_of(text, again or same)
        self.faults[fault] += 1
        self.search.add(role, fault, (role, text))

    def _put(self, edit: str, role: str, text: str) -> None:
        self.state = AFTER[self.state, role[0]]
        self.write(edit, role, text)

    def _emit(self, letters: str, row: tuple[str, str]) -> None:
        for _ in letters[:-1]:
            self._put("I", NEXT_ROLE[self.state], "")
        if letters[-1] == "D":
            self.write("D", None, None)
        else:
            self._put(letters[-1], row[0] if letters[-1] == "K" else NEXT_ROLE[self.state], row[1])

    def finish(self) -> None:
        self.cost, rest = self.search.finish()
        for _ in rest:
            self._put("I", NEXT_ROLE[self.state], "")

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, ordinal long, edit string, role string, text string"
_COLUMNS = ["conv_id", "turn", "role", "text", "dropped", "again"]


def _conversations(batches: Iterator[pa.RecordBatch], start: Callable, end: Callable) -> Iterator[None]:
    """Feeds rows that come by conversation and turn to a Repair each; yields after each batch of input."""
    repair, current = None, None
    for batch in batches:
        for conv, turn, role, text, dropped, again in zip(*(batch.column(c).to_pylist() for c in _COLUMNS)):
            if repair is None or conv != current:
                if repair is not None:
                    end(current, repair)
                repair, current = start(conv), conv
            if not dropped:
                repair.add(turn, role, text, again)
        yield
    if repair is not None:
        end(current, repair)
        yield


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DIGEST.split(", ")]
    out: list[tuple] = []
    open_: dict[str, object] = {}

    def start(conv: int | None) -> Repair:
        sha, audit, written = hashlib.sha256(), bytearray(), [False]

        def write(edit: str, role: str | None, text: str | None) -> None:
            audit.extend(edit.encode())
            if role is not None:
                sha.update((("\n" if written[0] else "") + role + ":" + text).encode())
                written[0] = True

        open_.update(sha=sha, audit=audit)
        return Repair(write)

    def end(conv: int | None, repair: Repair) -> None:
        repair.finish()
        out.append((conv, repair.gaps, *repair.faults[1:], repair.illegal, repair.cost, open_["audit"].decode(), open_["sha"].hexdigest()))

    kinds = dict.fromkeys(names, pa.int64()) | {"audit": pa.string(), "repaired_sha256": pa.string()}
    for _ in _conversations(batches, start, end):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[n]) for n, x in zip(names, zip(*out))], names=names)
            out.clear()


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in EDITS.split(", ")]
    out: list[tuple] = []

    def start(conv: int | None) -> Repair:
        count = [0]

        def write(edit: str, role: str | None, text: str | None) -> None:
            out.append((conv, count[0], edit, role, text))
            count[0] += 1

        return Repair(write)

    kinds = dict.fromkeys(names, pa.string()) | {"conv_id": pa.int64(), "ordinal": pa.int64()}
    for _ in _conversations(batches, start, lambda conv, repair: repair.finish()):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[n]) for n, x in zip(names, zip(*out))], names=names)
            out.clear()


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of a conversation one after another, by turn (null first), role and text: sorted on disk where they don't fit, streamed through one worker."""
    x = with_repeats(rows).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "dropped", "again")
    return x.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "dropped")


def repair_rows(rows: DataFrame) -> DataFrame:
    """The edits of each conversation of rows (conv_id, turn, role, text[, dropped]): conv_id, ordinal, edit (K, R, D, I), role and text of the row as it becomes (null if deleted)."""
    rows = rows if "dropped" in rows.columns else rows.withColumn("dropped", F.lit(False))
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})
    return _ordered(rows.select("conv_id", "turn", "role", "text", "dropped")).mapInArrow(_edits, EDITS)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Damages the rows (damage) and repairs each conversation: counts of faults, cost, letters of the edits, and the checksum of what results.

    Rows follow each other by turn, null ones first, then by role and text. A null conversation is one of its own. Texts that differ only in their place are
    copies; a row equal to one before it is a duplicate, and so are repeated rows of the table. Conversations of which all rows are dropped have zeros, no letters and the checksum of
    an empty text; an empty table has no rows. The checksum needs a conversation's rows in order, so each is streamed through one worker, which holds the unresolved
    rows and the letters. Other columns are ignored.
    """
    return _ordered(damage(conversations)).mapInArrow(_digests, DIGEST)

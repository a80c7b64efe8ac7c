"""Conversation structure repair: the cheapest edits that turn role initials into `(s?(ua)+)?`.

Each conversation streams through a dynamic program in order of its turns. It
holds, for each of the four grammar states (nothing yet, after s, after u,
after a), the cheapest edit string that leads there. Edit strings share their
prefixes: a string is a node of a tree with its parent, its ancestors at
powers of two and a rolling hash of the whole string. Of two strings of equal
cost the ASCII-least stays; they are compared by a search for their longest
common prefix over the ancestors' hashes, and the prefix that the hashes call
equal is verified edit by edit up to the node that both share.

Edits: K keep (0), R rerole to the user or assistant that the grammar wants
next (1), D delete (2, forced for blank and duplicate rows), I insert an empty
user or assistant row (5); a truncated row that stays adds 5. Inserts are
counted before the row that follows them, so no string that leads to a state
is a prefix of another, and the least prefix gives the least string.

A state goes when another is so much cheaper that it can buy all that the state
could still reach. What the live strings have in common is final: those rows
are passed on and their nodes dropped, so a task holds the few rows on which
the strings still differ, however long the conversation is. One task streams
one conversation, since its digest is sequential; duplicates are found by an
aggregation beforehand, not by a set in that task.

Defined cases. A NULL counts as one space in role, text and in the key of the
damage; NULL turns come first and are no turn for `gaps`; rows without conv_id
are one conversation. Rows of one turn are ordered by role, then text; equal
rows are duplicates of each other. An empty role has an empty initial, which
is never legal. Texts are taken whole, however long; empty ones are blank. An
empty table gives no rows. Only four columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import parts

SPACE = " \t\n\x0b\f\r"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Grammar: state -> initial -> state; states are nothing yet, after s, after u, after a.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 2, 1, 5, 5
ROLE = {"u": "user", "a": "assistant"}
#: (x, y, d): at state y, d more buys whatever x can still reach (an insert, or deleting an s that x would keep).
OVERTAKES = ((0, 3, 2), (0, 2, 7), (1, 3, 0), (1, 2, 5), (2, 3, 5), (3, 2, 5))
_MOD, _BASE = (1 << 61) - 1, 1_000_003
#: Rows held before the common part of the live strings is passed on.
HOLD = 64


def wanted(state: int) -> str:
    """The initial that an inserted or rerolled row takes."""
    return "a" if state == 2 else "u"


def moves(initial: str, fault: int) -> list[list[tuple[int, int, str]]]:
    """For each state, the ways to it over one row: (state before, cost, edits), the best of each state before."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        state, cost, edits = before, 0, ""
        for _ in range(3):  # a third insert leads where the first did
            ways = [(state, cost + DELETE_COST, edits + "D")]
            if fault not in (BLANK, DUPLICATE):
                stay = cost + (TRUNCATED_COST if fault == TRUNCATED else 0)
                ways.append((STEP[state][wanted(state)], stay + REROLE_COST, edits + "R"))
                if initial in STEP[state]:
                    ways.append((STEP[state][initial], stay, edits + "K"))
            for after, price, string in ways:
                best[before, after] = min(best.get((before, after), (price, string)), (price, string))
            state, cost, edits = STEP[state][wanted(state)], cost + INSERT_COST, edits + "I"
    return [[(b, *best[b, a]) for b in range(4) if (b, a) in best] for a in range(4)]


MOVES = {(i, f): moves(i, f) for i in ("s", "u", "a", "") for f in (OK, BLANK, DUPLICATE, TRUNCATED)}


class Audits:
    """Edit strings as nodes of a tree that share their prefixes; node 0 is the empty string."""

    def __init__(self) -> None:
        self.edit, self.depth, self.hash = [""], [0], [0]
        #: Ancestors 1, 2, 4, ... edits back.
        self.up: list[list[int]] = [[]]

    def add(self, node: int, edits: str) -> int:
        for edit in edits:
            ancestors = [node]
            while len(higher := self.up[ancestors[-1]]) >= len(ancestors):
                ancestors.append(higher[len(ancestors) - 1])
            self.edit.append(edit)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * _BASE + ord(edit)) % _MOD)
            self.up.append(ancestors)
            node = len(self.edit) - 1
        return node

    def lift(self, node: int, steps: int) -> int:
        while steps:
            power = steps.bit_length() - 1
            node = self.up[node][power]
            steps -= 1 << power
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def same(self, a: int, b: int) -> bool:
        """Whether two strings of one length are equal: their hashes first, then edit by edit to the shared node."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether string a is ASCII-less than string b."""
        short = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, self.depth[a] - short), self.lift(b, self.depth[b] - short)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for power in range(len(self.up[x]) - 1, -1, -1):
            # Equal hashes are taken at their word here and verified below.
            if power < len(self.up[x]) and self.hash[self.up[x][power]] != self.hash[self.up[y][power]]:
                x, y = self.up[x][power], self.up[y][power]
        if self.edit[x] != self.edit[y] and self.same(self.up[x][0], self.up[y][0]):
            return self.edit[x] < self.edit[y]
        return self.text(a) < self.text(b)  # a collision misled the search


class Repair:
    """The dynamic program over one conversation; `emit(role, text)` gets the repaired rows in order."""

    def __init__(self, emit: Callable[[str, str], None]) -> None:
        self.emit = emit
        self.tree = Audits()
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self.rows: list[tuple[str, str]] = []
        self.done: list[str] = []
        self.state, self.limit = 0, HOLD

    def choose(self, ways: list[tuple[int, int, str]]) -> tuple[int, int] | None:
        """The cheapest of (cost, node, edits), the ASCII-least of equals, as (cost, node)."""
        if not ways:
            return None
        cost = min(w[0] for w in ways)
        least, *others = [self.tree.add(node, edits) for price, node, edits in ways if price == cost]
        for other in others:
            if self.tree.less(other, least):
                least = other
        return cost, least

    def add(self, role: str, text: str, fault: int) -> None:
        best = self.best
        table = MOVES[role[:1] if role[:1] in ("s", "u", "a") else "", fault]
        self.best = [self.choose([(best[b][0] + cost, best[b][1], edits) for b, cost, edits in ways if best[b] is not None]) for ways in table]
        cost = [e[0] if e else None for e in self.best]
        for x, y, more in OVERTAKES:
            if cost[x] is not None and cost[y] is not None and cost[x] > cost[y] + more:
                self.best[x] = None
        self.rows.append((role, text))
        if len(self.rows) >= self.limit:
            self.settle()
            self.limit = 2 * len(self.rows) + HOLD

    def settle(self) -> None:
        """Pass on what all live strings share."""
        live = [(state, cost, self.tree.text(node)) for state, (cost, node) in ((s, e) for s, e in enumerate(self.best) if e)]
        common = os.path.commonprefix([text for _, _, text in live])
        # Inserts go with the row after them.
        common = common.rstrip("I")
        self.apply(common)
        self.tree = Audits()
        for state, cost, text in live:
            self.best[state] = (cost, self.tree.add(0, text[len(common) :]))

    def apply(self, edits: str) -> None:
        used = 0
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.rows[used]
            used += edit != "I"
            if edit == "D":
                continue
            initial = role[:1] if edit == "K" else wanted(self.state)
            self.emit(role if edit == "K" else ROLE[initial], text)
            self.state = STEP[self.state][initial]
        del self.rows[:used]
        self.done.append(edits)

    def finish(self) -> tuple[int, str]:
        """Cost and edits of the whole conversation."""
        ends = []
        for state, entry in enumerate(self.best):
            if entry:
                edits = ""
                while state not in FINAL:
                    state, edits = STEP[state][wanted(state)], edits + "I"
                ends.append((entry[0] + INSERT_COST * len(edits), entry[1], edits))
        cost, node = self.choose(ends)
        self.apply(self.tree.text(node))
        return cost, "".join(self.done)


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by the remainder of the checksum of `conv_id:turn`; dropped rows are marked gone."""
    space = F.lit(" ")
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("kind", F.crc32(key) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("copy")).drop("copy")


def order_of(turn: Column) -> Column:
    """Comparable place of a turn, NULL first."""
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds `fault` (OK, BLANK, DUPLICATE of an earlier turn or TRUNCATED); equal rows of one turn are left to the stream."""
    rows = rows.withColumn("mark", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    first = (
        rows.where(~F.col("gone")).groupBy(F.col("conv_id").alias("c"), F.col("mark").alias("m"))
        .agg(F.min(order_of(F.col("turn"))).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    )
    trimmed = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(trimmed == "", BLANK).when(order_of(F.col("turn")) > F.col("first"), DUPLICATE)
        .when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    )
    joined = rows.join(first, rows["conv_id"].eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")), "left")
    return joined.select("conv_id", "turn", "role", "text", "gone", fault.cast("int").alias("fault"))


SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
LEGAL = ("su", "ua", "au")


class Summary:
    """One conversation: its counts, its repair and the digest of what is repaired."""

    def __init__(self, conv_id: int | None, emit: Callable[[str, str], None] | None) -> None:
        self.conv_id, self.out = conv_id, emit
        self.counts = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        self.digest, self.first = hashlib.sha256(), True
        self.repair = Repair(self.take)

    def take(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "replace"))
        self.first = False
        if self.out:
            self.out(role, text)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault in (OK, TRUNCATED) and self.last == (turn, role, text):
            fault = DUPLICATE
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if self.last is not None and self.last[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = (turn, role, text)
        self.counts[fault] += 1
        self.repair.add(role, text, fault)

    def close(self) -> tuple:
        cost, audit = self.repair.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, cost, audit, self.digest.hexdigest())


def in_order(rows: DataFrame) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return rows.repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions(*order)


def walk(batches: Iterator[pa.RecordBatch], emit: Callable[[int | None], Callable[[str, str], None] | None]) -> Iterator[Summary]:
    """Each conversation of an ordered partition, with all its rows added."""
    now: Summary | None = None
    for batch in batches:
        for conv, turn, role, text, gone, fault in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault"))):
            if now is None or now.conv_id != conv:
                if now is not None:
                    yield now
                now = Summary(conv, emit(conv))
            if not gone:
                now.add(turn, role, text, fault)
    if now is not None:
        yield now


def audit(rows: DataFrame) -> DataFrame:
    """SUMMARY of every conv_id of damaged rows (conv_id, turn, role, text, gone)."""
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SUMMARY.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for found in walk(batches, lambda conv: None):
            held.append(found.close())
            size += 200 + len(held[-1][7])
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

    return in_order(faults(rows)).mapInArrow(run, SUMMARY)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the repaired rows of damaged rows (conv_id, turn, role, text, gone), places from 0."""
    names = ["conv_id", "place", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def keep(conv: int | None) -> Callable[[str, str], None]:
            places = iter(range(1 << 62))
            return lambda role, text: held.append((conv, next(places), role, text))

        def made() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names)
            held.clear()
            return batch

        def few(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                yield from (batch.slice(low, 1000) for low in range(0, batch.num_rows, 1000))

        walked = walk(few(batches), keep)
        for found in walked:
            found.close()
            if len(held) > 1000:
                yield made()
        yield made()

    return in_order(faults(rows)).mapInArrow(run, "conv_id long, place long, role string, text string")

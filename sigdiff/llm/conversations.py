"""Conversation structure repair: the cheapest edits after which the roles of each conversation follow a grammar.

Rows of a conversation are taken by turn, nulls first; rows of one turn by role, then text. Its first fault counts: blank (nothing but ASCII white
space), duplicate (role and text of an earlier row), truncated (the last character that is not white space ends no sentence). Edits are keep (0), rerole to user or assistant (3),
delete (4; blank and duplicate rows must go) and insert an empty user or assistant row (3); a truncated row that stays costs 3 more.

The repair is generalised LR parsing. Item sets of the role grammar give the automaton; each step takes every live stack of a graph-structured stack over one
row by delete, keep and rerole, then over inserted rows. Stacks share their tails, and of stacks that come out equal the one of minimum (cost, audit) stays, audit being
the edits' initials in order; where those are equal in cost neither is the other's beginning, so this is exact. The grammar is written left-recursively, with the optional system row
inside the first pair, so that all stacks are the same a pair later. A stack that costs more than SLACK above the cheapest one is dropped: the cheapest can go on as any other by
one more deleted row and two inserted ones.

Rows are shuffled once, by conversation, and sorted there; a task streams over its sorted rows and holds the few live stacks and the rows on whose edits they still differ, so a conversation of any
length needs little memory. Duplicates are known before that, from the first turn of each repeated (conversation, role, SHA-256 of the text), counted with partial aggregates. The hash of a whole repaired conversation
is sequential, so one conversation is one task's stream.

Nulls in role and text become one blank; a row whose role is empty or not of the grammar cannot be kept; a null id is a conversation of its own. Conversations without rows after damage have zeros, an empty audit and the hash of the empty text. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigdiff.llm.common import stored

#: The roles' initials: an optional system row before pairs of user and assistant, or nothing.
GRAMMAR = [("S", ""), ("S", "B"), ("B", "ua"), ("B", "Hua"), ("B", "Bua"), ("H", "s")]
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SLACK = DELETE + 2 * INSERT
#: Adjacent initials that are in order.
LEGAL = ("su", "ua", "au")
#: Rows of repeated (conversation, role, text) that are broadcast; more are joined by shuffle.
BROADCAST_REPEATS = 200_000
#: Rows after which edits that all live stacks agree on are carried out.
FLUSH = 32

_SPACE = "\t\n\x0b\f\r "


def _closed(grammar: list[tuple[str, str]], items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
    todo, out = list(items), set(items)
    while todo:
        rule, dot = todo.pop()
        after = grammar[rule][1][dot : dot + 1]
        for k, (left, _) in enumerate(grammar):
            if left == after and (k, 0) not in out:
                out.add((k, 0))
                todo.append((k, 0))
    return frozenset(out)


@dataclass(eq=False)
class Stack:
    """A stack of item sets; equal stacks of one parser are one object, and stacks share what is below their tops."""

    items: frozenset[tuple[int, int]]
    below: Stack | None
    above: dict[frozenset, Stack] = field(default_factory=dict)
    moves: dict[str, tuple[Stack, ...]] = field(default_factory=dict)


class Parser:
    """LR automaton of a grammar whose first rules' left side is the start; every reduction that is possible is tried."""

    def __init__(self, grammar: list[tuple[str, str]] = GRAMMAR):
        self.grammar = grammar
        self.bottom = Stack(_closed(grammar, {(k, 0) for k, (left, _) in enumerate(grammar) if left == grammar[0][0]}), None)

    def _push(self, stack: Stack, symbol: str) -> Stack | None:
        items = {(rule, dot + 1) for rule, dot in stack.items if self.grammar[rule][1][dot : dot + 1] == symbol}
        if not items:
            return None
        closed = _closed(self.grammar, items)
        if closed not in stack.above:
            stack.above[closed] = Stack(closed, stack)
        return stack.above[closed]

    def shift(self, stack: Stack, symbol: str) -> tuple[Stack, ...]:
        """The stacks after symbol: shifted, then reduced in every way; of those, the ones that can go on or accept."""
        if symbol not in stack.moves:
            first = self._push(stack, symbol)
            todo, out = [first] if first else [], []
            while todo:
                top = todo.pop()
                out.append(top)
                for rule, dot in top.items:
                    left, right = self.grammar[rule]
                    if dot == len(right) and right and left != self.grammar[0][0]:
                        base = top
                        for _ in right:
                            base = base.below
                        after = self._push(base, left)
                        if after and after not in out:
                            todo.append(after)
            ends = lambda s: all(dot == len(self.grammar[rule][1]) and self.grammar[rule][0] != self.grammar[0][0] for rule, dot in s.items)
            stack.moves[symbol] = tuple(s for s in out if not ends(s))
        return stack.moves[symbol]

    def accepts(self, stack: Stack) -> bool:
        return any(dot == len(self.grammar[rule][1]) and self.grammar[rule][0] == self.grammar[0][0] for rule, dot in stack.items)


class Repair:
    """The live stacks of one conversation, each with the minimum (cost, audit) that leads to it."""

    def __init__(self, parser: Parser):
        self.parser = parser
        self.live: dict[Stack, tuple[int, str]] = {parser.bottom: (0, "")}
        self._inserted()

    def _inserted(self) -> None:
        live, todo = self.live, list(self.live)
        while todo:
            stack = todo.pop()
            cost, audit = live[stack]
            new = (cost + INSERT, audit + "I")
            for symbol in NAMES:
                for after in self.parser.shift(stack, symbol):
                    if after not in live or new < live[after]:
                        live[after] = new
                        todo.append(after)
        limit = min(cost for cost, _ in live.values()) + SLACK
        self.live = {s: v for s, v in live.items() if v[0] <= limit}

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        after: dict[Stack, tuple[int, str]] = {}

        def put(stack: Stack, value: tuple[int, str]) -> None:
            if stack not in after or value < after[stack]:
                after[stack] = value

        more = TRUNCATED if truncated else 0
        for stack, (cost, audit) in self.live.items():
            put(stack, (cost + DELETE, audit + "D"))
            if must_go:
                continue
            for s in self.parser.shift(stack, initial) if initial else ():
                put(s, (cost + more, audit + "K"))
            for symbol in NAMES:
                for s in self.parser.shift(stack, symbol):
                    put(s, (cost + REROLE + more, audit + "R"))
        self.live = after
        self._inserted()

    def agreed(self) -> str:
        """The edits that all live stacks begin with; they are taken out of the audits."""
        common = os.path.commonprefix([audit for _, audit in self.live.values()])
        self.live = {s: (cost, audit[len(common) :]) for s, (cost, audit) in self.live.items()}
        return common

    def best(self) -> tuple[int, str]:
        return min(v for s, v in self.live.items() if self.parser.accepts(s))


class Conversation:
    """One conversation, fed row by row: counts, cost, and the hash of the repaired text as soon as edits are certain."""

    def __init__(self, parser: Parser):
        self.repair = Repair(parser)
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.turn = self.last = None
        self.turns = 0
        self.pending: list[tuple[str, str]] = []
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.written = 0
        self.next = "u"
        self.seen: tuple[str, str] | None = None

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        # equal rows of one turn follow each other
        if (fault is None or fault == "truncated") and self.seen == (role, text):
            fault = "duplicate"
        self.seen = (role, text)
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.last = initial
        self.pending.append((role, text))
        self.repair.row(initial, fault in ("blank", "duplicate"), fault == "truncated")
        if len(self.pending) % FLUSH == 0:
            self._apply(self.repair.agreed())

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.written += 1
        self.next = "a" if role[:1] == "u" else "u"

    def _apply(self, edits: str) -> None:
        at = 0
        for edit in edits:
            if edit == "I":
                self._write(NAMES[self.next], "")
                continue
            role, text = self.pending[at]
            at += 1
            if edit != "D":
                self._write(role if edit == "K" else NAMES[self.next], text)
        del self.pending[:at]
        self.audit.append(edits)

    def result(self) -> tuple:
        cost, edits = self.repair.best()
        self._apply(edits)
        gaps = min(self.high - self.low + 1 - self.turns, 2**63 - 1) if self.turns else 0
        return gaps, *self.counts.values(), cost, "".join(self.audit), self.hash.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults by the checksum of conv_id:turn; nulls count as one blank. Adds gone: the row is dropped, but for its conversation's id."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(case <= 1, "").when(case == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(case == 4, "user").otherwise(blank("role"))
    copies = F.sequence(F.lit(1), F.when(case == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (case == 0).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")


def _fault(first: Column) -> Column:
    """A row's first fault, but for duplicates within its turn; first: the turn of the first of several turns that have its role and text, in an array."""
    end = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    later = first.isNotNull() & F.col("turn").isNotNull() & (first[0].isNull() | (first[0] < F.col("turn")))
    return F.when(end == "", "blank").when(later, "duplicate").when(~end.isin(".", "!", "?"), "truncated")


def repair_conversations(rows: DataFrame, damage: bool = False, broadcast_rows: int = BROADCAST_REPEATS, grammar: list[tuple[str, str]] = GRAMMAR) -> DataFrame:
    """For each conv_id of rows (conv_id, turn, role, text): conv_id, gaps (turns that no row has, between the least and the greatest), blank, duplicate, truncated, illegal (neighbours out of order), cost, audit, repaired_sha256.

    damage: the rows first get faults, as ``damaged`` makes them.
    """
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    every = damaged(plain) if damage else plain.select("conv_id", "turn", blank("role"), blank("text"), F.lit(False).alias("gone"))
    key = F.unhex(F.sha2("text", 256)).alias("_text")
    # nulls sort first: an array of the turn is less with a null in it
    first = F.min(F.array("turn"))
    again = every.where("NOT gone").groupBy("conv_id", "role", key).agg(first.alias("_first"), F.max(F.array("turn")).alias("_last")).where("NOT (_first <=> _last)").drop("_last")
    again = stored(again.withColumnsRenamed({"conv_id": "_conv", "role": "_role"}), "repeats")
    few = again.count() <= broadcast_rows
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.unhex(F.sha2("text", 256)) == F.col("_text"))
    marked = every.join(F.broadcast(again) if few else again, same, "left")
    ready = marked.select("conv_id", "turn", "role", "text", "gone", F.when(~F.col("gone"), _fault(F.col("_first"))).alias("fault"))
    ordered = ready.repartition("conv_id").sortWithinPartitions("conv_id", F.col("gone").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    names = ["conv_id", *numbers, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(grammar)
        now, own, out, kind = None, None, [], None

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            types = [kind, *[pa.int64()] * len(numbers), pa.string(), pa.string()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, gone, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "fault")), strict=True):
                if own is None or conv != now:
                    if own is not None:
                        out.append((now, *own.result()))
                    now, own = conv, Conversation(parser)
                if not gone:
                    own.row(turn, role, text, fault)
            if len(out) >= 1000:
                yield made()
                out = []
        if own is not None:
            out.append((now, *own.result()))
            yield made()

    conv_type = dict(rows.dtypes)["conv_id"]
    return ordered.mapInArrow(run, f"conv_id {conv_type}, {', '.join(f'{c} long' for c in numbers)}, audit string, repaired_sha256 string")

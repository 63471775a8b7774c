"""Conversation structure repair by generalised LR parsing with weighted edits.

The roles of a repaired conversation follow the grammar

    S -> (nothing) | P | s P        P -> u a | P u a

A conversation's rows are streamed in the order of their turns through an LR
automaton of that grammar. After each row a graph-structured stack holds one
node a stack top: rows are kept, deleted or given another role, and rows are
inserted, at a cost. Stacks with an equal top merge to the one with the least
(cost, audit), the audit being the initials of its edits. A node carries what
its repaired text would be as a running digest, so a conversation of any
length takes a few bytes a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, tidy

#: The LR automaton: where a state goes by a role's initial or by P, what it reduces (symbol, length), where the text may end.
SHIFT = {(0, "s"): 1, (0, "u"): 4, (1, "u"): 4, (2, "u"): 6, (3, "u"): 6, (4, "a"): 5, (6, "a"): 7}
REDUCE = {5: ("P", 2), 7: ("P", 3)}
GOTO = {(0, "P"): 2, (1, "P"): 3}
ENDS = frozenset({0, 2, 3})

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
INITIALS = "sua"

Stack = tuple[int, ...]


@lru_cache(maxsize=None)
def shift(stack: Stack, initial: str) -> Stack | None:
    """The stack after a role, reduced as far as it goes; None where the grammar has no such role there.

    Stacks are few: a reduction leaves the automaton's start, an s if any, and P."""
    to = SHIFT.get((stack[-1], initial))
    if to is None:
        return None
    stack = (*stack, to)
    while stack[-1] in REDUCE:
        symbol, length = REDUCE[stack[-1]]
        stack = stack[:-length]
        stack = (*stack, GOTO[stack[-1], symbol])
    return stack


@lru_cache(maxsize=None)
def inserted(stack: Stack) -> tuple[tuple[str, Stack, str], ...]:
    """(audit, stack, roles) of inserting nothing or rows up to where a top would come again."""
    out, todo, tops = [], [("", stack, "")], set()
    while todo:
        audit, at, roles = todo.pop(0)
        if at[-1] in tops:
            continue
        tops.add(at[-1])
        out.append((audit, at, roles))
        todo += [(audit + "I", to, roles + r) for r in ROLES if (to := shift(at, r))]
    return tuple(out)


@lru_cache(maxsize=None)
def edits(stack: Stack, initial: str, must_go: bool, truncated: bool) -> tuple[tuple[str, Stack, int, str, str], ...]:
    """(audit, stack, cost, inserted roles, the row's role: "" deleted, "=" its own, or a new initial) of all edits up to and with one row."""
    out, extra = [], TRUNCATED if truncated else 0
    for audit, at, roles in inserted(stack):
        cost = INSERT * len(audit)
        out.append((audit + "D", at, cost + DELETE, roles, ""))
        if must_go:
            continue
        if initial in SHIFT_ROLES and (to := shift(at, initial)):
            out.append((audit + "K", to, cost + KEEP + extra, roles, "="))
        out += [(audit + "R", to, cost + REROLE + extra, roles, r) for r in ROLES if (to := shift(at, r))]
    return tuple(out)


SHIFT_ROLES = frozenset(INITIALS)


class Node(NamedTuple):
    """A stack, its cost, the place of its audit among those of the other nodes, and the digest of its text."""

    stack: Stack
    cost: int
    rank: int
    digest: object
    lines: int


def _line(digest, lines: int, line: bytes) -> int:
    if lines:
        digest.update(b"\n")
    digest.update(line)
    return lines + 1


class Repair:
    """The graph-structured stack over one conversation.

    No audit up to a row's edit begins with another one of as many rows, as
    each ends with a row's letter. So audits compare by the rank of what they
    extend, then by what they add, and are never written out before the end.
    """

    def __init__(self):
        self.nodes = [Node((0,), 0, 0, hashlib.sha256(), 0)]
        self.trail: list[tuple[tuple[int, str], ...]] = []

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        best: dict[int, tuple] = {}
        initial = role[:1]
        for parent, node in enumerate(self.nodes):
            for audit, stack, cost, roles, own in edits(node.stack, initial if initial in SHIFT_ROLES else "", must_go, truncated):
                item = (node.cost + cost, node.rank, audit, parent, stack, roles, own)
                old = best.get(stack[-1])
                if old is None or item[:3] < old[:3]:
                    best[stack[-1]] = item
        found = sorted(best.values(), key=lambda x: x[1:3])
        nodes, trail = [], []
        for rank, (cost, _, audit, parent, stack, roles, own) in enumerate(found):
            digest, lines = self.nodes[parent].digest, self.nodes[parent].lines
            if roles or own:
                digest = digest.copy()
                for r in roles:
                    lines = _line(digest, lines, f"{ROLES[r]}:".encode())
                if own:
                    lines = _line(digest, lines, f"{role if own == '=' else ROLES[own]}:{text}".encode())
            nodes.append(Node(stack, cost, rank, digest, lines))
            trail.append((parent, audit))
        self.nodes = nodes
        self.trail.append(tuple(trail))

    def end(self) -> tuple[int, str, str]:
        """cost, audit, digest of the repaired text."""
        cost, _, audit, parent, roles = min((n.cost + INSERT * len(audit), n.rank, audit, i, roles) for i, n in enumerate(self.nodes) for audit, stack, roles in inserted(n.stack) if stack[-1] in ENDS)
        digest, lines = self.nodes[parent].digest.copy(), self.nodes[parent].lines
        for r in roles:
            lines = _line(digest, lines, f"{ROLES[r]}:".encode())
        parts = [audit]
        for step in reversed(self.trail):
            parent, added = step[parent]
            parts.append(added)
        return cost, "".join(reversed(parts)), digest.hexdigest()


class Tally:
    """What is told of one conversation, row by row in the order of turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.repair = conv_id, Repair()
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = self.initial = None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.repair.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> tuple:
        gaps = 0 if self.turns == 0 else self.last_turn - self.first_turn + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end())


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TYPES = [pa.int64()] * 7 + [pa.string()] * 2
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def as_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone (false) of all rows; a null role or text is one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(False).alias("gone"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """as_rows() with faults planted by crc32("conv_id:turn") modulo 20, where a null id or turn is one space: 0 drops the row (gone
    is true, so that its conversation stays known), 1 empties the text, 2 removes `.!?`, 3 repeats the row, 4 makes the role user."""
    named = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    rows = as_rows(conversations).withColumn("k", F.crc32(named) % 20)
    text = F.when(F.col("k") <= 1, F.lit("")).when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), "k")
    return rows.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k", "copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows, a conversation in one partition and in the order of its turns (nulls first, then by role and text), with the column fault:
    blank, duplicate, truncated or null."""
    solid: Column = F.right(F.btrim("text", F.lit(BLANKS)), F.lit(1))
    # The window is dealt by conv_id, as the stream after it: texts travel once.
    again = F.row_number().over(W.partitionBy("conv_id", "role", F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), "gone").orderBy("turn")) > 1
    dealt = rows.repartition("conv_id").withColumn("again", again)
    fault = F.when(F.col("gone"), F.lit(None)).when(solid == "", F.lit("blank")).when(F.col("again"), F.lit("duplicate")).when(~solid.isin(".", "!", "?"), F.lit("truncated"))
    return dealt.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault")).sortWithinPartitions("conv_id", "turn", "role", "text", F.col("fault").isNotNull())


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: those of as_rows() or damaged(). A row's first fault counts: blank
    (white space alone), duplicate (role and text of an earlier row),
    truncated (ends without `.`, `!` or `?`). Blank and duplicate rows must
    go. The audit has a letter an edit (Delete, Insert, Keep, Rerole); of
    audits of the least cost it is the first in ASCII order, and it alone
    tells the repaired text: `role:text` of what stays, a line each.

    A null conv_id is a conversation of its own. Rows of one turn follow each
    other by role and text; null turns come first and count for no gap. A role
    that begins with none of s, u, a, also an empty one, can't be kept.
    A conversation without rows that aren't gone has zeros, an empty audit and
    the digest of the empty text. No rows give no rows. A conversation is read
    in one task, as its digest is that of a sequence, but only streamed:
    8 pointers a row stay in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, out = None, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)
            out.clear()
            return batch

        for batch in batches:
            for conv_id, turn, role, text, gone, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if tally is None or conv_id != tally.conv_id:
                    if tally:
                        out.append(tally.row())
                    tally = Tally(conv_id)
                if not gone:
                    tally.add(turn, role, text, fault)
            if out:
                yield flush()
        if tally:
            out.append(tally.row())
            yield flush()

    return with_faults(rows).mapInArrow(tidy(run), RESULT)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (from 0), role, text, action (keep, rerole, insert), nth (the row's place before, from 0; null where inserted).

    The audits are spelled out a letter a row and joined with the rows by
    their places, so no conversation is held as a whole."""
    named = with_faults(rows).filter(~F.col("gone"))
    numbered = named.withColumn("nth", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text", F.col("fault").isNotNull())) - 1)
    letters = repair_conversations(rows).select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "action")).filter(F.col("action") != "")
    so_far = W.partitionBy("conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    one = lambda letter: F.sum(F.when(letter, 1).otherwise(0)).over(so_far) - 1
    letters = letters.withColumn("nth", F.when(F.col("action") != "I", one(F.col("action") != "I"))).withColumn("place", one(F.col("action") != "D")).filter(F.col("action") != "D")
    joined = letters.join(numbered.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")) & (letters["nth"] == numbered["nth"]), "left").select("conv_id", "place", "role", "text", "action", letters["nth"])
    # In a repaired conversation a place alone tells the role of a new or changed row: after an s, if any, user and assistant take turns.
    led = F.max(F.when((F.col("place") == 0) & (F.col("action") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(W.partitionBy("conv_id"))
    new = F.when((F.col("place") - led) % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    name = F.when(F.col("action") == "K", "keep").when(F.col("action") == "R", "rerole").otherwise("insert")
    return joined.select("conv_id", F.col("place").cast("long").alias("place"), F.when(F.col("action") == "K", F.col("role")).otherwise(new).alias("role"), F.coalesce("text", F.lit("")).alias("text"), name.alias("action"), F.col("nth").cast("long").alias("nth"))

"""Conversation structure repair: generalised LR over the grammar of roles.

Wanted are the role sequences ``S -> (nothing) | H P``, ``H -> s | (nothing)``, ``P -> u a |
P u a``: an optional system turn, then user and assistant turns in pairs. Every row may
be kept, given another role or deleted, and turns may be inserted, each at a price; the
parser follows all of that at once and keeps the cheapest way to each stack.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .text import WHITE

# The LR tables of the grammar above; states are numbered as they arise.
SHIFT = {(0, "s"): 8, (1, "u"): 2, (2, "a"): 7, (3, "u"): 5, (5, "a"): 6}
EMPTY = {(0, "u"): "H"}                            # H -> (nothing), if u comes next
REDUCE = {8: ("H", 1), 7: ("P", 2), 6: ("P", 3)}   # the symbol made, how many it is made of
GOTO = {(0, "H"): 1, (1, "P"): 3}
ACCEPT = (0, 3)                                    # tops on which the input may end
LEGAL = ("su", "ua", "au")   # initials that may follow each other
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1                # added if a truncated row is not deleted
NAMES = {"u": "user", "a": "assistant"}
# What a top can still read: 0 all of S, 1 pairs (at least one), 2 and 5 an answer and pairs,
# 3 pairs or nothing. EXTRA[y, x]: by how much at most finishing from y costs more than from
# x, whatever comes: an unreadable system row is deleted, a missing turn or pair inserted.
WAITS = {0: "start", 1: "pair", 2: "answer", 5: "answer", 3: "more"}
EXTRA = {
    ("start", "start"): 0, ("start", "pair"): 0, ("start", "answer"): 2, ("start", "more"): 0,
    ("pair", "start"): 4, ("pair", "pair"): 0, ("pair", "answer"): 2, ("pair", "more"): 4,
    ("answer", "start"): 5, ("answer", "pair"): 2, ("answer", "answer"): 0, ("answer", "more"): 2,
    ("more", "start"): 3, ("more", "pair"): 0, ("more", "answer"): 2, ("more", "more"): 0,
}

BOTTOM = (0, None)


def _shift(stack: tuple, token: str) -> tuple | None:
    """The stack after a token and all reductions due; None if the token does not fit. A
    stack is (state, stack below), so stacks share what lies under their tops."""
    made = EMPTY.get((stack[0], token))
    if made:
        stack = (GOTO[stack[0], made], stack)
    state = SHIFT.get((stack[0], token))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        made, number = REDUCE[stack[0]]
        for _ in range(number):
            stack = stack[1]
        stack = (GOTO[stack[0], made], stack)
    return stack


def _merge(tops: dict, stack: tuple, found: tuple[int, str]) -> bool:
    """Equal stacks become one, with the smaller (cost, audit).

    That loses nothing: what follows adds the same to both. Two audits of equal cost that
    have read the same rows are never one the beginning of the other, as the longer one
    would have cost the inserts more, so their order stays whatever is appended.
    """
    if stack in tops and tops[stack] <= found:
        return False
    tops[stack] = found
    return True


def _inserted(tops: dict) -> dict:
    """The tops, and all that inserting turns makes of them."""
    tops, todo = dict(tops), deque(tops)
    while todo:
        stack = todo.popleft()
        cost, audit = tops[stack]
        for token in NAMES:
            after = _shift(stack, token)
            if after is not None and _merge(tops, after, (cost + COST["I"], audit + "I")):
                todo.append(after)
    return tops


@lru_cache(1 << 14)
def _advance(tops: tuple, initial: str, fault: str) -> tuple[tuple, int, str]:
    """One row further: the new tops, what all of them cost, and the audit they agree on.
    Tops that another beats whatever comes are given up.

    Costs and audits in the tops are what goes beyond that. A conversation therefore holds
    only the rows that are still open, and the same few tops come again and again.
    """
    after: dict = {}
    extra = TRUNCATED if fault == "truncated" else 0
    for stack, (cost, audit) in _inserted(dict(tops)).items():
        _merge(after, stack, (cost + COST["D"], audit + "D"))
        if fault not in ("blank", "duplicate"):
            for letter, token in (("K", initial), ("R", "u"), ("R", "a")):
                target = _shift(stack, token)
                if target is not None:
                    _merge(after, target, (cost + COST[letter] + extra, audit + letter))
    after = {x: found for x, found in after.items()
             if not any(found[0] > cost + EXTRA[WAITS[y[0]], WAITS[x[0]]] for y, (cost, _) in after.items())}
    least = min(cost for cost, _ in after.values())
    agreed = os.path.commonprefix([audit for _, audit in after.values()])
    rest = sorted(((stack, (cost - least, audit[len(agreed):])) for stack, (cost, audit) in after.items()), key=repr)
    return tuple(rest), least, agreed


@lru_cache(1 << 14)
def _end(tops: tuple) -> tuple[int, str]:
    """Cost and audit of the cheapest way to end here."""
    return min(found for stack, found in _inserted(dict(tops)).items() if stack[0] in ACCEPT)


class Conversation:
    """Reads the rows of one conversation in order; ``turns`` gets repaired turns
    (edit, role, text) as soon as they are certain."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.tops, self.cost, self.audit = ((BOTTOM, (0, "")),), 0, []
        self.open: deque = deque()
        self.seen: set[bytes] = set()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.least = self.most = None
        self.distinct = 0
        self.placed, self.shifted = 0, 0
        self.turns: list[tuple[str, str, str]] = []

    def read(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.most:  # turns come in order
            self.least, self.most = turn if self.least is None else self.least, turn
            self.distinct += 1
        data = text.encode("utf-8", "surrogatepass")
        key = hashlib.blake2b(b"%d:" % len(role) + role.encode("utf-8", "surrogatepass") + data, digest_size=16).digest()
        bare = text.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if key in self.seen else "truncated" if bare[-1] not in ".!?" else ""
        self.seen.add(key)
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.open.append((role, text))
        self.tops, cost, agreed = _advance(self.tops, initial, fault)
        self.cost += cost
        self._apply(agreed)

    def end(self) -> None:
        cost, rest = _end(self.tops)
        self.cost += cost
        self._apply(rest)

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.distinct

    def _apply(self, letters: str) -> None:
        if letters:
            self.audit.append(letters)
        for letter in letters:
            role, text = ("", "") if letter == "I" else self.open.popleft()
            if letter == "D":
                continue
            if not self.placed and letter == "K" and role[:1] == "s":
                self.shifted = 1
            if letter != "K":
                role = NAMES["a" if (self.placed - self.shifted) % 2 else "u"]
            self.turns.append((letter, role, text))
            self.placed += 1


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, bool]]:
    """(conversation, whether it has ended) for rows in order of (conversation, turn): each
    one at the end of its rows, and the last of a batch also at the batch's end."""
    now = None
    for batch in batches:
        for conv_id, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    now.end()
                    yield now, True
                now = Conversation(conv_id)
            if present:
                now.read(turn, role, text)
        if now is not None:
            yield now, False
    if now is not None:
        now.end()
        yield now, True


def _in_order(messages: DataFrame, conversation: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = messages.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), space(role).alias("role"),
                           space(text).alias("text"), (F.col(present) if present else F.lit(True)).alias("present"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def repair_report(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text", present: str | None = None) -> DataFrame:
    """What is wrong with each conversation, and its cheapest repair.

    Rows go in order of turn (null first), equal turns by role, then text. A row's fault is
    the first of: blank (only white space), duplicate (role and text stood earlier in the
    conversation), truncated (the last character that is not white space is none of
    ``.!?``). Edits are named by letters: K keeps (0), R gives the role user or assistant
    (2), D deletes (3), I inserts an empty user or assistant turn (2); blank and duplicate
    rows must go, a truncated row that stays costs 1 more. Of the cheapest repairs the one
    whose letters come first in ASCII is taken.

    Null roles and texts count as one space. Roles are told apart by their first character;
    a row whose role is empty or starts with none of s, u, a can only be deleted or given a
    role. A null conversation id is a conversation of its own. Repeated rows are duplicates.
    A row whose ``present`` column is false only announces its conversation: one without
    other rows has zeros, no edits and the digest of nothing. Extra columns are ignored; an
    empty table gives no rows.

    The digest is of a whole conversation, so its rows pass through one task, in order; the
    task holds the rows whose edits are not certain yet (few) and 16 bytes per row read.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (``role:text`` of the repaired turns, joined by line ends), n_turns.
    """
    kind = messages.schema[conversation].dataType
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = StructType([StructField("conv_id", kind), *[StructField(c, LongType()) for c in counts], StructField("audit", StringType()),
                      StructField("repaired_sha256", StringType()), StructField("n_turns", LongType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, digest, first = [], hashlib.sha256(), True
        for now, ended in _conversations(batches):
            for _, name, content in now.turns:
                digest.update((("" if first else "\n") + name + ":" + content).encode("utf-8", "surrogatepass"))
                first = False
            now.turns.clear()
            if ended:
                done.append((now.conv_id, now.gaps(), *now.faults.values(), now.illegal, now.cost, "".join(now.audit),
                             digest.hexdigest(), now.placed))
                digest, first = hashlib.sha256(), True
                if len(done) == 1000:
                    yield _batch(done, schema)
                    done = []
        yield _batch(done, schema)

    return _in_order(messages, conversation, turn, role, text, present).mapInArrow(run, out)


def repaired_turns(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text", present: str | None = None) -> DataFrame:
    """The repaired turns themselves: conv_id, place (from 0), edit, role, text. Rules and
    defined cases as in ``repair_report``; a conversation that loses all rows has none."""
    kind = messages.schema[conversation].dataType
    out = StructType([StructField("conv_id", kind), StructField("place", LongType()), StructField("edit", StringType()),
                      StructField("role", StringType()), StructField("text", StringType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for now, _ in _conversations(batches):
            start = now.placed - len(now.turns)
            done += [(now.conv_id, start + i, *t) for i, t in enumerate(now.turns)]
            now.turns.clear()
            if len(done) >= 1000:
                yield _batch(done, schema)
                done = []
        yield _batch(done, schema)

    return _in_order(messages, conversation, turn, role, text, present).mapInArrow(run, out)

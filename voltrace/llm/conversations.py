"""Repair of conversation structure: the cheapest edits that make turns alternate, and the ASCII-least of them.

Rows of a conversation are in order of turn (null first), then of role and text. A row is blank (no word), else a duplicate
(role and text seen earlier in the conversation), else truncated (its last character that is no white space isn't one
of . ! ?), else sound. Edits: Keep a row (0), Rerole it to user or assistant (1), Delete it (2, the only edit for blank rows
and duplicates), Insert a user or assistant turn without text anywhere (5); a truncated row that is not deleted costs 5 more. What is
left must read (s?(ua)+)? in role initials.

The method is a dynamic programme over turn and state of the grammar. One pass reads each conversation backwards and holds the
cost to go from each of the four states; for every row and state it notes the ASCII-least edit among those that keep
the cost tight. A second pass reads forwards, follows the notes from the first state, counts, and hashes the
turns as it rebuilds them. Both passes stream over sorted rows and hold one row's state, however long
a conversation is; equal rows of one turn are one row with a number, so copies leave before anything is sorted. One conversation is read by one
task, since its digest is one SHA-256 over its turns in order; no more than a state, a hash and the audit is held for it.

Defined results: a null role or text is one space; a null conversation id is a conversation of its own; null turns come first and don't
count for gaps; equal rows are duplicates; a role is judged by its first character, whatever follows, and an empty role fits nowhere;
a conversation without rows has zeros, an empty audit and the digest of the empty string; an empty table gives an empty result; other
columns are not carried. gaps beyond a long is the largest long. Conversation ids are whole numbers or strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType, StringType

from .common import SPACES

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, after s, after u, after a. The first and the last may end a conversation.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state that an inserted or reroled turn leads to: user is due in all states but behind a user.
DUE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: Cost to go behind the last row.
END = (0, 2 * INSERT, INSERT, 0)
LETTERS = "DKR"
LEGAL = {"su", "ua", "au"}
SOUND, CUT_OFF, BLANK, DUPLICATE = range(4)
_LARGEST = (1 << 63) - 1


@lru_cache(maxsize=1 << 16)
def step(ahead: tuple[int, ...], initial: str, extra: int) -> tuple[tuple[int, ...], int]:
    """Cost to go before a row, and the edits to take there, from the cost to go behind it (a tuple by state).

    The edits of state q are in bits 4q to 4q+3: 3 * (turns to insert first) + the edit of the row itself (0 D, 1 K, 2 R).
    """
    own = []
    for q in range(4):
        options = [DELETE + ahead[q], REROLE + extra + ahead[DUE[q]]]
        if (q, initial) in KEPT:
            options.append(KEEP + extra + ahead[KEPT[q, initial]])
        own.append(min(options))
    to_go = list(own)
    for _ in range(4):  # a turn inserted here leads to another state of the same place
        to_go = [min(to_go[q], INSERT + to_go[DUE[q]]) for q in range(4)]
    edits = 0
    for q in range(4):
        p, inserted = q, 0
        while True:
            if DELETE + ahead[p] == to_go[p]:
                letter = 0
            elif INSERT + to_go[DUE[p]] == to_go[p]:
                p, inserted = DUE[p], inserted + 1
                continue
            else:
                letter = 1 if (p, initial) in KEPT and KEEP + extra + ahead[KEPT[p, initial]] == to_go[p] else 2
            break
        edits |= (3 * inserted + letter) << (4 * q)
    return tuple(to_go), edits


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation come last to first; adds the edits of each state and the least cost from here on."""
    conv, base, ahead = None, 0, END  # cost to go is base + ahead, so few tuples are ever met
    for batch in batches:
        edits, cost = [], []
        for c, initial, fault, copies in zip(*(batch.column(n).to_pylist() for n in ("conv", "initial", "fault", "copies")), strict=True):
            if c != conv:
                conv, base, ahead = c, 0, END
            made = 0  # delete, in every state
            if fault in (BLANK, DUPLICATE):
                base += DELETE * copies
            elif copies:
                base += DELETE * (copies - 1)  # further copies are duplicates
                to_go, made = step(ahead, initial, TRUNCATED if fault == CUT_OFF else 0)
                least = min(to_go)
                base, ahead = base + least, tuple(x - least for x in to_go)
            edits.append(made)
            cost.append(base + ahead[START])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, pa.int32()), pa.array(cost, pa.int64())], [*batch.schema.names, "edits", "cost"])


class _Walk:
    """One conversation, read forwards."""

    def __init__(self, cost: int):
        self.cost, self.state, self.audit, self.hash, self.any = cost, START, [], hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.before = self.low = self.high = None

    def turn(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def insert(self) -> None:
        self.audit.append("I")
        self.turn("user" if DUE[self.state] == AFTER_U else "assistant", "")
        self.state = DUE[self.state]

    def row(self, turn: int | None, role: str, text: str, fault: int, copies: int, edits: int) -> None:
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.illegal += copies - 1
        self.before = initial
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += copies if fault == BLANK else 0
        self.duplicate += copies if fault == DUPLICATE else copies - 1 if fault != BLANK else 0
        self.truncated += fault == CUT_OFF
        if fault in (BLANK, DUPLICATE):
            self.audit.append("D" * copies)
            return
        inserted, letter = divmod(edits >> (4 * self.state) & 15, 3)
        for _ in range(inserted):
            self.insert()
        self.audit.append(LETTERS[letter])
        if letter == 1:
            self.turn(role, text)
            self.state = KEPT[self.state, initial]
        elif letter == 2:
            self.turn("user" if DUE[self.state] == AFTER_U else "assistant", text)
            self.state = DUE[self.state]
        self.audit.append("D" * (copies - 1))

    def result(self) -> tuple:
        while self.state not in (START, AFTER_A):
            self.insert()
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, _LARGEST)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_RESULT = pa.schema([("conv", pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_RESULT_SQL = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation come first to last; one row for each conversation."""
    conv, walk = None, _Walk(0)
    for batch in batches:
        done = []
        for c, turn, role, text, fault, copies, edits, cost in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "fault", "copies", "edits", "cost")), strict=True):
            if c != conv:
                if conv is not None:
                    done.append((conv, *walk.result()))
                conv, walk = c, _Walk(cost)
            if copies:
                walk.row(turn, role, text, fault, copies, edits)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*done, strict=True), _RESULT, strict=True)], schema=_RESULT)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((conv, *walk.result()), _RESULT, strict=True)], schema=_RESULT)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """rows with a column copies, after damage by crc32(conversation:turn) mod 20: 0 drops a row (copies 0), 1 empties its text, 2 takes its . ! ? away, 3 repeats it (copies 2), 4 makes its role user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(name(conv_col), F.lit(":"), name(turn_col)), "utf-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    return rows.withColumns({"text": text, "role": F.when(kind == 4, "user").otherwise(name("role")), "copies": F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)})


def _fault(text: Column, nth: Column) -> Column:
    last = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    return F.when(last == "", BLANK).when(nth > 1, DUPLICATE).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(SOUND)


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Per conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    rows: conversation, turn, role, text, and copies where a row stands for several or, with 0, only for its conversation.
    audit: initials of the edits in order. illegal: neighbours whose role initials aren't su, ua or au. gaps: turns missing between the first and the last.
    """
    kind = rows.schema[conv_col].dataType
    if not isinstance(kind, (IntegralType, StringType, NullType)):
        raise TypeError(f"{conv_col} is {kind.simpleString()}; conversations are named by whole numbers or strings")
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    text = lambda c: F.when(copies > 0, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("")
    each = rows.select(
        F.when(F.col(conv_col).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(conv_col).cast("string"))).alias("conv"),
        F.when(copies > 0, F.col(turn_col).cast("long")).alias("turn"),
        text("role").alias("role"),
        text("text").alias("text"),
        copies.alias("copies"),
    )
    order = ["turn", "role", "text"]
    # equal rows are added up by the tasks that read them; then each conversation is in one partition, sorted by spilling sorts
    each = each.groupBy("conv", *order).agg(F.sum("copies").alias("copies")).repartition("conv")
    nth = F.expr("count_if(copies > 0) OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST ROWS UNBOUNDED PRECEDING)")
    each = each.withColumn("nth", nth).select("conv", *order, "copies", _fault(F.col("text"), F.col("nth")).alias("fault"), F.substring("role", 1, 1).alias("initial"))
    noted = "conv string, turn long, role string, text string, copies long, fault int, initial string, edits int, cost long"
    back = each.sortWithinPartitions("conv", *[F.col(c).desc() for c in order]).mapInArrow(_backwards, noted)
    made = back.sortWithinPartitions("conv", *order).mapInArrow(_forwards, _RESULT_SQL)
    return made.select(F.when(F.col("conv") != "n", F.substring("conv", 2, 1 << 30)).cast(kind).alias(conv_col), *[n for n in _RESULT.names if n != "conv"])

"""Conversation structure repair by Wagner-Fischer alignment to a grammar's target strings.

A repaired conversation's role initials must spell ``(s?(ua)+)?``.  Rows that
are blank or repeat an earlier row must go (4 each); a row may stay (0), take
another role (3) or go (4); an empty user or assistant turn may be inserted
(3); a truncated row that stays costs 3 more.

Every feasible target is ``uaua..ua`` of some even length, alone or after one
``s``.  The last j letters of all of them agree, so one Wagner-Fischer table
of suffixes, "rows from i on against the last j letters", holds the alignment
to every feasible length.  A quick left-to-right repair gives an incumbent
cost, and Ukkonen's bound leaves out each cell whose surplus of rows or
letters alone costs more than the incumbent does.  Every length of least
cost is traced from its start, taking the ASCII-least edit that stays on a
cheapest path; the least audit of all lengths wins.  Only each ``BLOCK``-th
row of the table is kept, and a block is made again when a trace enters it.

Spark places the rows: of each conversation first narrow rows (role initial
and fault, found with windows over digests), then the same rows with their
texts, in one sorted stream per task.  A task holds one conversation's
initials and faults, a few bytes per row, and never its texts.

Order and ties: rows follow turn (nulls first), then role, then the SHA-256
of the text, so equal rows are neighbours; columns named otherwise are
ignored.  A null role or text is one blank; a null conv_id is a conversation
of its own; very long texts pass one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, as_batch, pieces, to_arrow

KEEP, REROLE, DELETE, INSERT = b"KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
GOOD, BLANK, DUPLICATE, TRUNCATED, ABSENT = range(5)
#: Rows of the alignment table between two that are kept.
BLOCK = 256
#: Role initials that may follow each other.
LEGAL = {"su", "ua", "au"}
FAR = 1 << 40
AUDIT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def letter(left: int) -> str:
    """The target's letter with ``left`` letters from it to the end, itself included."""
    return "a" if left % 2 else "u"


def incumbent(initials: list[str], faults: bytes) -> int:
    """The cost of a quick repair from left to right: roles alternate, a missing partner is inserted."""
    cost, last = 0, ""
    for role, fault in zip(initials, faults):
        if fault in (BLANK, DUPLICATE):
            cost += DELETE_COST
            continue
        cost += TRUNCATED_COST * (fault == TRUNCATED)
        want = "a" if last == "u" else "u"
        if role == want or role == "s" and not last:
            last = role
        elif role in ("u", "a"):
            cost += INSERT_COST  # its partner comes in before it
            last = role
        else:
            cost += REROLE_COST
            last = want
    return cost + {"u": INSERT_COST, "s": 2 * INSERT_COST}.get(last, 0)


class Alignment:
    """The table of one conversation: ``row(i)`` has the costs of rows from i on against the last j letters."""

    def __init__(self, initials: list[str], faults: bytes) -> None:
        self.roles, self.faults, n = initials, faults, len(initials)
        may_stay = [f not in (BLANK, DUPLICATE) for f in faults]
        torn = [f == TRUNCATED for f in faults]
        # what every repair costs: rows that must go, and 3 for each torn row whether it stays or goes
        self.limit = incumbent(initials, faults)
        spare = self.limit - sum(TRUNCATED_COST if t else 0 if m else DELETE_COST for m, t in zip(may_stay, torn))
        self.low, self.high = [0] * (n + 1), [spare // INSERT_COST] * (n + 1)
        staying = tears = 0
        for i in range(n - 1, -1, -1):
            staying, tears = staying + may_stay[i], tears + torn[i]
            cheap = min(spare, tears)  # a torn row may go for one more than it costs to stay, a sound one for four
            self.low[i] = max(0, staying - cheap - (spare - cheap) // DELETE_COST)
            self.high[i] = staying + spare // INSERT_COST
        self.kept = {n: np.arange(self.high[n] + 1, dtype=np.int64) * INSERT_COST}
        self.block: dict[int, np.ndarray] = {}
        below = self.kept[n]
        for i in range(n - 1, -1, -1):
            below = self.above(i, below)
            if i % BLOCK == 0 or n <= BLOCK:
                self.kept[i] = below

    def above(self, i: int, below: np.ndarray) -> np.ndarray:
        """Row i from row i + 1."""
        low, high, low1 = self.low[i], self.high[i], self.low[i + 1]
        wide = np.full(high - low + 2, FAR, np.int64)  # row i + 1 from j = low - 1 to high
        a, b = max(low - 1, low1), min(high, low1 + len(below) - 1)
        if b >= a:
            wide[a - low + 1:b - low + 2] = below[a - low1:b - low1 + 1]
        costs = wide[1:] + DELETE_COST
        fault = self.faults[i]
        if fault not in (BLANK, DUPLICATE):
            js = np.arange(low, high + 1)
            role = self.roles[i]
            stays = np.full(len(js), REROLE_COST, np.int64)
            if role in ("u", "a"):
                stays[(js % 2 == 1) == (role == "a")] = 0
            diagonal = wide[:-1] + stays + TRUNCATED_COST * (fault == TRUNCATED)
            if low == 0:
                diagonal[0] = FAR
            costs = np.minimum(costs, diagonal)
        steps = np.arange(len(costs), dtype=np.int64) * INSERT_COST  # inserts run along the row
        return np.minimum.accumulate(costs - steps) + steps

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            top = (i // BLOCK) * BLOCK
            k = min(top + BLOCK, len(self.roles))
            self.block, below = {}, self.kept[k]
            for x in range(k - 1, top - 1, -1):
                self.block[x] = below = self.above(x, below)
        return self.block[i]

    def cost(self, i: int, j: int) -> int:
        low = self.low[i]
        costs = self.row(i)
        return int(costs[j - low]) if low <= j < low + len(costs) else FAR

    def starts(self) -> Iterator[tuple[int, int, int]]:
        """Cost, rows deleted before a kept system row (or -1) and letters, for every feasible length."""
        top = self.row(0)
        for j in range(self.low[0] + self.low[0] % 2, self.low[0] + len(top), 2):
            yield int(top[j - self.low[0]]), -1, j
        for p, (role, fault) in enumerate(zip(self.roles, self.faults)):
            if DELETE_COST * p > self.limit:
                break
            if role == "s" and fault not in (BLANK, DUPLICATE):
                before = DELETE_COST * p + TRUNCATED_COST * (fault == TRUNCATED)
                costs = self.row(p + 1)
                first = max(2, self.low[p + 1] + self.low[p + 1] % 2)
                for j in range(first, self.low[p + 1] + len(costs), 2):
                    yield before + int(costs[j - self.low[p + 1]]), p, j

    def trace(self, i: int, j: int) -> bytes:
        """The ASCII-least cheapest edits of rows from i on against the last j letters."""
        out, n = bytearray(), len(self.roles)
        while i < n or j:
            here = self.cost(i, j)
            if i < n and self.cost(i + 1, j) + DELETE_COST == here:
                out.append(DELETE)
                i += 1
            elif j and self.cost(i, j - 1) + INSERT_COST == here:
                out.append(INSERT)
                j -= 1
            else:
                out.append(KEEP if self.roles[i] == letter(j) else REROLE)
                i, j = i + 1, j - 1
        return bytes(out)

    def best(self) -> tuple[int, bytes, bool, int]:
        """Least cost, its least audit, whether a system row leads, and the letters after it."""
        least, found = FAR, []
        for cost, p, j in self.starts():
            if cost < least:
                least, found = cost, []
            if cost == least:
                found.append((p, j))
        audit, p, j = min((self.trace(0, j) if p < 0 else bytes([DELETE] * p + [KEEP]) + self.trace(p + 1, j), p, j) for p, j in found)
        return least, audit, p >= 0, j


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest and fault of every row; text and role have no nulls."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def fault_of(nth: Column) -> Column:
    """The row's first fault; ``nth`` counts the conversation's rows of this role and text."""
    end = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    return (F.when(end == "", BLANK).when(nth > 1, DUPLICATE)
            .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(GOOD))


def stream(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Rows sorted for ``repair_rows``: of each conversation all narrow rows, then all texts.

    ``conversations`` may name conv_ids without rows; each gives one audit too.
    """
    rows = marked(turns)
    # the end of the text travels for the fault, not the text: a window moves narrow rows only
    tail = F.right(F.rtrim(F.col("text"), F.lit(ASCII_SPACE)), F.lit(1))
    narrow = rows.select("conv_id", "turn", "role", "digest", tail.alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    narrow = narrow.withColumn("nth", nth).select("conv_id", F.lit(0).alias("phase"), "turn", "role", "digest", "nth",
                                                  fault_of(F.col("nth")).alias("fault"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", F.lit(1).alias("phase"), "turn", "role", "digest", F.lit(0).alias("nth"), F.lit(GOOD).alias("fault"), "text")
    every = narrow.unionByName(texts)
    if conversations is not None:
        every = every.unionByName(conversations.select("conv_id").distinct().select(
            "conv_id", F.lit(0).alias("phase"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
            F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("nth"), F.lit(ABSENT).alias("fault"), F.lit(None).cast("string").alias("text")))
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "phase", F.col("turn").asc_nulls_first(), "role", "digest", "nth")


class Conversation:
    """One conversation on its way through a task."""

    def __init__(self) -> None:
        self.initials: list[str] = []
        self.faults = bytearray()
        self.low = self.high = self.last = None
        self.distinct = 0
        self.audit: bytes | None = None

    def see(self, turn: int | None, role: str, fault: int) -> None:
        if fault == ABSENT:
            return
        self.initials.append(role[:1])
        self.faults.append(fault)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.last
            self.high = self.last = turn

    def align(self) -> None:
        self.cost, self.audit, self.system, self.letters = Alignment(self.initials, bytes(self.faults)).best()
        self.at, self.done, self.sha = 0, 0, hashlib.sha256()

    def target(self) -> str:
        """Role of the next repaired turn."""
        left = self.letters - (self.done - self.system)
        return "user" if letter(left) == "u" else "assistant"

    def put(self, role: str, text: str) -> tuple[int, str, str]:
        if self.done:
            self.sha.update(b"\n")
        self.sha.update(f"{role}:{text}".encode())
        self.done += 1
        return self.done - 1, role, text

    def inserted(self) -> Iterator[tuple[int, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            yield self.put(self.target(), "")

    def edit(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        """The repaired turns up to and with this row."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            yield self.put(role, text)
        elif edit == REROLE:
            yield self.put(self.target(), text)

    def summary(self) -> tuple:
        r = self.initials
        count = lambda f: self.faults.count(f)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (gaps, count(BLANK), count(DUPLICATE), count(TRUNCATED), sum(a + b not in LEGAL for a, b in zip(r, r[1:])),
                self.cost, self.audit.decode(), self.sha.hexdigest())


def repair_rows(sorted_rows: DataFrame, turns: bool) -> DataFrame:
    """Repaired turns (conv_id, position, role, text), or one audit row per conversation, of a sorted stream."""
    kind = sorted_rows.schema["conv_id"].dataType.simpleString()
    schema = T._parse_datatype_string(f"conv_id {kind}, " + ("position long, role string, text string" if turns else AUDIT))
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, now, c = 0, None, None

        def close() -> Iterator[tuple]:
            if c.audit is None:
                c.align()
            rest = [(now, *t) for t in c.inserted()]
            return iter(rest if turns else [(now, *c.summary())])

        for batch in batches:
            for conv_id, phase, turn, role, fault, text in zip(*(pieces(x) for x in batch.columns)):
                if c is None or conv_id != now:
                    if c is not None:
                        out.extend(close())
                    now, c = conv_id, Conversation()
                if phase == 0:
                    c.see(turn, role, fault)
                    continue
                if c.audit is None:
                    c.align()
                for t in c.edit(role, text):
                    if turns:
                        out.append((now, *t))
                        size += len(text)
                if len(out) >= 4096 or size > 1 << 22:
                    yield as_batch(out, arrow)
                    out, size = [], 0
        if c is not None:
            out.extend(close())
        if out:
            yield as_batch(out, arrow)

    return sorted_rows.select("conv_id", "phase", "turn", "role", "fault", "text").mapInArrow(run, schema)


def audits(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, faults, illegal neighbours, cost, audit and the repaired text's digest."""
    return repair_rows(stream(turns, conversations), turns=False)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations' turns: conv_id, position (from 0), role, text."""
    return repair_rows(stream(turns), turns=True)

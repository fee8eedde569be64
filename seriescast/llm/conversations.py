"""Operator 11, conversation structure repair: a secondary-sorted stream with a DP over role states.

Rows are dealt out by conversation and sorted by turn.  ``mapInPandas`` then reads each
conversation as a stream; what it carries from row to row and from batch to batch is
four DP states (what the repaired roles end in: nothing, s, u or a), each with its
least cost, its rank among equally long histories and a running SHA-256 of its
repaired text.  Per row and state one byte says which edit led there; these backpointers
leave memory in chunks of ``SPILL`` bytes for a file beside Spark's own shuffle spills, and
are read backwards once at a conversation's end for the audit string.  So a
conversation of any length needs constant memory but for its audit string.

Ties: of two histories that end in one state at one cost neither is a prefix of the
other (each holds one letter per row, and a further insert costs 2), so their order stays
whatever follows, and ranks decide as whole strings would.

A row repeats an earlier one if its role and text stood at an earlier turn, or just
before it at the same turn.  Earlier turns are found by an aggregate over digests beforehand and
arrive as small marker rows in front of the rows of their turn, so the stream holds
the markers of one turn at a time.

Defined cases: a null conversation id is one conversation, whose row has a null id; null turns sort first
and count as one space in the checksum, like null ids, roles and texts; rows of equal turn are
taken in the order of role, then text; repeated rows count as
rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescast.llm.text import BROADCAST_IDS, WHITE, written

SPILL = 1 << 20      # bytes of backpointers held in memory
STATES = 4           # repaired roles so far: none, s, ...u, ...a
KEEP, REROLE, DELETE = "K", "R", "D"
OPS = (KEEP, REROLE, DELETE)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {"u": "user", "a": "assistant"}
FILLER = {t: r for (t, r) in AFTER if r != "s"}          # the role that may be inserted in a state
ENDS = {0: "", 1: "ua", 2: "a", 3: ""}                   # roles to insert after the last row
LEGAL = {"su", "ua", "au"}
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 2, 3, 2, 1

Move = tuple[int, int, str, int, int, str]               # from, inserts, edit, to, cost, letters


def moves(initial: str, must_go: bool, truncated: bool) -> list[Move]:
    """Every way to take a row from one state to another: inserts before it, then its edit."""
    out = [(t, 0, DELETE, t, COST_DELETE, DELETE) for t in range(STATES)]
    if must_go:
        return out
    for t in range(STATES):
        for k in (0, 1):  # two inserts lead back to where the state's own moves are
            at = AFTER[t, FILLER[t]] if k else t
            for edit in (KEEP, REROLE):
                role = initial if edit == KEEP else FILLER[at]
                if (at, role) in AFTER:
                    cost = COST_INSERT * k + (COST_REROLE if edit == REROLE else 0) + COST_TRUNCATED * truncated
                    out.append((t, k, edit, AFTER[at, role], cost, "I" * k + edit))
    return out


MOVES = {(i, gone, cut): moves(i, gone, cut) for i in ("s", "u", "a", "") for gone in (False, True)
         for cut in (False, True)}


class Repair:
    """One conversation: rows go in by turn, ``result`` gives the counts, audit and digest."""

    def __init__(self, spill: int = SPILL):
        self.spill = spill
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.text = [hashlib.sha256(), None, None, None]
        self.begun = [False] * STATES
        self.back = bytearray()
        self.file: BinaryIO | None = None
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.low = self.high = self.turn = None
        self.turns = 0
        self.initial: str | None = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        self.rows += 1
        shown = text.rstrip(WHITE)
        blank = not shown
        cut = not blank and not seen and shown[-1] not in ".!?"
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut
        self._step(MOVES[initial if initial in ("s", "u", "a") else "", blank or seen, cut], role, text)

    def _step(self, ways: list[Move], role: str, text: str) -> None:
        best: list = [None] * STATES
        for way in ways:
            c = self.cost[way[0]]
            if c is not None:
                key = (c + way[4], self.rank[way[0]], way[5])
                if best[way[3]] is None or key < best[way[3]][0]:
                    best[way[3]] = (key, way)
        order = sorted((b[0][1:], s) for s, b in enumerate(best) if b)
        rank = [0] * STATES
        for i, (_, s) in enumerate(order):
            rank[s] = i
        begun, digest = list(self.begun), list(self.text)
        for s, b in enumerate(best):
            if b is None:
                self.cost[s] = None
                self.back.append(255)
                continue
            t, k, edit = b[1][:3]
            self.back.append(t << 3 | k << 2 | OPS.index(edit))
            if edit == DELETE:
                continue
            h = digest[t].copy()
            parts = [] if not begun[t] else [""]
            if k:
                parts.append(ROLE[FILLER[t]] + ":")
            at = AFTER[t, FILLER[t]] if k else t
            parts.append(f"{role if edit == KEEP else ROLE[FILLER[at]]}:{text}")
            h.update("\n".join(parts).encode("utf-8", "surrogatepass"))
            self.text[s], self.begun[s] = h, True
        self.cost = [b[0][0] if b else None for b in best]
        self.rank = rank
        if len(self.back) >= self.spill:
            if self.file is None:
                folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
                self.file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
            self.file.write(self.back)
            self.back = bytearray()

    def _backwards(self) -> Iterator[bytes]:
        """The backpointers of the rows from the last to the first, in chunks of whole rows."""
        yield bytes(self.back)
        if self.file is not None:
            size = self.spill + -self.spill % STATES
            for at in range(self.file.tell() - size, -1, -size):
                self.file.seek(at)
                yield self.file.read(size)
            self.file.close()

    def _audit(self, state: int) -> str:
        out = bytearray(b"I" * len(ENDS[state]))
        for chunk in self._backwards():
            for i in range(len(chunk) - STATES, -1, -STATES):
                p = chunk[i + state]
                out += OPS[p & 3].encode() + (b"I" if p & 4 else b"")
                state = p >> 3
        out.reverse()
        return out.decode()

    def result(self) -> dict:
        key, end = min(((c + COST_INSERT * len(ENDS[s]), self.rank[s], ENDS[s]), s)
                       for s, c in enumerate(self.cost) if c is not None)
        tail = [ROLE[r] + ":" for r in ENDS[end]]
        h = self.text[end].copy()
        if tail:
            h.update("\n".join([""] * self.begun[end] + tail).encode())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": min(gaps, 2 ** 63 - 1), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": key[0], "audit": self._audit(end), "repaired_sha256": h.hexdigest()}


def digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The rows after damage: conv (string), timed, turn, role, text, times (0: dropped, 2: repeated)."""
    def full(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(full(conv_col), F.lit(":"), full(turn_col)).cast("binary")) % 20
    text = (F.when(code == 1, F.lit("")).when(code == 2, F.translate(full(text_col), ".!?", ""))
            .otherwise(full(text_col)))
    return rows.select(
        F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).isNotNull().alias("timed"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
        F.when(code == 4, F.lit("user")).otherwise(full(role_col)).alias("role"),
        F.when(code == 0, F.lit("")).otherwise(text).alias("text"),
        F.when(code == 0, F.lit(0)).when(code == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"))


def repeats(rows: DataFrame) -> DataFrame:
    """(conv, timed, turn, digest) of damaged rows whose role and text stand at an earlier turn."""
    when = F.struct("timed", "turn")
    thin = (rows.where(F.col("times") > 0).where(F.trim(F.translate("text", WHITE, " " * len(WHITE))) != "")
            .select("conv", when.alias("at"), _digest(F.col("role"), F.col("text")).alias("digest")))
    several = written(thin.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last"))
                      .where("first < last").select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first"))
    several = F.broadcast(several) if several.count() <= BROADCAST_IDS else several.hint("merge")
    return (thin.join(several, F.expr("conv <=> c AND digest = d")).where("at > first")
            .select("conv", "at.timed", "at.turn", "digest").distinct())


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SCHEMA = "conv string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, state, marks, at, before = None, None, set(), None, None
    done: list[dict] = []
    for batch in batches:
        cols = [batch[c].tolist() for c in ("conv", "timed", "turn", "role", "text", "times", "digest")]
        for c, timed, turn, role, text, times, mark in zip(*cols):
            if state is None or c != conv:
                if state is not None:
                    done.append({"conv": conv, **state.result()})
                conv, state, marks, at = c, Repair(), set(), None
            if (timed, turn) != at:
                at, before = (timed, turn), None
                marks.clear()
            if mark is not None:
                marks.add(bytes(mark))
                continue
            for _ in range(times):
                seen = before == (role, text) or (bool(marks) and digest(role, text) in marks)
                before = (role, text)
                state.add(turn if timed else None, role, text, seen)
        if len(done) >= 10_000:
            yield pd.DataFrame(done)
            done = []
    if state is not None:
        done.append({"conv": conv, **state.result()})
    if done:
        yield pd.DataFrame(done)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256, of the rows after ``damage``."""
    hurt = damage(rows, conv_col, turn_col, role_col, text_col)
    marks = repeats(hurt).select("conv", "timed", "turn", F.lit("").alias("role"), F.lit("").alias("text"),
                                 F.lit(0).alias("times"), "digest")
    every = hurt.withColumn("digest", F.lit(None).cast("binary")).unionByName(marks)
    dealt = every.repartition("conv").sortWithinPartitions("conv", "timed", "turn", F.col("digest").isNull(), "role", "text")
    kind = rows.schema[conv_col].dataType
    return dealt.mapInPandas(_stream, SCHEMA).select(
        F.col("conv").cast(kind).alias("conv_id"), *COUNTS, "audit", "repaired_sha256")

"""Repair of conversation structure: the cheapest edits that give turns an order of roles, in one streamed pass.

Rows are repartitioned by conversation and sorted from the last turn to the first. Cost-to-go of the four states of
the role pattern is carried across Arrow batches, and one byte of decisions per row is kept, spilled to disk for giant
conversations; at the first turn the decisions are read back in order, which gives the least audit among the cheapest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themeloom.llm.common import SEPARATOR_CHARS
from themeloom.llm.spill import SpillingStack

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
# States of the pattern (s?(ua)+)?: nothing yet, after the system turn, after a user turn, after an assistant turn.
# What each state may be followed by, and what an inserted or renamed turn must be there.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = ("user", "user", "assistant", "user")
ACCEPTING = (0, 3)
_NEVER = 1 << 60
_EDITS = "DIKR"  # in ASCII order, the number is what a decision stores in two bits


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with planted faults, by crc32 of 'conv_id:turn' modulo 20 (nulls as one space).

    0: the row goes, 1: its text is emptied, 2: `.`, `!` and `?` go, 3: the row comes twice, 4: its role becomes user.
    Rows that go stay as rows with `gone`, so that their conversation is still known.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")) % 20
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    rows = conversations.select("conv_id", "turn", spaced["role"].alias("_role"), spaced["text"].alias("_text"), kind.alias("_k"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("_role")).alias("role"), text.alias("text"), (F.col("_k") == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Adds the first fault of each row: B blank, D duplicate, T truncated or '' for none."""
    kept = F.btrim("text", F.lit(SEPARATOR_CHARS))
    return rows.withColumn(
        "fault",
        F.when(F.col("gone"), "").when(kept == "", "B").when(F.col("_seen") > 1, "D").when(~F.substring(kept, -1, 1).isin(".", "!", "?"), "T").otherwise(""),
    )


class _Conversation:
    """One conversation's state while its rows come last first."""

    def __init__(self, key: str | None, spill: int):
        self.key, self.stack = key, SpillingStack(spill)
        self.cost = [0 if s in ACCEPTING else _NEVER for s in range(4)]
        self.stop = self._inserts()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.rows = 0
        self.following = self.last = None
        self.low = self.high = self.seen = None

    def _inserts(self) -> list[bool]:
        """Lets inserted turns lower the cost of states; tells for which they do. Two rounds settle a cycle of two."""
        used = [False] * 4
        for _ in range(3):
            for s in range(4):
                c = INSERT + self.cost[NEXT[s][WANTED[s][0]]]
                if c < self.cost[s]:
                    self.cost[s], used[s] = c, True
        return used

    def add(self, role: str, text: str, fault: str, turn: int | None) -> None:
        self.rows += 1
        self.blank += fault == "B"
        self.duplicate += fault == "D"
        self.truncated += fault == "T"
        initial = role[:1]
        if self.following is not None and initial + self.following not in LEGAL:
            self.illegal += 1
        self.following = initial
        if turn is not None:
            self.high = turn if self.high is None else self.high
            self.turns += turn != self.seen
            self.low = self.seen = turn
        after, extra = self.cost, TRUNCATED * (fault == "T")
        must_go = fault in ("B", "D")
        best = []
        for s in range(4):
            options = [(DELETE + after[s], "D")]
            if not must_go:
                if initial in NEXT[s]:
                    options.append((extra + after[NEXT[s][initial]], "K"))
                options.append((REROLE + extra + after[NEXT[s][WANTED[s][0]]], "R"))
            best.append(min(options))
        self.cost = [c for c, _ in best]
        plain = self.cost[:]
        self._inserts()
        packed = 0
        for s in range(4):
            # An insertion comes first in ASCII order unless a deletion is as cheap.
            insert = INSERT + self.cost[NEXT[s][WANTED[s][0]]]
            edit = "I" if insert < plain[s] or (insert == plain[s] and best[s][1] > "I") else best[s][1]
            packed |= _EDITS.index(edit) << (2 * s)
        self.stack.push((packed, role, text), len(role) + len(text) + 80)

    def finish(self) -> tuple[dict, Iterator[tuple[str, str, str]]]:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        figures = {
            "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost[0],
        }
        return figures, self._edits()

    def _edits(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) in order; role and text are those of the repaired turn."""
        state = 0
        for packed, role, text in self.stack.drain():
            while (edit := _EDITS[packed >> (2 * state) & 3]) == "I":
                yield "I", WANTED[state], ""
                state = NEXT[state][WANTED[state][0]]
            if edit == "R":
                role = WANTED[state]
            if edit != "D":
                state = NEXT[state][role[:1]]
            yield edit, role, text
        while state not in ACCEPTING:
            yield "I", WANTED[state], ""
            state = NEXT[state][WANTED[state][0]]


def _streamed(rows: DataFrame, give, kind: str, spill: int) -> DataFrame:
    """Conversations whole and last turn first, handed to `give` one by one as they end, across batches."""
    known = rows.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.coalesce("gone", F.lit(False)).alias("gone"),
    )
    dealt = known.repartition("conv_id")
    # Both windows and the sort below find the rows of a conversation in place: one shuffle in all.
    seen = F.row_number().over(W.partitionBy("conv_id", "gone", F.xxhash64("role", "text"), F.xxhash64(F.lit("second"), "text", "role")).orderBy(F.asc_nulls_first("turn")))
    faulty = _faults(dealt.withColumn("_seen", seen))
    backwards = faulty.sortWithinPartitions(F.col("conv_id"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("_seen"))
    # Ids and turns travel as text: pandas would turn columns with nulls into floats.
    told = backwards.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text", "gone", "fault")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = None
        for batch in batches:
            for key, turn, role, text, gone, fault in zip(*(batch[c] for c in ("conv_id", "turn", "role", "text", "gone", "fault"))):
                key = None if key is None or key != key else key
                if current is None or key != current.key:
                    if current is not None:
                        yield from give(current)
                    current = _Conversation(key, spill)
                if not gone:
                    current.add(role, text, fault, None if turn is None or turn != turn else int(turn))
        if current is not None:
            yield from give(current)

    return told.mapInPandas(_batched(stream), kind)


def _batched(stream, rows: int = 2048):
    def run(batches):
        held = []
        for row in stream(batches):
            held.append(row)
            if len(held) == rows:
                yield pd.DataFrame(held)
                held = []
        if held:
            yield pd.DataFrame(held)

    return run


def repair(rows: DataFrame, spill: int = 1 << 24) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text, gone): faults, cost, audit and repaired_sha256.

    Rows are ordered by turn, nulls first, ties by role and text. A row's first fault counts: blank, duplicate of an
    earlier role and text, truncated (last character but separators not one of `.!?`). gaps: turn numbers missing
    between the least and the greatest. illegal: neighbours whose role initials are not su, ua or au. Edits: K keep
    (0), R rename to user or assistant (3), D delete (4; blank and duplicate rows must go), I insert an empty turn (3);
    a truncated row that stays adds 3. audit is the ASCII-least among the cheapest that give initials `(s?(ua)+)?`.
    Null roles and texts are one space; rows marked `gone` only keep their conversation in the result, with zeros, no
    audit and the hash of '' if nothing else is left. Null ids form one conversation. Memory is bounded by `spill`
    bytes of held rows, but for the audit itself, which is one value of the result.
    """
    def give(c: _Conversation):
        figures, edits = c.finish()
        audit, digest, between = [], hashlib.sha256(), b""
        for edit, role, text in edits:
            audit.append(edit)
            if edit != "D":
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
        yield {"conv_id": c.key, **figures, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    kind = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    found = _streamed(rows, give, kind, spill)
    return found.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def repaired_turns(rows: DataFrame, spill: int = 1 << 24) -> DataFrame:
    """The repaired conversations themselves: conv_id, turn (from 0), role, text and the edit that made each turn."""
    def give(c: _Conversation):
        place = 0
        for edit, role, text in c.finish()[1]:
            if edit != "D":
                yield {"conv_id": c.key, "turn": place, "role": role, "text": text, "edit": edit}
                place += 1

    found = _streamed(rows, give, "conv_id string, turn long, role string, text string, edit string", spill)
    return found.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))

"""Conversation structure repair by depth-first branch-and-bound.

A conversation's rows in order of turn are kept (K), given another role (R) or deleted (D), and empty
rows are inserted (I), so that the initials of the roles read ``(s?(ua)+)?`` at the least cost, and of equally
cheap edits the audit, the edits' letters in order, is the ASCII-least. A node of the search is a
row and a state of the pattern. An explicit stack holds prefixes of edits, ASCII-least on top; each branch has a
lower bound for what is still to come (the cheapest completion from its state, audits left out); a table
for each node drops prefixes that are dearer or later than one that was there before; the incumbent
(cost, audit) is replaced until nothing on the stack can beat it, which proves it best.

Conversations are brought together by hash, sorted in Spark (which spills) and streamed. A conversation over
``SEGMENT`` rows or ``SEGMENT_CHARS`` characters is searched in segments, from each state that can begin one to each that can end it;
two equally cheap edits of the same rows that end in the same state differ before either ends, so the
best of a whole is made of best segments. A worker holds a segment, and for each of four states an
audit (a byte for each edit) and a running digest, however long the conversation.

Defined results: nulls of role and text are one space, null turns come first and count in no gap, null
conversation ids are one conversation; rows of equal turn are ordered by role, text; roles are
judged by their first character alone, and a role without one, or with another than s, u and a, can't be kept; extra
columns are left out; a conversation without rows (all dropped) has an empty audit; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import table

#: Rows and characters of a segment.
SEGMENT, SEGMENT_CHARS = 256, 1 << 22
#: What edits cost: a new role, a deletion, an insertion; a truncated row that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Faults of a row.
NONE, BLANK, DUPLICATE, CUT = range(4)
#: States of the pattern: nothing yet, after s, after u, after a. The state after each initial, the role that can be added, and where it may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADDED = ("u", "u", "a", "u")
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
SPACES, STOPS = " \t\n\x0b\x0c\r", (".", "!", "?")
FAR = 1 << 60


def completions(rows: list[tuple[int, str]], ends: tuple[int, ...]) -> list[list[int]]:
    """The least cost from each row and state to the end of the rows (fault, initial) in one of the states ``ends``."""

    def inserted(cost: list[int]) -> list[int]:
        for _ in range(2):
            cost = [min(cost[s], INSERT + cost[NEXT[s][ADDED[s]]]) for s in range(4)]
        return cost

    left = [inserted([0 if s in ends else FAR for s in range(4)])]
    for fault, initial in reversed(rows):
        after, more = left[-1], TRUNCATED * (fault == CUT)
        here = []
        for s in range(4):
            best = DELETE + after[s]
            if fault not in (BLANK, DUPLICATE):
                best = min(best, REROLE + more + after[NEXT[s][ADDED[s]]])
                if initial in NEXT[s]:
                    best = min(best, more + after[NEXT[s][initial]])
            here.append(best)
        left.append(inserted(here))
    return left[::-1]


def search(rows: list[tuple[int, str]], begin: int, ends: tuple[int, ...]) -> tuple[int, str, int] | None:
    """(cost, audit, last state) of the best edits of rows (fault, initial) that lead from a state to one of ``ends``; None if none do."""
    n, left = len(rows), completions(rows, ends)
    if left[0][begin] >= FAR:
        return None
    incumbent: tuple[int, str, int] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, begin, 0, "")]
    while stack:
        row, state, cost, audit = stack.pop()
        least = cost + left[row][state]
        if least >= FAR or incumbent is not None and (least, audit) > (incumbent[0], incumbent[1][: len(audit)]):
            continue
        before = reached.get((row, state))
        if before is not None and before <= (cost, audit):
            continue
        reached[row, state] = cost, audit
        if row == n and state in ends and (incumbent is None or (cost, audit) < incumbent[:2]):
            incumbent = cost, audit, state
        branches = []  # in order of their letters, the last first
        added = NEXT[state][ADDED[state]]
        if row < n:
            fault, initial = rows[row]
            more = TRUNCATED * (fault == CUT)
            if fault not in (BLANK, DUPLICATE):
                branches.append((row + 1, added, cost + REROLE + more, audit + "R"))
                if initial in NEXT[state]:
                    branches.append((row + 1, NEXT[state][initial], cost + more, audit + "K"))
        branches.append((row, added, cost + INSERT, audit + "I"))
        if row < n:
            branches.append((row + 1, state, cost + DELETE, audit + "D"))
        stack += branches
    return incumbent


def repaired(rows: list[tuple[int, str, str, str]], state: int, audit: str) -> Iterator[tuple[str, str, str]]:
    """(initial, role, text) of what edits of rows (fault, initial, role, text) leave, from a state on."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        initial = rows[at][1] if edit == "K" else ADDED[state]
        role = rows[at][2] if edit == "K" else ROLES[initial]
        yield initial, role, "" if edit == "I" else rows[at][3]
        state = NEXT[state][initial]
        at += edit != "I"


class Conversation:
    """What is known of a conversation while its rows come in: counts, and the best edits so far that end in each state."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.faults, self.illegal, self.initial = [0, 0, 0, 0], 0, None
        self.turns, self.low, self.high = 0, None, None
        self.rows: list[tuple[int, str, str, str]] = []
        self.chars = 0
        #: state -> (cost, audit, initials after repair, digest)
        self.best = {0: (0, "", "", hashlib.sha256())}

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if len(self.rows) >= SEGMENT or self.chars >= SEGMENT_CHARS:
            self.close(((0,), (1,), (2,), (3,)))
        self.rows.append((fault, initial, role, text))
        self.chars += len(text)

    def close(self, groups: tuple[tuple[int, ...], ...]) -> None:
        """Search the segment that is held, for the best edits that end in each group of states."""
        own, found = [r[:2] for r in self.rows], {}
        for ends in groups:
            ways = [(cost + way[0], audit + way[1], begin, way) for begin, (cost, audit, _, _) in self.best.items() if (way := search(own, begin, ends))]
            if ways:
                cost, audit, begin, way = min(ways, key=lambda x: x[:2])
                _, _, initials, digest = self.best[begin]
                digest = digest.copy()
                for initial, role, text in repaired(self.rows, begin, way[1]):
                    digest.update(f"{chr(10) if initials else ''}{role}:{text}".encode())
                    initials += initial
                found[way[2]] = cost, audit, initials, digest
        self.best, self.rows, self.chars = found, [], 0

    def result(self) -> tuple:
        self.close((ENDS,))
        ((cost, audit, initials, digest),) = self.best.values()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *self.faults[BLANK:], self.illegal, cost, audit, initials, digest.hexdigest()


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, initials string, repaired_sha256 string"


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, dropped, role, text, fault) of rows (conv_id, turn, role, text, and dropped where rows are), with each conversation's rows together and in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    d = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), dropped.alias("dropped"), role, text).repartition("conv_id")
    turn = F.asc_nulls_first("turn")
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(turn))  # within a conversation, where its rows already are
    shown = F.rtrim("text", F.lit(SPACES))
    fault = F.when(shown == "", BLANK).when(F.col("again") > 1, DUPLICATE).when(~F.right(shown, F.lit(1)).isin(*STOPS), CUT).otherwise(NONE)
    d = d.withColumn("again", again).withColumn("fault", fault)
    return d.sortWithinPartitions("conv_id", turn, "role", "text", "again").drop("again")


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of rows (conv_id, turn, role, text): its faults, the best edits, the initials after them, and a digest of what they leave."""

    def run(batches):
        held = None
        for batch in batches:
            done = []
            for conv_id, turn, dropped, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held.conv_id != conv_id:
                    done += [held.result()] if held else []
                    held = Conversation(conv_id)
                if not dropped:
                    held.add(turn, role, text, fault)
            if done:
                yield batch_of(done, batch.schema.field("conv_id").type)
        if held is not None:
            yield batch_of([held.result()], batch.schema.field("conv_id").type)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered(rows).mapInArrow(run, f"conv_id {kind}, {PLAN}")


def batch_of(results: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", *(x.split()[0] for x in PLAN.split(", "))]
    kinds = [kind, *[pa.int64()] * 6, *[pa.string()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*results, strict=True), kinds, strict=True)], names=names)


def edits(plans: DataFrame) -> DataFrame:
    """(conv_id, row, place, edit, role) of the edits of plans: the number of the row that is edited (none if inserted), the place in the result (none if deleted), the new role (none if kept)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                audit = np.frombuffer(batch["audit"][k].as_py().encode(), np.uint8)
                initials = np.frombuffer(batch["initials"][k].as_py().encode() + b"-", np.uint8)
                inserted, gone = audit == ord("I"), audit == ord("D")
                place = np.cumsum(~gone) - 1
                new = inserted | (audit == ord("R"))
                role = np.where(initials[place] == ord("u"), ROLES["u"], ROLES["a"]).astype(object)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["conv_id"][k].as_py()] * len(audit), batch.schema.field("conv_id").type), pa.array(np.cumsum(~inserted), pa.int64(), mask=inserted), pa.array(place, pa.int64(), mask=gone),
                        pa.array([chr(x) for x in audit], pa.string()), pa.array(role, pa.string(), mask=~new),
                    ],
                    names=["conv_id", "row", "place", "edit", "role"],
                )

    return plans.select("conv_id", "audit", "initials").mapInArrow(run, f"conv_id {plans.schema['conv_id'].dataType.simpleString()}, row long, place long, edit string, role string")


def messages(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, from 0."""
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    old = ordered(rows).where("not dropped").select(F.col("conv_id").alias("old_id"), F.row_number().over(w).alias("n"), F.col("role").alias("old_role"), "text")
    kept = edits(plans).where("edit != 'D'")
    found = kept.join(old, kept["conv_id"].eqNullSafe(old["old_id"]) & (kept["row"] == old["n"]), "left")
    return found.select("conv_id", "place", "edit", F.coalesce("role", "old_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) with faults by a hash of conversation and turn: a fifth of them dropped, emptied, without stops, repeated or from the user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", "".join(STOPS), "")).otherwise(F.col("text"))
    d = d.withColumns({"dropped": F.col("kind") == 0, "text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text", "dropped")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations"))).drop("initials")

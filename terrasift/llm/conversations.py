"""Conversation repair: generalised LR parsing of role sequences with weighted edits, over a graph-structured stack."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bound_batches

#: Costs of the edits; a truncated row that stays costs MEND more.
KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}

# The role grammar, T -> (nothing) | B | s B and B -> u a | B u a, as LR states. State 0 has read nothing, 1 the system row, 2 the
# user of the first pair, 3 and 4 pairs without and with a system row, 6 the user of a later pair.
_SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
_REDUCE = {5: 2, 7: 3}  # rows of the pair rule that ends here: u a, B u a
_GOTO = {0: 3, 1: 4}
_ACCEPT = (0, 3, 4)

Node = tuple  # (LR state, node below)


def shift(node: Node, initial: str) -> Node | None:
    """The stack after one more role, reduced; None if the grammar has no such role here. Nodes below are shared."""
    state = _SHIFT.get((node[0], initial))
    if state is None:
        return None
    node = (state, node)
    if state in _REDUCE:
        for _ in range(_REDUCE[state]):
            node = node[1]
        node = (_GOTO[node[0]], node)
    return node


class Parse:
    """All stack tops after some rows of a conversation, one for each LR state: that of the least (cost, audit).

    A top holds its cost, its audit behind `done` (what all tops begin with), its stack, the hash of the rows
    that it keeps and whether it keeps any. Audits of one state and cost are never the beginning of each other, as the longer one
    would have inserts more, so the least one stays the least whatever follows.
    """

    def __init__(self, empty: Node = (0, None)):
        self.tops = {0: (0, "", empty, hashlib.sha256(), False)}
        self.done: list[str] = []
        self.rows = 0
        self.insert()

    @staticmethod
    def _offer(best: dict, cost: int, audit: str, node: Node, top: tuple, row: tuple | None) -> bool:
        known = best.get(node[0])
        if known is not None and (known[0], known[1]) <= (cost, audit):
            return False
        best[node[0]] = (cost, audit, node, top, row)
        return True

    @staticmethod
    def _hashed(found: tuple) -> tuple:
        cost, audit, node, top, row = found
        digest, begun = top[3], top[4]
        if row is not None:
            digest = digest.copy()
            digest.update((("\n" if begun else "") + f"{row[0]}:{row[1]}").encode())
            begun = True
        return cost, audit, node, digest, begun

    def insert(self) -> None:
        """Add the tops that inserted rows reach."""
        work = list(self.tops)
        while work:
            top = self.tops[work.pop()]
            for initial, role in ROLES.items():
                node, best = shift(top[2], initial), {}
                if node is not None:
                    known = self.tops.get(node[0])
                    if (known is None or (top[0] + INSERT, top[1] + "I") < known[:2]) and self._offer(best, top[0] + INSERT, top[1] + "I", node, top, (role, "")):
                        self.tops[node[0]] = self._hashed(best[node[0]])
                        work.append(node[0])

    def read(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """Take the next row: delete, keep or rerole it on every top, then insert."""
        best: dict = {}
        mend = MEND if truncated else 0
        for top in self.tops.values():
            cost, audit, stack = top[:3]
            self._offer(best, cost + DELETE, audit + "D", stack, top, None)
            if must_go:
                continue
            node = shift(stack, role[:1])
            if node is not None:
                self._offer(best, cost + KEEP + mend, audit + "K", node, top, (role, text))
            for initial, name in ROLES.items():
                node = shift(stack, initial)
                if node is not None:
                    self._offer(best, cost + REROLE + mend, audit + "R", node, top, (name, text))
        self.tops = {state: self._hashed(found) for state, found in best.items()}
        self.insert()
        self.rows += 1
        if self.rows % 64 == 0:
            same = len(os.path.commonprefix([top[1] for top in self.tops.values()]))
            if same:
                self.done.append(next(iter(self.tops.values()))[1][:same])
                self.tops = {state: (top[0], top[1][same:], *top[2:]) for state, top in self.tops.items()}

    def result(self) -> tuple[int, str, bool, str]:
        """(cost, audit, begins with a system row, SHA-256 of the kept rows) of the cheapest full parse."""
        cost, audit, node, digest, _ = min((self.tops[s] for s in _ACCEPT if s in self.tops), key=lambda t: t[:2])
        return cost, "".join(self.done) + audit, node[0] == 4, digest.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by crc32(`conv_id:turn`) % 20.

    0 drops the row, 1 empties its text, 2 removes [.!?] from it, 3 repeats it, 4 sets its role to user. Null roles and texts
    are one space, and null numbers are one space in the hashed key, though they stay null in the result.
    """
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hurt = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("_kind")).where("_kind <> 0")
    kind = F.col("_kind")
    return hurt.select(
        "conv_id", "turn", F.when(kind == 4, ROLES["u"]).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def all_ids(rows: DataFrame) -> DataFrame:
    """The different conv_id of a table."""
    return rows.select("conv_id").distinct()


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with seen: whether the conversation holds the same role and text earlier. Order is turn (nulls first), then role and text."""
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    return rows.withColumn("seen", F.row_number().over(same) > 1)


_LAST = r"[.!?][\x20\x09-\x0D]*\z"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    def __init__(self) -> None:
        self.parse, self.blank, self.duplicate, self.truncated, self.illegal, self.turns = Parse(), 0, 0, 0, 0, 0
        self.low = self.high = self.before = None

    def read(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.before is not None:
            self.illegal += self.before + role[:1] not in _LEGAL
        self.before = role[:1]
        self.parse.read(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        cost, audit, system, digest = self.parse.result()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, system, digest


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The cheapest edits that make every conversation's roles read `(s?(ua)+)?` by their initials.

    rows has conv_id, turn, role and text (role and text not null, see damage); ids adds conversations that may have no row left. A row's
    first fault counts: blank (no character but white space), duplicate (role and text seen earlier), truncated (the last such
    character is not one of .!?). Blank and duplicate rows must go; a truncated row that stays costs MEND. One row per
    conv_id: gaps (turns missing between the least and the greatest), blank, duplicate, truncated, illegal (neighbours
    whose initials are not su, ua or au), cost, audit (initials of the edits in order: Delete, Insert, Keep, Rerole;
    the least of the cheapest), with_system (the repaired rows begin with a system row) and repaired_sha256 (of the kept
    and inserted rows, `role:text` joined by newlines). No rows give zeros, no audit and the hash of nothing. A null conv_id is a
    conversation of its own, rows of one turn go by role and text, null turns come first, repeated rows are duplicates,
    a role that begins otherwise, or is empty, never fits; other columns don't matter.

    Conversations stream through their task in order: it holds at most six stack tops and their audits (a byte a row), never the
    rows. A hash over one conversation's text can only be made in order, so one conversation is one task's work.
    """
    flagged = ordered(rows.select("conv_id", "turn", "role", "text"))
    word = F.col("text").rlike(WORD)
    flagged = flagged.select(
        "conv_id", "turn", "role", "text", (~word).alias("blank"), (word & F.col("seen")).alias("duplicate"),
        (word & ~F.col("seen") & ~F.col("text").rlike(_LAST)).alias("truncated"))
    if ids is not None:
        # a row without a role only names its conversation
        flagged = flagged.unionByName(ids.select("conv_id"), allowMissingColumns=True)
    bound_batches(rows.sparkSession)
    streamed = flagged.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "duplicate")
    kind = dict(rows.dtypes)["conv_id"]
    key_type = streamed.select("conv_id").limit(0).toArrow().schema.field(0).type
    types = [key_type] + [pa.int64()] * 6 + [pa.string(), pa.bool_(), pa.string()]
    names = ["conv_id", *_COUNTS, "audit", "with_system", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, current = None, None
        for batch in batches:
            out = []
            for conv, turn, role, text, blank, duplicate, truncated in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or conv != key:
                    if current is not None:
                        out.append((key, *current.result()))
                    key, current = conv, _Conversation()
                if role is not None:
                    current.read(turn, role, text, blank, duplicate, truncated)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((key, *current.result()), types)], names)

    schema = f"conv_id {kind}, " + ", ".join(f"{n} long" for n in _COUNTS) + ", audit string, with_system boolean, repaired_sha256 string"
    return streamed.mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows that repair keeps and inserts, place counting from 0.

    rows are those that repair read, repaired its result. The audit's letters are numbered and meet the rows by number.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").select(F.col("conv_id").alias("_conv"), "role", "text", F.row_number().over(order).alias("_number"))
    edits = repaired.where("audit <> ''").select("conv_id", "with_system", F.posexplode(F.split("audit", "(?!^)")).alias("_at", "edit"))
    upto = Window.partitionBy("conv_id").orderBy("_at")
    edits = edits.withColumn("_row", F.count_if(F.col("edit").isin("D", "K", "R")).over(upto)).withColumn("place", F.count_if(F.col("edit").isin("I", "K", "R")).over(upto) - 1)
    edits = edits.where("edit IN ('I', 'K', 'R')").withColumn("_row", F.when(F.col("edit") != "I", F.col("_row")))
    met = edits.join(numbered, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_row") == F.col("_number")), "left")
    turn = F.when((F.col("place") - F.col("with_system").cast("int")) % 2 == 0, ROLES["u"]).otherwise(ROLES["a"])
    return met.select("conv_id", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(turn).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

"""Repairs the structure of conversations at least cost, turn by turn, whatever their length.

A conversation is in order when the first letters of its roles read ``(s?(ua)+)?``. Its rows may be kept, given the other role, deleted,
and empty turns inserted, each at a cost (``COSTS``); the cheapest edits win, ties the least string of edit letters.

The rows of a conversation come to one task in order and are never held together. A first stream runs backwards over narrow rows (turn,
first letter, faults) and carries four costs, one per state of the pattern; for every row it leaves the best edit of each state in
one byte. These bytes leave the task in chunks of ``CHUNK`` rows, as table rows below spark.checkpoint.dir, so a conversation with a third of
all rows needs no more memory than others. A second stream meets the chunks in front of their rows and walks forwards, with the texts.
The digest of a conversation is that of one text in order, so its rows can't be dealt to several tasks; what is kept of a row is one letter.

Nulls: a null role or text is one space, a null turn comes before all others, null conversation ids are one conversation.
Empty and blank texts are deleted. Very long texts pass through in batches of their own. Ties of a turn are taken by role, then by the MD5 of the text; repeated rows
are duplicates of the first. An empty table gives no row. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.llm.common import ready, stored

#: Edits in ASCII order, and what each costs; a truncated row that stays costs ``TRUNCATED`` more.
EDITS, COSTS, TRUNCATED = "DIKR", {"D": 2, "I": 5, "K": 0, "R": 1}, 5
CHUNK = 1 << 16
BLANKS = " \t\n\x0b\x0c\r"

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
#: The only user or assistant turn that may come next, by state.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: Costs of what has to be inserted at the end, by state.
_AT_END = (0, 10, 5, 0)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, as the crc32 of ``conv_id:turn`` decides; ``present`` is false for rows that were dropped."""
    some = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(some("text"), ".!?", "")).otherwise(some("text"))
    role = F.when(fault == 4, "user").otherwise(some("role"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault != 0).alias("present"), F.explode(copies)).drop("col")


def _step(after: tuple[int, ...], letter: str, must_go: bool, truncated: bool) -> tuple[tuple[int, ...], int]:
    """Costs from a row to the end by state, given those after it, and the best edits of the four states in one byte."""
    more = TRUNCATED if truncated else 0
    ways = []
    for state in range(4):
        way = {"D": COSTS["D"] + after[state]}
        if not must_go:
            kept = _AFTER.get(letter, {}).get(state)
            if kept is not None:
                way["K"] = COSTS["K"] + more + after[kept]
            way["R"] = COSTS["R"] + more + after[_NEXT[state]]
        ways.append(way)
    costs = [min(way.values()) for way in ways]
    for _ in range(3):
        costs = [min(cost, COSTS["I"] + costs[_NEXT[state]]) for state, cost in enumerate(costs)]
    packed = 0
    for state, way in enumerate(ways):
        way["I"] = COSTS["I"] + costs[_NEXT[state]]
        best = min(edit for edit in way if way[edit] == costs[state])
        packed |= EDITS.index(best) << (2 * state)
    return tuple(costs), packed


_SUMMARY = "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_COUNTS = [part.split()[0] for part in _SUMMARY.split(", ")]


class _Backwards:
    """One conversation, last row first: costs, counts, and bytes not yet given out."""

    def __init__(self, conv):
        self.conv, self.costs, self.base = conv, _AT_END, 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.letter, self.turn, self.first_turn, self.last_turn, self.turns = None, None, None, None, 0
        self.bytes, self.at = bytearray(), None

    def row(self, turn, letter, fault, at, memo):
        counts = self.counts
        counts["n_rows"] += 1
        if fault:
            counts[fault] += 1
        if self.letter is not None and letter + self.letter not in ("su", "ua", "au"):
            counts["illegal"] += 1
        self.letter = letter
        if turn is not None and turn != self.turn:
            self.turn, self.first_turn, self.turns = turn, turn, self.turns + 1
            self.last_turn = turn if self.last_turn is None else self.last_turn
        kind = letter, fault in ("blank", "duplicate"), fault == "truncated"
        step = memo.get((self.costs, kind))
        if step is None:
            costs, packed = _step(self.costs, *kind)
            least = min(costs)
            step = memo[self.costs, kind] = tuple(cost - least for cost in costs), least, packed
        self.costs, least, packed = step
        self.base += least
        self.bytes.append(packed)
        self.at = at

    def chunk(self):
        out = {"conv": self.conv, "part": 1, **dict(zip(("turn", "role", "tie"), self.at)), "n_left": self.counts["n_rows"], "edits": bytes(reversed(self.bytes))}
        self.bytes = bytearray()
        return out

    def end(self):
        if self.turns:
            self.counts["gaps"] = self.last_turn - self.first_turn + 1 - self.turns
        self.counts["cost"] = self.base + self.costs[_START]
        return ([self.chunk()] if self.bytes else []) + [{"conv": self.conv, "part": 0, **self.counts}]


def _plan_edits(batches: Iterator[pa.RecordBatch], schema: pa.Schema, chunk: int) -> Iterator[pa.RecordBatch]:
    now, memo, out = None, {}, []
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv", "turn", "role", "tie", "fault", "present")]
        for conv, turn, role, tie, fault, present in zip(*columns):
            if now is None or conv != now.conv:
                if now is not None:
                    out += now.end()
                now = _Backwards(conv)
            if present:
                now.row(turn, role[:1], fault, (turn, role, tie), memo)
                if len(now.bytes) == chunk:
                    out.append(now.chunk())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist(now.end(), schema)


class _Forwards:
    """One conversation, first row first: the state of the pattern, and the chunks of edits that are not used up."""

    def __init__(self, conv, counts):
        self.conv, self.counts, self.left = conv, counts, counts["n_rows"]
        self.state, self.chunks, self.audit, self.place = _START, deque(), bytearray(), 0
        self.hash, self.turns = hashlib.sha256(), 0

    def _say(self, edit, role=None, text=""):
        self.audit += edit
        if role is None:
            return None
        self.hash.update(f"{chr(10) if self.turns else ''}{role}:{text}".encode())
        self.turns += 1
        return {"conv": self.conv, "place": self.turns, "edit": edit.decode(), "role": role, "text": text}

    def _insert(self):
        self.state = _NEXT[self.state]
        return self._say(b"I", _ROLE[self.state])

    def row(self, role, text):
        """The turns that take the place of a row."""
        while self.left <= self.chunks[0][0] - len(self.chunks[0][1]):
            self.chunks.popleft()
        top, edits = self.chunks[0]
        packed = edits[top - self.left]
        self.left -= 1
        while (edit := packed >> (2 * self.state) & 3) == 1:
            yield self._insert()
        if edit == 0:
            self._say(b"D")
        elif edit == 2:
            self.state = _AFTER[role[:1]][self.state]
            yield self._say(b"K", role, text)
        else:
            self.state = _NEXT[self.state]
            yield self._say(b"R", _ROLE[self.state], text)

    def end(self):
        while self.state in (_SYSTEM, _USER):
            yield self._insert()

    def digest(self):
        return {"conv": self.conv, **self.counts, "audit": self.audit.decode(), "repaired_sha256": self.hash.hexdigest()}


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema, turns: bool) -> Iterator[pa.RecordBatch]:
    now, out = None, []

    def finish():
        made = list(now.end())
        out.extend(made if turns else [now.digest()])

    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(name).to_pylist() for name in ("conv", "part", "is_row", "n_left", "edits", "role", "text")]
        for index, (conv, part, is_row, n_left, edits, role, text) in enumerate(zip(*columns)):
            if part == 0:
                if now is not None:
                    finish()
                now = _Forwards(conv, {name: batch.column(names.index(name))[index].as_py() for name in _COUNTS})
            elif not is_row:
                now.chunks.append((n_left, edits))
            elif turns:
                out.extend(now.row(role, text))
            else:
                for _ in now.row(role, text):
                    pass
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if now is not None:
        finish()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _repair(rows: DataFrame, turns: bool, present: Column | None, chunk: int) -> DataFrame:
    spark = ready(rows.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    plain = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), there.alias("present"))

    ended = F.rtrim("text", F.lit(BLANKS))
    narrow = plain.select(
        "conv", "turn", "role", F.md5("text").alias("tie"), "present",
        F.when(ended == "", "blank").when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "truncated").alias("own"),
    ).repartition(parts, "conv")
    nth = F.row_number().over(Window.partitionBy("conv", "present", "role", "tie").orderBy(F.col("turn").asc_nulls_first()))
    faulty = narrow.withColumn("nth", nth).withColumn("fault", F.when((F.col("own") == "blank") | (F.col("nth") == 1), F.col("own")).otherwise("duplicate"))
    backwards = faulty.sortWithinPartitions("conv", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("tie"), F.desc("nth"))
    conv = rows.schema["conv_id"].dataType
    plan = f"conv {conv.simpleString()}, part int, turn long, role string, tie string, n_left long, edits binary, {_SUMMARY}"
    plan_arrow = _arrow(spark, plan)
    edits = stored(backwards.drop("own", "nth").mapInArrow(lambda batches: _plan_edits(batches, plan_arrow, chunk), plan), "edits")

    texts = plain.where("present").select("conv", F.lit(1).alias("part"), "turn", "role", F.md5("text").alias("tie"), "text", F.lit(True).alias("is_row"))
    mixed = edits.withColumn("is_row", F.lit(False)).unionByName(texts, allowMissingColumns=True).repartition(parts, "conv")
    forwards = mixed.sortWithinPartitions("conv", "part", F.col("turn").asc_nulls_first(), F.asc("role"), F.asc("tie"), F.asc("is_row"), F.desc("n_left"))
    if turns:
        out = f"conv {conv.simpleString()}, place long, edit string, role string, text string"
    else:
        out = f"conv {conv.simpleString()}, {_SUMMARY}, audit string, repaired_sha256 string"
    out_arrow = _arrow(spark, out)
    return forwards.mapInArrow(lambda batches: _walk(batches, out_arrow, turns), out).withColumnRenamed("conv", "conv_id")


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repaired_turns(rows: DataFrame, *, present: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """The turns of repaired conversations: ``conv_id, place`` (from 1), ``edit`` (K, R or I), ``role, text``; deleted rows have none."""
    return _repair(rows, True, present, chunk)


def repair_digests(rows: DataFrame, *, present: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: counts of its faults, ``cost``, ``audit`` (an edit letter per row and insertion) and the digest of its repaired text.

    ``gaps`` counts missing turn numbers, ``illegal`` neighbours whose first letters are not su, ua or au. Rows without ``present``
    only name their conversation. A row whose role is the empty text has no first letter and can't be kept.
    """
    return _repair(rows, False, present, chunk)

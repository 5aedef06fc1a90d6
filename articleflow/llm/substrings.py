"""Removes words of passages that were said before, by suffix automata of reference shards and matching statistics.

A word goes when it is in a window of ``threshold`` words whose sequence also starts earlier: in a document of smaller id, or further in front in its own.
All that counts is which windows meet, so text is sharded by content: a window belongs to the least-hashed run of
``threshold // 2`` words in it, and consecutive windows of one run are a passage. Equal windows are then in passages of equal runs, in one shard, wherever they
stand. Passages of runs seen once are done. Of equal passages the first stands for all, so that a text with many copies is one passage. Each shard (about ``SHARD`` words)
streams its passages in corpus order through its suffix automaton: the longest match against all that came before, word by word, gives the matching statistics, and
then the word is added. Where the statistic reaches the threshold, the window ending there is a repeat; overlapping windows add up to maximal spans.

Automata take about 60 bytes a word and are not sent about: the passages of a shard come to the task that holds its automaton. Sending the automata of all shards to all
documents would stream the whole corpus once per shard. A run in more than ``HOT`` different passages (a phrase in ever new surroundings) is cut
into single windows, which are dealt out by their own content, so that no shard outgrows the others and none is dropped.

Words are compared by 64-bit hashes, passages by two of them. Nulls: a null text has no words; null ids count as the smallest. Empty and blank texts have no words,
texts below the threshold lose none; very long ones are worked on in pieces. Ties: rows that share an id come in the order of a hash of id and text; rows that are repeated
outright are one document, each with the same result. An empty table gives no row. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from articleflow.llm.common import discard, ready, slices, stored, texts_of, utf8
from articleflow.llm.words import PIECE, find_words, mixed, powers, windows

SHARD = 40_000
HOT = 2000
_VALUES = np.random.default_rng(20250117).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _run_length(threshold: int) -> int:
    """Words of a run; passages have at most 61 windows, so that a long has a bit for each."""
    return max(1, threshold // 2, threshold - 60)


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, as they are written."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, side="right")))
        base = start[at]
        piece = raw[base : end[to - 1]]
        up, down = powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUES[piece] * up[:-1], out=sums[1:])
        first, last = start[at:to] - base, end[at:to] - base
        out[at:to] = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        at = to
    return out


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    raw, bounds = utf8(texts_of(batch))
    _, start, end, firsts = find_words(raw, bounds)
    return raw, bounds, start, end, firsts, _hashes(raw, start, end)


def _cut(hashes: np.ndarray, firsts: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Passages: first word in the batch, number of windows, hash of the run, hash of all words, row of the batch."""
    run = _run_length(threshold)
    count = len(hashes) - threshold + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    runs = windows(hashes, run)
    text = np.searchsorted(firsts, np.arange(count), side="right") - 1
    inside = np.flatnonzero(np.arange(count) + threshold <= firsts[text + 1])
    least = np.arange(count) + np.lib.stride_tricks.sliding_window_view(runs, threshold - run + 1).argmin(axis=1)
    place = least[inside]
    fresh = np.ones(len(inside), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)
    begin = np.flatnonzero(fresh)
    first = inside[begin]
    n = np.diff(np.append(begin, len(inside)))
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    whole = mixed((sums[first + n + threshold - 1] - sums[first]) * down[first] + n.astype(np.uint64))
    return first, n, runs[place[begin]], whole, text[first]


_PASSAGE = "who struct<doc_id {id}, row long>, start int, n int, run long, whole long"


def _passages(docs: DataFrame, threshold: int, single: bool = False) -> DataFrame:
    """The passages of all documents; ``single`` adds the hash of each window."""
    ddl = _PASSAGE.format(id=docs.schema["who"].dataType["doc_id"].dataType.simpleString()) + (", alone array<bigint>" if single else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, _, _, _, firsts, hashes = _words(part)
                first, n, run, whole, text = _cut(hashes, firsts, threshold)
                who = part.column("who").take(pa.array(text))
                columns = [who, (first - firsts[text]).astype(np.int32), n.astype(np.int32), run.view(np.int64), whole.view(np.int64)]
                names = ["who", "start", "n", "run", "whole"]
                if single:
                    own = windows(hashes, threshold).view(np.int64)
                    spots = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(own[spots])))
                    names.append("alone")
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return docs.mapInArrow(cut, ddl)


class _Automaton:
    """A suffix automaton that grows word by word, over many passages."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [0], [0]

    def _copy(self, state: int, before: int, word: int) -> int:
        """A state for the shorter strings of ``state``, from ``before`` on."""
        clone = len(self.next)
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(self.length[before] + 1)
        self.link[state] = clone
        while True:
            ways = self.next[before]
            if ways.get(word) != state:
                return clone
            ways[word] = clone
            if not before:
                return clone
            before = self.link[before]

    def add(self, last: int, word: int) -> int:
        """The state of the passage so far (``last``) with one more word."""
        nexts, link, length = self.next, self.link, self.length
        found = nexts[last].get(word)
        if found is not None:
            return found if length[found] == length[last] + 1 else self._copy(found, last, word)
        state = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        before = last
        while word not in nexts[before]:
            nexts[before][word] = state
            if not before:
                return state
            before = link[before]
        found = nexts[before][word]
        link[state] = found if length[found] == length[before] + 1 else self._copy(found, before, word)
        return state

    def stream(self, words: list[int], threshold: int) -> int:
        """Bits of the windows of a passage that came before; the passage is added on the way."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = last = bits = 0
        for place, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            follow = nexts[state].get(word)
            if follow is not None:
                state, matched = follow, matched + 1
                if matched >= threshold:
                    bits |= 1 << (place - threshold + 1)
            last = self.add(last, word)
            while state and matched <= length[link[state]]:
                state = link[state]
        return bits


def _shard(passages: pa.Table, threshold: int) -> pa.Table:
    """The passages of a shard with the bits of their windows that came before."""
    order = pc.sort_indices(passages, sort_keys=[("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")], null_placement="at_start")
    passages = passages.take(order)
    automaton, bits = _Automaton(), []
    for words in passages.column("words"):
        bits.append(automaton.stream(np.frombuffer(words.as_buffer(), np.int64).tolist(), threshold))
    return passages.select(["run", "whole", "n", "first"]).append_column("bits", pa.array(bits, pa.int64()))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.lit("/"), F.col(text_col)).alias("row")).alias("who"), F.col(text_col).alias("text")
    )


def _distinct(passages: DataFrame) -> DataFrame:
    """Different passages, where each comes first, and how often."""
    return passages.groupBy("run", "whole", "n").agg(F.count("*").alias("copies"), F.min(F.struct("who", "start")).alias("first"))


def _repeats(docs: DataFrame, threshold: int, hot: int, shard: int) -> DataFrame:
    """``who, start, bits``: passages with windows that came before."""
    passages = _passages(docs, threshold)
    same_run = Window.partitionBy("run")
    seen = _distinct(passages).withColumn("of_run", F.sum("copies").over(same_run)).withColumn("forms", F.count("*").over(same_run))
    known = stored(seen.where("of_run > 1").drop("of_run", "copies"), "passages")
    many = known.where(F.col("forms") > hot).select("run").distinct()
    if not many.isEmpty():
        # Runs with ever new surroundings: their windows stand alone, each with its own content as its run.
        many = stored(many, "hot-runs")
        alone = _passages(docs, threshold, single=True).join(many, "run").select(
            "who", F.col("start").alias("_at"), F.posexplode("alone").alias("pos", "run")
        ).select("who", (F.col("_at") + F.col("pos")).alias("start"), F.lit(1).alias("n"), "run", F.col("run").alias("whole"))
        passages = passages.join(many, "run", "left_anti").unionByName(alone)
        known = known.where(F.col("forms") <= hot).drop("forms").unionByName(_distinct(alone).where("copies > 1").drop("copies"))
        known = stored(known, "passages")
    total = known.agg(F.sum(F.col("n") + threshold - 1)).first()[0] or 0
    shards = max(1, -(-total // shard))

    wanted = known.groupBy(F.col("first.who").alias("who")).agg(F.collect_list(F.struct(F.col("first.start").alias("start"), "n", "run", "whole")).alias("parts"))
    sources = docs.groupBy("who").agg(F.first("text").alias("text")).join(wanted, "who")
    id_type = docs.schema["who"].dataType["doc_id"].dataType.simpleString()
    first = f"first struct<who struct<doc_id {id_type}, row long>, start int>"
    ddl = f"shard long, doc_id {id_type}, row long, start int, run long, whole long, n int, {first}, words binary"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, _, _, _, firsts, hashes = _words(part)
                lists = part.column("parts")
                flat = lists.flatten()
                text = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                start, n, run = (flat.field(name).to_numpy() for name in ("start", "n", "run"))
                begin = firsts[text] + start
                own = hashes.view(np.int64)
                words = pa.array([own[b : b + w + threshold - 1].tobytes() for b, w in zip(begin, n)], pa.binary())
                who = part.column("who").take(pa.array(text))
                place = pa.StructArray.from_arrays([who, flat.field("start")], names=["who", "start"])
                key = pa.array((mixed(run.view(np.uint64)) % np.uint64(shards)).astype(np.int64))
                columns = [key, *who.flatten(), flat.field("start"), flat.field("run"), flat.field("whole"), flat.field("n"), place, words]
                yield pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(columns, arrow.types)], schema=arrow)

    spelled = sources.mapInArrow(spell, ddl)
    judged = spelled.groupBy("shard").applyInArrow(lambda rows: _shard(rows, threshold), f"run long, whole long, n int, {first}, bits long")
    judged = stored(judged, "judged")
    all_of = F.expr("shiftleft(1L, n) - 1")
    found = passages.join(judged, ["run", "whole", "n"]).select(
        "who", "start", F.when((F.col("first.who") == F.col("who")) & (F.col("first.start") == F.col("start")), F.col("bits")).otherwise(all_of).alias("bits")
    )
    repeats = stored(found.where("bits <> 0"), "repeats")
    discard(known, judged)
    return repeats


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 20, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """``id, n_words, removed`` (spans of words, end exclusive) and ``kept`` (the other words, joined by one space) of every row."""
    ready(docs.sparkSession)
    texts = _numbered(docs, id_col, text_col)
    spans = _repeats(texts, threshold, hot, shard).groupBy("who").agg(F.collect_list(F.struct("start", "bits")).alias("parts"))
    marked = texts.join(spans, "who", "left").select(F.col("who.doc_id").alias("id"), "text", F.col("parts.start").alias("starts"), F.col("parts.bits").alias("bits"))
    ddl = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, removed array<struct<start bigint, end bigint>>, kept string"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _without(part, threshold, arrow)

    return marked.mapInArrow(cut, ddl)


def _without(batch: pa.RecordBatch, threshold: int, arrow: pa.Schema) -> pa.RecordBatch:
    raw, bounds, start, end, firsts, _ = _words(batch)
    lists = batch.column("starts")
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(batch.num_rows), counts)
    begin = firsts[text] + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    bits = batch.column("bits").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    depth = np.zeros(len(start) + 1, np.int32)
    for bit in range(threshold - _run_length(threshold) + 1):
        some = begin[(bits >> bit) & 1 == 1] + bit
        np.add.at(depth, some, 1)
        np.add.at(depth, some + threshold, -1)
    gone = np.cumsum(depth[:-1]) > 0
    # Runs of removed words, which never go on into the next text.
    of_text = np.searchsorted(firsts, np.arange(len(start)), side="right") - 1
    edge = np.ones(len(start), bool)
    edge[1:] = (gone[1:] != gone[:-1]) | (of_text[1:] != of_text[:-1])
    opens = np.flatnonzero(edge)
    closes = np.append(opens[1:], len(start))
    opens, closes = opens[gone[opens]], closes[gone[opens]]
    owner = of_text[opens]
    spans = pa.StructArray.from_arrays([pa.array(opens - firsts[owner]), pa.array(closes - firsts[owner])], names=["start", "end"])
    removed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=batch.num_rows))).astype(np.int32)), spans)
    # Bytes of kept words, and one blank after each that has another kept one behind it.
    kept = np.flatnonzero(~gone)
    level = np.zeros(len(raw) + 1, np.int8)
    level[start[kept]] += 1
    level[end[kept]] -= 1
    stays = np.cumsum(level[:-1]) > 0
    followed = kept[:-1][of_text[kept[1:]] == of_text[kept[:-1]]] if len(kept) else kept
    data = raw.copy()
    data[end[followed]] = 32
    stays[end[followed]] = True
    offsets = np.append(0, np.cumsum(stays))[bounds].astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[stays].tobytes()))
    columns = [batch.column("id"), pa.array(np.diff(firsts)), removed, texts]
    return pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(columns, arrow.types)], schema=arrow)

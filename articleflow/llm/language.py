"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class in its context times its own within the class. Frequent tokens are classes of their own, the
others are told apart by how they end; within such a class, smoothed counts over the training texts decide. Class weights belong to hashed features of
the context: the token before, the two before, the one before that (a skip), and how both end. They are trained in rounds, each over another
part of the training texts: tasks take gradient steps in numpy batches from the weights so far, and the weights of each feature are averaged by how
often a task has met it. All training texts take part, once. Averages are summed in blocks of features while rows stream, so neither a
task nor the driver holds more than one model; its size is a parameter.

Token counts come from all training texts, summed in tasks first. For scoring, texts are dealt into blocks of a bounded number of tokens, and each
block gets the counts of its own distinct tokens only.

Defined results: null is the empty text, which is one end; a null id is in fold 0, held out; without training texts all counts are 0 and classes
equally likely; rows that repeat an id are scored one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.llm.common import discard, slices, stored, texts_of, utf8
from articleflow.llm.words import distinct, find_words, mixed

#: What counts as the tokens before a text, and as its end.
START, END = np.uint64(0x5EED0000000000A1), np.uint64(0x5EED0000000000B2)
#: Distinct tokens a task counts before it passes them on.
HELD_TOKENS = 1 << 21
#: Distinct tokens of new texts that wait, at least, before they meet those held.
LEAST_MERGED = 1 << 18
#: Rows of a batch whose logits are worked out together, so that they stay near the processor.
NEAR_ROWS = 512
SMOOTHING = 0.1
FEATURES = 4
#: A feature that a batch meets no more often than this has its gradients added together with those of the others.
RARE = 12


@dataclass(frozen=True)
class Shape:
    """Sizes of a model."""

    buckets: int = 1 << 15
    frequent: int = 39
    endings: int = 24
    rounds: int = 4
    block_rows: int = 512
    batch: int = 4096
    rate: float = 0.5
    block_tokens: int = 3_000_000

    @property
    def classes(self) -> int:
        """The end, the frequent tokens and the endings."""
        return 1 + self.frequent + self.endings


def token_stream(texts: pa.Array, endings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts, each text with its end; how each token ends; where each text begins and ends."""
    raw, bounds = utf8(texts)
    hashes, _, end, firsts = find_words(raw, bounds)
    places = firsts + np.arange(len(firsts))
    at = np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), np.diff(firsts))
    tokens, kinds = np.full(places[-1], END), np.zeros(places[-1], np.int64)
    tokens[at] = hashes
    last = raw[end - 1].astype(np.uint64) if len(end) else np.zeros(0, np.uint64)
    last = np.where((last >= 65) & (last < 91), last + np.uint64(32), last)
    kinds[at] = (mixed(last) % np.uint64(endings)).astype(np.int64)
    return tokens, kinds, places


def token_counts(docs: DataFrame, text_col: str, shape: Shape) -> DataFrame:
    """(token, kind, c) over all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = _merged([]), []
        for batch in batches:
            for part in slices(batch):
                tokens, kinds, _ = token_stream(texts_of(part), shape.endings)
                waiting.append(_merged([(tokens, kinds, np.ones(len(tokens), np.int64))]))
                if sum(len(x[0]) for x in waiting) < max(len(held[0]), LEAST_MERGED):
                    continue  # what is held is gone through again only when as much is new
                held, waiting = _merged([held, *waiting]), []
                if len(held[0]) > HELD_TOKENS:
                    yield _counted(held)
                    held = _merged([])
        yield _counted(_merged([held, *waiting]))

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token long, kind int, c long")
    return parts.groupBy("token").agg(F.min("kind").alias("kind"), F.sum("c").alias("c"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, how they end and their counts, with each token once."""
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens, kinds, counts = map(np.concatenate, zip(empty, *parts, strict=True))
    values, first, which = distinct(tokens)
    return values, kinds[first], np.bincount(which, counts, len(values)).astype(np.int64)


def _counted(held: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    token, kind, count = held
    return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(kind, pa.int32()), pa.array(count)], ["token", "kind", "c"])


@dataclass(frozen=True)
class Model:
    shape: Shape
    tokens: int
    distinct: int
    #: Frequent tokens in ascending order; token i is class i + 1.
    frequent: np.ndarray
    #: For each ending, tokens and distinct tokens that are not frequent.
    ending_tokens: np.ndarray
    ending_distinct: np.ndarray
    bias: np.ndarray
    weights: np.ndarray = field(repr=False)

    def classes(self, tokens: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        out = kinds + 1 + self.shape.frequent
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == tokens, at + 1, out)
        return np.where(tokens == END, 0, out)

    def features(self, tokens: np.ndarray, kinds: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Hashed features of the context of each token, of shape (tokens, FEATURES)."""
        if not len(tokens):
            return np.zeros((0, FEATURES), np.int64)
        one, two = np.roll(tokens, 1), np.roll(tokens, 2)
        kind = np.roll(kinds, 1) * self.shape.endings + np.roll(kinds, 2)
        starts = places[:-1]
        one[starts] = two[starts] = START
        kind[starts] = -1
        second = starts[np.diff(places) > 1] + 1
        two[second] = START
        kind[second] = -2 - np.roll(kinds, 1)[second]
        salted = [one, mixed(two) + one * np.uint64(3), two ^ np.uint64(0xABCDEF12345), kind.astype(np.uint64) ^ np.uint64(0x777700001111)]
        return np.stack([(mixed(s) % np.uint64(self.shape.buckets)).astype(np.int64) for s in salted], axis=1)

    def room(self, tables: int) -> np.ndarray:
        """Work tables for a batch, used again for each one: new arrays of this size cost more than what is done in them."""
        return np.empty((tables, self.shape.batch, self.shape.classes), np.float32)

    def softmax(self, weights: np.ndarray, features: np.ndarray, room: np.ndarray) -> np.ndarray:
        """For each token its logits less the largest of them (in the first work table), their exponentials (in the second), and the sums of these, given back."""
        sums = np.empty(len(features), room.dtype)
        for a in range(0, len(features), NEAR_ROWS):
            rows = features[a : a + NEAR_ROWS]
            logits, powers = room[0, a : a + len(rows)], room[1, a : a + len(rows)]
            np.take(weights, rows[:, 0], axis=0, out=logits, mode="clip")
            logits += self.bias
            for k in range(1, FEATURES):
                np.take(weights, rows[:, k], axis=0, out=powers, mode="clip")
                logits += powers
            logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=powers)
            powers.sum(axis=1, out=sums[a : a + len(rows)])
        return sums

    def log_softmax(self, weights: np.ndarray, features: np.ndarray) -> np.ndarray:
        room = np.empty((2, len(features), self.shape.classes), weights.dtype)
        sums = self.softmax(weights, features, room)
        return room[0] - np.log(sums)[:, None]

    def train(self, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        """Weights after gradient steps over all batches, and how often each feature was met."""
        weights, met, steepness = self.weights.copy(), np.zeros(self.shape.buckets), np.full(self.shape.buckets, 1e-3, np.float32)
        room = self.room(3)
        for batch in batches:
            for part in slices(batch):
                tokens, kinds, places = token_stream(texts_of(part), self.shape.endings)
                features, target = self.features(tokens, kinds, places), self.classes(tokens, kinds)
                for a in range(0, len(tokens), self.shape.batch):
                    rows = features[a : a + self.shape.batch]
                    sums = self.softmax(weights, rows, room)
                    slope = room[1, : len(rows)]
                    slope /= sums[:, None]
                    slope[np.arange(len(rows)), target[a : a + self.shape.batch]] -= 1
                    for k in range(FEATURES):
                        own, times, step = _sums_by(rows[:, k], slope, room[0])
                        steepness[own] += np.einsum("ij,ij->i", step, step) / step.shape[1]
                        step *= (self.shape.rate * 0.25 / np.sqrt(steepness[own]))[:, None]
                        moved = np.take(weights, own, axis=0, out=room[2, : len(own)], mode="clip")
                        moved -= step
                        weights[own] = moved
                        met[own] += times
        return weights, met


def _sums_by(keys: np.ndarray, values: np.ndarray, work: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, how often each occurs and the sum of its rows of ``values``, in a work table.

    Rows of rare keys are added one from each key at a time, those of a frequent key at once.
    """
    order = np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")
    in_order = keys[order]
    first = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
    times = np.diff(np.append(first, len(order)))
    sums = np.take(values, order[first], axis=0, out=work[: len(first)], mode="clip")
    for rank in range(1, min(RARE, int(times.max()))):
        more = np.flatnonzero((times > rank) & (times <= RARE))
        sums[more] += values.take(order[first[more] + rank], axis=0)
    for i in np.flatnonzero(times > RARE).tolist():
        sums[i] = values.take(order[first[i] : first[i] + times[i]], axis=0).sum(axis=0)
    return in_order[first], times, sums


def start_model(counts: DataFrame, shape: Shape) -> Model:
    """A model of the counts alone; ``counts`` is stored. The driver gets ``frequent`` tokens and one row for each ending."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    no_end = counts.filter(F.col("token") != int(END.view(np.int64)))
    frequent = no_end.orderBy(F.desc("c"), "token").limit(shape.frequent).collect()
    tokens, distinct = np.zeros(shape.endings), np.zeros(shape.endings)
    for row in no_end.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens[row["kind"]], distinct[row["kind"]] = row["c"], row["n"]
    for row in frequent:
        tokens[row["kind"]] -= row["c"]
        distinct[row["kind"]] -= 1
    ends = total[0] - sum(r["c"] for r in frequent) - tokens.sum()
    order = np.argsort(np.array([r["token"] for r in frequent], np.int64).view(np.uint64))
    known = np.array([r["token"] for r in frequent], np.int64).view(np.uint64)[order]
    own = np.zeros(shape.frequent)
    own[: len(known)] = np.array([r["c"] for r in frequent], float)[order]
    share = np.log(np.concatenate([[ends], own, tokens]) + 1)
    weights = np.zeros((shape.buckets, shape.classes), np.float32)
    return Model(shape, int(total[0]), int(total[1]), known, tokens, distinct, (share - share.max()).astype(np.float32), weights)


def trained(docs: DataFrame, model: Model, id_col: str, text_col: str) -> Model:
    """The model after rounds of training, each over the texts whose hash falls to it."""
    shape = model.shape
    for turn in range(shape.rounds):
        mine = F.pmod(F.xxhash64(F.lit("round"), id_col), F.lit(shape.rounds)) == turn
        texts = docs.filter(mine).select(F.col(text_col).cast("string").alias("text"))
        rows = texts.mapInArrow(_trainer(model), "block int, met binary, weights binary")
        sums = rows.repartition("block").mapInArrow(_summer(shape), "block int, met binary, weights binary")
        weights = model.weights.copy()
        sums = stored(sums, "weights")
        for row in sums.collect():  # one model in all
            met, total = np.frombuffer(row["met"], "<f8"), np.frombuffer(row["weights"], "<f8").reshape(-1, shape.classes)
            own = slice(row["block"] * shape.block_rows, row["block"] * shape.block_rows + len(met))
            weights[own] = np.where(met[:, None] > 0, total / np.maximum(met, 1)[:, None], weights[own])
        discard(sums)
        model = replace(model, weights=weights)
    return model


def _trainer(model: Model):
    shape = model.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, met = model.train(batches)
        for block in range(-(-shape.buckets // shape.block_rows)):
            own = slice(block * shape.block_rows, (block + 1) * shape.block_rows)
            if met[own].any():
                total = (weights[own] * met[own][:, None]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([met[own].astype("<f8").tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], ["block", "met", "weights"])

    return run


def _summer(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                met, total = np.frombuffer(row["met"], "<f8"), np.frombuffer(row["weights"], "<f4")
                have = sums.setdefault(row["block"], [np.zeros(len(met)), np.zeros(len(total))])
                have[0] += met
                have[1] += total
        for block, (met, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([met.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], ["block", "met", "weights"])

    return run


def score(docs: DataFrame, counts: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row."""
    shape = model.shape
    blocks = max(1, -(-model.tokens // shape.block_tokens)) * 2
    block = F.pmod(F.xxhash64(F.lit("block"), id_col, text_col), F.lit(blocks)).cast("int")
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), block.alias("block")).repartition(blocks, "block")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            own = batch.column("block").to_numpy()
            for number in np.unique(own).tolist():
                for part in slices(batch.filter(pa.array(own == number))):
                    tokens = pd.unique(token_stream(texts_of(part), shape.endings)[0])
                    have = held.setdefault(number, [tokens[:0]])
                    have.append(tokens)
                    if sum(map(len, have[1:])) >= max(len(have[0]), LEAST_MERGED):
                        held[number] = [pd.unique(np.concatenate(have))]
        for number, parts in held.items():
            tokens = pd.unique(np.concatenate(parts))
            for a in range(0, len(tokens), 100_000):
                piece = tokens[a : a + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), number), pa.int32()), pa.array(piece)], ["block", "token"])

    wanted = dealt.select("block", "text").mapInArrow(distinct, "block int, token long")
    known = wanted.join(counts.select("token", "c"), "token")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")] + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")])

    def run(texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
        token, c = vocabulary["token"].to_numpy().view(np.uint64), vocabulary["c"].to_numpy()
        order = np.argsort(token)
        token, c = token[order], c[order]
        out = [_score_part(model, part, token, c) for batch in texts.to_batches() for part in slices(batch)]
        return pa.concat_tables([pa.Table.from_batches([b]) for b in out]) if out else schema_table(texts)

    def schema_table(texts: pa.Table) -> pa.Table:
        return pa.table([texts["id"], *(pa.nulls(0, pa.int64()),) * 2, *(pa.nulls(0, pa.float64()),) * 2], schema.names)

    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)


def _score_part(model: Model, part: pa.RecordBatch, token: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    shape = model.shape
    tokens, kinds, places = token_stream(texts_of(part), shape.endings)
    count = np.zeros(len(tokens))
    if len(token):
        values, _, which = distinct(tokens)
        at = np.minimum(np.searchsorted(token, values), len(token) - 1)
        count = np.where(token[at] == values, c[at], 0).astype(float)[which]
    base = np.log10(count + SMOOTHING) - np.log10(model.tokens + SMOOTHING * (model.distinct + 1))
    target, features = model.classes(tokens, kinds), model.features(tokens, kinds, places)
    chosen, room = np.zeros(len(tokens)), model.room(2)
    for a in range(0, len(tokens), shape.batch):
        rows = features[a : a + shape.batch]
        totals = model.softmax(model.weights, rows, room)
        chosen[a : a + shape.batch] = room[0, np.arange(len(rows)), target[a : a + shape.batch]] - np.log(totals)
    within = np.log10((count + SMOOTHING) / (model.ending_tokens[kinds] + SMOOTHING * (model.ending_distinct[kinds] + 1)))
    total = chosen / np.log(10) + np.where(target > shape.frequent, within, 0.0)
    starts = places[:-1]
    sums = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, total)]
    return pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(places)), *map(pa.array, sums)], ["id", "n_tokens", "n_known", "base_score", "score"])


def language_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score): one row per document, by a model of the rows for which ``learn`` holds."""
    lessons = docs.filter(learn)
    counts = stored(token_counts(lessons, text_col, shape), "token-counts")
    model = trained(lessons, start_model(counts, shape), id_col, text_col)
    return score(docs, counts, model, id_col, text_col).select("id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")

"""A factorisation machine that scores the quality of texts.

Features are hashed words (each once per text, scaled by their number), statistics of the text's structure in bins, and numeric
metadata in bins. Every pair of features interacts through low-rank factors; the sum over pairs is half of (square of sums minus sum of
squares) per factor, so a score takes time linear in the features. The model is fitted on a bounded sample of labelled rows, the first
``sample_rows`` in the order of a hash of their ids; all texts are scored, whole.

Defined results: null is the empty text and is scored like any other; without usable labels all scores are 0.5, with one class only they
lean to that class; a null id is in fold 0; repeated labels of an id count once, as the largest; repeated
documents are scored one by one; labels that are null are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.llm.common import slices, texts_of, utf8
from articleflow.llm.words import find_words, windows

WORD_BUCKETS = 1 << 14
BINS = 16
#: Number of structure statistics, see ``structure``.
STATISTICS = 14
WINDOW = 5


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode("latin-1"))] = True
    return table


BYTE_CLASSES = (
    _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _table("abcdefghijklmnopqrstuvwxyz"),
    _table("0123456789"),
    _table(".,;:'\"-()"),
    _table("!?"),
    _table("#$%&*+/<=>@[\\]^_`{|}~"),
    _table("\n"),
)


def structure(raw: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Statistics of each text, in 0..1."""
    sizes, words = np.diff(bounds), np.diff(firsts)
    size, count = np.maximum(sizes, 1), np.maximum(words, 1)
    out = []
    for table in BYTE_CLASSES:
        sums = np.concatenate([[0], np.cumsum(table[raw])])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]) / size)
    newlines = out.pop()
    lengths = np.concatenate([[0], np.cumsum(end - start)])
    out.append((lengths[firsts[1:]] - lengths[firsts[:-1]]) / count / 20)
    out.append(np.log2(sizes + 1) / 18)
    out.append(np.log2(words + 1) / 15)
    out.append(np.log2(sizes / (newlines * size + 1) + 1) / 14)
    last = raw[end - 1] if len(end) else raw
    marked = np.concatenate([[0], np.cumsum(BYTE_CLASSES[4][last] | BYTE_CLASSES[5][last])])
    out.append((marked[firsts[1:]] - marked[firsts[:-1]]) / count)
    grams = windows(hashes, WINDOW)
    distinct, repeats, most = np.ones(len(sizes)), np.ones(len(sizes)), np.zeros(len(sizes))
    for i, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
        if b > a:
            times = np.unique(hashes[a:b], return_counts=True)[1]
            distinct[i], most[i] = len(times) / (b - a), times.max() / (b - a)
        if b - a > WINDOW:
            repeats[i] = len(np.unique(grams[a : b - WINDOW + 1])) / (b - a - WINDOW + 1)
    return np.clip(np.stack([*out, distinct, repeats, most], axis=1), 0, 1)


@dataclass(frozen=True)
class Features:
    """Hashed words, binned statistics and binned metadata as sparse rows."""

    metadata: int = 0
    word_buckets: int = WORD_BUCKETS

    @property
    def size(self) -> int:
        return self.word_buckets + (STATISTICS + self.metadata) * (BINS + 1)

    def rows(self, texts: pa.Array, metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, value and, for row i, its place ``[first[i], first[i + 1])`` in both."""
        raw, bounds = utf8(texts)
        hashes, start, end, firsts = find_words(raw, bounds)
        stats = structure(raw, bounds, hashes, start, end, firsts)
        binned = np.minimum((stats * BINS).astype(np.int64), BINS - 1)
        known = [np.where(np.isfinite(m), np.clip(np.log2(np.maximum(m, 0) + 1), 0, BINS - 1), BINS).astype(np.int64) for m in metadata]
        fields = np.concatenate([binned, *(k[:, None] for k in known)], axis=1)
        fields += self.word_buckets + np.arange(fields.shape[1]) * (BINS + 1)
        buckets = (hashes % np.uint64(self.word_buckets)).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
        pairs = np.unique(owner * self.word_buckets + buckets)
        owner, buckets = pairs // self.word_buckets, pairs % self.word_buckets
        each = np.bincount(owner, minlength=len(texts))
        value = 1 / np.sqrt(each[owner])
        width = fields.shape[1]
        first = np.concatenate([[0], np.cumsum(each + width)])
        feature, values = np.zeros(first[-1], np.int64), np.zeros(first[-1])
        at = np.arange(len(pairs)) + owner * width
        feature[at], values[at] = buckets, value
        at = (first[1:] - width)[:, None] + np.arange(width)
        feature[at], values[at] = fields, 1 / np.sqrt(width)
        return feature, values, first


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, feature: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """All rows have features, so that sums of stretches are sums of rows."""
        if len(first) == 1:
            return np.zeros(0)
        at = first[:-1]
        scaled = self.factors[feature] * value[:, None]
        sums = np.add.reduceat(scaled, at)
        squares = np.add.reduceat(scaled * scaled, at)
        return self.bias + np.add.reduceat(self.linear[feature] * value, at) + 0.5 * (sums * sums - squares).sum(axis=1)

    def scores(self, feature: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(feature, value, first), -30, 30)))


def fit(feature: np.ndarray, value: np.ndarray, first: np.ndarray, label: np.ndarray, size: int, rank: int = 8, epochs: int = 12, rate: float = 0.15, decay: float = 2e-5, batch: int = 256) -> FactorisationMachine:
    """AdaGrad on the logistic loss, in batches of an order that is the same every time."""
    rng = np.random.default_rng(7)
    linear, factors = np.zeros(size), rng.normal(0, 0.05, (size, rank))
    bias = 0.0
    if not len(label):
        return FactorisationMachine(0.0, linear, np.zeros((size, rank)))
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-4), np.full((size, rank), 1e-4), 1e-4
    counts = np.diff(first)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for rows in np.split(order, np.arange(batch, len(order), batch)):
            n = counts[rows]
            starts = np.cumsum(n) - n
            at = np.repeat(first[rows] - starts, n) + np.arange(n.sum())
            f, x = feature[at], value[at]
            scaled = factors[f] * x[:, None]
            sums = np.add.reduceat(scaled, starts)
            logit = bias + np.add.reduceat(linear[f] * x, starts) + 0.5 * (sums * sums - np.add.reduceat(scaled * scaled, starts)).sum(axis=1)
            wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[rows]) / len(rows)
            each = np.repeat(wrong, n)
            touched, where = np.unique(f, return_inverse=True)
            step = np.bincount(where, each * x, len(touched)) + decay * linear[touched]
            seen_linear[touched] += step * step
            linear[touched] -= rate * step / np.sqrt(seen_linear[touched])
            pull = (each * x)[:, None] * (np.repeat(sums, n, axis=0) - scaled)
            for k in range(rank):
                step = np.bincount(where, pull[:, k], len(touched)) + decay * factors[touched, k]
                seen_factors[touched, k] += step * step
                factors[touched, k] -= rate * 0.3 * step / np.sqrt(seen_factors[touched, k])
            seen_bias += wrong.sum() ** 2
            bias -= rate * wrong.sum() / np.sqrt(seen_bias)
    return FactorisationMachine(bias, linear, factors)


def _metadata(part: pa.RecordBatch, count: int) -> list[np.ndarray]:
    return [pc.fill_null(part.column(f"m{i}").cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for i in range(count)]


def _inputs(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    numbers = [F.col(name).cast("double").alias(f"m{i}") for i, name in enumerate(metadata)]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *numbers)


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (), sample_rows: int = 6000
) -> FactorisationMachine:
    """A model from at most ``sample_rows`` of the rows of ``labels`` for which ``usable`` holds."""
    features = Features(len(metadata))
    chosen = labels.filter(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    chosen = chosen.withColumn("turn", F.xxhash64("id")).orderBy("turn", "id").limit(sample_rows)
    # one row for each of the ids: repeated documents would give the sample no bound; at most ``sample_rows`` small rows are broadcast
    rows = _inputs(docs, id_col, text_col, metadata).join(F.broadcast(chosen), "id")
    schema = "id string, turn bigint, label double, feature array<int>, value array<float>"

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                feature, value, first = features.rows(texts_of(part), _metadata(part, len(metadata)))
                offsets = pa.array(first, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(feature, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(value, pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("turn"), part.column("label"), *lists], ["id", "turn", "label", "feature", "value"])

    sample = rows.mapInArrow(featurize, schema).dropDuplicates(["id"]).orderBy("turn", "id").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), np.zeros(0), features.size)
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(sample["feature"]).to_numpy())])
    label = (sample["label"].to_numpy() >= 0.5).astype(float)
    return fit(pc.list_flatten(sample["feature"]).to_numpy(), pc.list_flatten(sample["value"]).to_numpy(), first, label, features.size)


def score(model: FactorisationMachine, text_col: str = "text", metadata: tuple[str, ...] = ()) -> Column:
    """The score of each row's text and metadata, 0 to 1."""
    features = Features(len(metadata))
    machine = FactorisationMachine(model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32))

    @F.arrow_udf(T.DoubleType())
    def scored(text: pa.Array, *numbers: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, *numbers], ["text", *(f"m{i}" for i in range(len(numbers)))])
        parts = [machine.scores(*features.rows(texts_of(part), _metadata(part, len(numbers)))) for part in slices(batch)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return scored(F.col(text_col).cast("string"), *(F.col(name).cast("double") for name in metadata))

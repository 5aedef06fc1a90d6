import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from articleflow.llm import language
from articleflow.llm.common import fold, table
from articleflow.llm.language import END, Model, Shape, _sums_by, language_scores

from . import cases


def tokens(text):
    return [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [None]


def test_base_scores_equal_brute_force(spark):
    rows = cases.texts()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in enumerate(rows) if not held(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    found = {r.id: r for r in language_scores(cases.documents(spark, rows), fold("doc_id", 10) != 0, shape=Shape(buckets=1 << 10, rounds=2)).collect()}
    assert len(found) == len(rows)
    for i, text in enumerate(rows):
        words = tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert (found[i].n_tokens, found[i].n_known, found[i].train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert found[i].base_score == pytest.approx(base) and found[i].score < 0


def test_model_beats_counts_on_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    row = language_scores(docs, fold("doc_id", 10) != 0).filter(fold("id", 10) == 0).agg(F.sum("score").alias("model"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert row["model"] / row["n"] > row["base"] / row["n"] + 0.1


def test_probabilities_of_a_context_add_up_to_one():
    rng, shape = np.random.default_rng(2), Shape(buckets=64, frequent=3, endings=4)
    model = Model(shape, 100, 10, np.sort(rng.integers(1, 1 << 40, 3).astype(np.uint64)), rng.random(4) * 20, rng.integers(1, 5, 4).astype(float), rng.normal(size=shape.classes), rng.normal(size=(64, shape.classes)))
    features = model.features(np.array([5, 9, END, END], np.uint64), np.array([0, 1, 0, 0]), np.array([0, 3, 4]))
    assert np.exp(model.log_softmax(model.weights, features)).sum(axis=1) == pytest.approx(np.ones(4))
    assert model.classes(np.array([model.frequent[1], 7, END], np.uint64), np.array([0, 2, 0])).tolist() == [2, 1 + 3 + 2, 0]


def test_awkward_rows_and_nothing_to_learn_from(spark):
    small = Shape(buckets=256, rounds=1)
    assert language_scores(cases.awkward(spark), F.lit(True), shape=small).count() == 6
    row = language_scores(cases.documents(spark, ["a b"]), F.lit(False), shape=small).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, pytest.approx(0))
    assert language_scores(cases.empty(spark), F.lit(True), shape=small).count() == 0


@pytest.mark.parametrize("keys", [[7], list(range(50)), [3, 1, 3, 70_000, 1, 3], [5] * 40 + [9] * 13 + [2] * 12 + [0]])
def test_gradients_of_rare_and_frequent_features_add_up(keys):
    keys = np.random.default_rng(4).permutation(np.array(keys))
    values = np.random.default_rng(5).normal(size=(len(keys), 6)).astype(np.float32)
    own, times, sums = _sums_by(keys, values, np.empty_like(values))
    assert own.tolist() == sorted(set(keys.tolist())) and times.tolist() == [int((keys == k).sum()) for k in own]
    assert sums == pytest.approx(np.stack([values[keys == k].sum(axis=0) for k in own]), abs=1e-5)


def test_training_needs_one_room_for_all_batches(monkeypatch):
    """Batches share their work tables, and a small batch after a large one is not mixed with what is left in them."""
    shape = Shape(buckets=64, frequent=3, endings=4, batch=8)
    rng, rooms = np.random.default_rng(2), []
    model = Model(shape, 100, 10, np.sort(rng.integers(1, 1 << 40, 3).astype(np.uint64)), np.ones(4), np.ones(4), np.zeros(shape.classes, np.float32), np.zeros((64, shape.classes), np.float32))
    make = Model.room
    monkeypatch.setattr(Model, "room", lambda self, tables: rooms.append(tables) or make(self, tables))
    weights, met = model.train(iter([pa.RecordBatch.from_pydict({"text": ["a b c d e f g h i", "j"]})]))
    assert rooms == [3] and met.sum() == 12 * 4 and np.abs(weights.sum(axis=1)).max() < 1e-5


def test_counts_meet_those_held_only_when_as_many_are_new(monkeypatch):
    merged, real = [], language._merged
    monkeypatch.setattr(language, "_merged", lambda parts: merged.append(sum(len(p[0]) for p in parts)) or real(parts))
    monkeypatch.setattr(language, "LEAST_MERGED", 8)
    monkeypatch.setattr(language, "slices", lambda batch: (batch.slice(i, 1) for i in range(batch.num_rows)))

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            texts = [f"a{i} b{i} all" for i in range(400)]
            self.found = pa.Table.from_batches(list(run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))))
            return self

        def groupBy(self, *keys):
            return self

        agg = groupBy

    monkeypatch.setattr(language.F, "col", lambda name: type("C", (), {"cast": lambda s, t: s, "alias": lambda s, t: s})())
    monkeypatch.setattr(language.F, "min", language.F.col)
    monkeypatch.setattr(language.F, "sum", language.F.col)
    found = language.token_counts(Rows(), "text", language.Shape()).found
    assert sum(found["c"].to_pylist()) == 1600 and len(set(found["token"].to_pylist())) == 802
    assert sum(merged) < 8 * 1600  # 160,000 if all held ones are sorted again for each piece

"""Hard negatives against all scores, in Python's integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from articleflow.llm import negatives
from articleflow.llm.negatives import hard_negatives
from articleflow.llm.queries import op13_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, id string, score string, mark string, block string"


def brute(rows, anchor, n=5):
    use = []
    for place, (ident, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if ident is not None and ident % 7 == 0 else label
        use.append((ident, [math.floor(256 * x) for x in vector], label, place))
    cap = (1 << 63) - 1
    dot = lambda a, b: max(-cap, min(cap, sum(x * y for x, y in zip(a, b))))
    key = lambda found: (-found[0], found[1] is None, found[1] or 0, found[2])
    out = []
    for ident, vector, label, place in use:
        if not anchor(ident):
            continue
        scores = [(dot(vector, v), i, p, l) for i, v, l, p in use if p != place]
        for p_score, p_id, _, _ in sorted((s for s in scores if s[3] == label), key=key)[:n]:
            fit = sorted((s for s in scores if s[3] != label and 80 * p_score <= 100 * s[0] <= 100 * p_score), key=key)[:n]
            out += [(ident, p_id, rank, s[1], p_score, s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def mined(spark, rows, anchor_step=5):
    df = spark.createDataFrame([(*r, "r", "i", "s", "m", "b") for r in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return found(hard_negatives(df, F.col("vec_id") % anchor_step == 0, label=label))


def vectors(count, dims, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for ident in range(count):
        centre = rng.choice(centres)
        rows.append((ident, [round(c + rng.gauss(0, spread), 2) for c in centre], rng.randint(0, 3)))
    return rows


@pytest.mark.parametrize("dims, spread", [(20, 0.3), (5, 2.0)])
def test_blocks_and_tiles_give_what_all_scores_give(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(negatives, "BLOCK", 17)
    monkeypatch.setattr(negatives, "TILE", 40)
    rows = vectors(150, dims, 4, spread)
    assert mined(spark, rows) == brute(rows, lambda i: i is not None and i % 5 == 0)


def test_odd_rows(spark):
    rows = vectors(30, 4, 9) + [
        (None, [1.0, 1.0, 0.0, 0.0], 1), (None, [1.0, 1.0, 0.0, 0.0], 1), (100, None, 1), (105, [1.0, None, 0.0, 0.0], 1), (110, [float("nan")] * 4, 1),
        (115, [float("inf")] * 4, 2), (120, [1.0, 0.0, 0.0, 0.0], None), (125, [0.0] * 4, 3), (130, [0.0] * 4, 3), (135, [0.0] * 4, 1), (140, [], 3), (145, [1.0], 2),
        (5, [1.0, 1.0, 0.0, 0.0], 2), (5, [1.0, 1.0, 0.0, 0.0], 2), (5, [0.5, 1.0, 0.0, 0.0], 0),
    ]
    assert mined(spark, rows) == brute(rows, lambda i: i is not None and i % 5 == 0)


def test_huge_components_stay_exact(spark):
    rows = [(i, [(i + 1) * 3.0e6 + i * 0.25, 1.0 * i, -2.0e6], i % 3) for i in range(25)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_same_everywhere(spark):
    """One vector under all ids: ties go by id, and no task gets more than its tile."""
    rows = [(i, [0.5, 0.25], i % 2) for i in range(60)]
    assert mined(spark, rows, 20) == brute(rows, lambda i: i % 20 == 0)


def test_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_query_on_the_sample(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(op13_negatives(spark, "/root/testdata/sf0.01")) == brute(rows, lambda i: i % 100 == 0)

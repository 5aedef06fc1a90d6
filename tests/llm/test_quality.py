import numpy as np
import pytest
from pyspark.sql import functions as F

from articleflow.llm import quality
from articleflow.llm.common import fold, table

from . import cases

SMALL = "/root/testdata/sf0.01"


def test_scores_tell_held_out_labels(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = quality.train(docs, labels, fold("doc_id", 3) != 1, metadata=("n_chars",))
    rows = docs.withColumn("p", quality.score(model, metadata=("n_chars",))).join(labels, "doc_id").filter(fold("doc_id", 3) == 1).select("p", "quality").collect()
    good, bad = [r.p for r in rows if r.quality], [r.p for r in rows if not r.quality]
    assert np.mean(np.array(good) >= 0.5) > 0.97 and np.mean(np.array(bad) < 0.5) > 0.7


def test_linear_time_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = quality.FactorisationMachine(0.3, rng.normal(size=20), rng.normal(size=(20, 3)))
    feature, value, first = rng.integers(0, 20, 12), rng.normal(size=12), np.array([0, 5, 12])
    for row in range(2):
        at = range(first[row], first[row + 1])
        pairs = sum(machine.factors[feature[i]] @ machine.factors[feature[j]] * value[i] * value[j] for i in at for j in at if i < j)
        want = 0.3 + sum(machine.linear[feature[i]] * value[i] for i in at) + pairs
        assert machine.logits(feature, value, first)[row] == pytest.approx(want)


def test_awkward_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id int, quality int")
    docs = cases.documents(spark).unionAll(cases.awkward(spark))
    model = quality.train(docs, none, F.lit(True))
    assert {r.p for r in docs.select(quality.score(model).alias("p")).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 1), (None, 0), (9, None), (12, 0)], "doc_id int, quality int")
    model = quality.train(docs, labels, F.lit(True), metadata=("n_chars",))
    scores = [r.p for r in docs.select(quality.score(model, metadata=("n_chars",)).alias("p")).collect()]
    assert len(scores) == docs.count() and all(0 <= p <= 1 for p in scores)
    assert cases.empty(spark).select(quality.score(model, metadata=("n_chars",)).alias("p")).count() == 0

import math

import numpy as np

from articleflow.llm.lattice import STEPS, LatticeIndex, near_vectors, nearest_point

SCHEMA = "vec_id int, embedding array<float>, cls string, vector string, cells string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", "v", "x") for i, v in rows], SCHEMA).repartition(3)


def near(rng, x, cosine):
    n = rng.normal(size=x.shape)
    n -= (n * x).sum(axis=-1, keepdims=True) * x
    return cosine * x + math.sqrt(1 - cosine**2) * n / np.linalg.norm(n, axis=-1, keepdims=True)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def check(spark, rows):
    ids = [i for i, _ in rows]
    x = unit(np.array([v for _, v in rows], np.float32).astype(float))
    links = x @ x.T >= 0.95
    np.fill_diagonal(links, False)
    reach = np.array(ids)
    for _ in ids:
        reach = np.minimum(reach, np.where(links, reach[None, :], max(ids)).min(axis=1))
    found = {r.id: r for r in near_vectors(table(spark, rows)).collect()}
    assert [found[i].component for i in ids] == reach.tolist()
    assert [found[i].n_links for i in ids] == links.sum(axis=1).tolist()


def test_groups_of_near_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = unit(rng.normal(size=(6, 64)))
    vectors = [near(rng, centres[k % 6], 0.993) for k in range(120)] + list(unit(rng.normal(size=(200, 64))))
    vectors += vectors[:5] + vectors[:3]  # equal vectors under other ids
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    check(spark, rows)
    monkeypatch.setattr("articleflow.llm.lattice.CELL_ROWS", 4)  # blocks that meet each other
    check(spark, rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    x = unit(rng.normal(size=(1500, 64)))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near(rng, x, 0.952)]))]
    found = {r.id: r.n_links for r in near_vectors(table(spark, rows)).collect()}
    assert np.mean([found[i] for i in range(1500)]) > 0.93


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(200, 8)) * 2
    near_points = nearest_point(points)
    own = ((points - near_points) ** 2).sum(axis=1)
    assert ((((points - near_points)[:, None] - STEPS) ** 2).sum(axis=2) >= own[:, None] - 1e-12).all() and len(STEPS) == 240
    assert (((near_points * 2) % 2).std(axis=1) == 0).all() and (near_points.sum(axis=1) % 2 == 0).all()
    assert LatticeIndex().codes(unit(rng.normal(size=(3, 5)))).shape == (3, 20)


def test_unusable_vectors_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(0, None), (1, []), (2, [0.0] * 3), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 2.0]), (5, [float("inf"), 1.0, 1.0]), (6, one), (6, one), (None, one), (8, one + [0.0]), (9, [2.0, 4.0, 6.0])]
    found = [(r.id, r.n_links, r.component) for r in near_vectors(table(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted([(i, 0, i) for i in (0, 1, 2, 3, 4, 5, 8)] + [(6, 3, 6)] * 2 + [(None, 3, 6), (9, 3, 6)], key=str)
    assert near_vectors(table(spark, [])).count() == 0

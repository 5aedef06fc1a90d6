import re
from fractions import Fraction

import numpy as np
import pytest

from articleflow.llm import jaccard
from articleflow.llm.jaccard import CountTree, folded, group_counts, near_duplicates, one_of_each, tree_pairs, within_bound

from . import cases


def shingles(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    reach = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and reach[i] != reach[j]:
                    reach[i] = reach[j] = min(reach[i], reach[j])
                    changed = True
    return {i: (len(s), reach[i]) for i, s in sets}


def family():
    """Copies with a few words changed, so that some pairs link only through others."""
    words = cases.prose(120).split()
    out = []
    for k in range(40):
        copy = list(words)
        for at in cases.rng.sample(range(120), 1 + k % 4):
            copy[at] = f"new{k}"
        out.append(" ".join(copy))
    return out


def test_components_equal_brute_force(spark):
    rows = list(enumerate(cases.texts() + family()))
    found = {r.id: (r.n_shingles, r.component) for r in near_duplicates(cases.documents(spark, [t for _, t in rows])).collect()}
    assert found == brute(rows)
    assert len({c for _, c in found.values()}) < len(rows) - 10


def test_one_of_each_keeps_rows_whole(spark):
    rows = list(enumerate(cases.texts()))
    kept = one_of_each(cases.documents(spark, [t for _, t in rows])).collect()
    want = brute(rows)
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (n, c) in want.items() if i == c)
    assert all(r.label == "own label" and r.text == rows[r.doc_id][1] for r in kept)
    awkward = one_of_each(cases.awkward(spark)).collect()
    assert sorted((r.doc_id is None, r.text is None) for r in awkward) == [(False, False), (False, False), (True, True)]
    assert one_of_each(cases.empty(spark)).count() == 0


def test_tree_passes_over_no_pair_within_the_bound():
    rng, t = np.random.default_rng(5), Fraction(3, 4)
    sets = [np.sort(rng.integers(0, 1 << 63, 60, dtype=np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate([s[:50], rng.integers(0, 1 << 63, 8, dtype=np.uint64)])) for s in sets]
    sizes, points = np.array([len(s) for s in sets]), folded([group_counts(s) for s in sets])
    tree = CountTree(sizes, points, fanout=4)
    found = {tuple(sorted((tree.order[i], tree.order[j]))) for i in range(len(sets)) for j in tree.reaching(i, t)}
    for i in range(len(sets)):
        for j in range(i):
            bound = np.minimum(points[i], points[j]).sum()
            fits = 7 * bound >= 3 * (sizes[i] + sizes[j]) and 4 * min(sizes[i], sizes[j]) >= 3 * max(sizes[i], sizes[j])
            assert ((j, i) in found) == fits


@pytest.mark.parametrize("leaf", [1, 16])
def test_large_places_are_split_into_blocks(spark, monkeypatch, leaf):
    monkeypatch.setattr("articleflow.llm.jaccard.TREE_ROWS", 3)
    monkeypatch.setattr("articleflow.llm.jaccard.LEAF_ROWS", leaf)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 100 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in range(14)]
    rows = spark.createDataFrame([(1, i, len(s), i, group_counts(s)) for i, s in enumerate(sets)], "place long, cls long, n long, label long, counts binary")
    pairs = {(r.a, r.b) for r in within_bound(tree_pairs(rows.drop("counts"), rows, Fraction(3, 4)), rows, Fraction(3, 4)).collect()}
    points = folded([group_counts(s) for s in sets])
    assert pairs == {(i, j) for j in range(14) for i in range(j) if 7 * np.minimum(points[i], points[j]).sum() >= 3 * (len(sets[i]) + len(sets[j]))}


@pytest.mark.parametrize("top", [3, 15, 16, 255, 256, 70_000])
def test_points_take_few_bytes_and_keep_their_counts(top):
    counts = np.arange(256) * 7919 % (top + 1)
    counts[17] = top
    point = jaccard.packed(counts)
    assert len(point) == 1 + 256 * (4 if top < 16 else 8 if top < 256 else 16 if top < 1 << 16 else 32) // 8
    wide = jaccard.packed(np.repeat(counts, 4))
    assert folded([point, point]).tolist() == [counts.tolist()] * 2
    assert folded([wide, point]).tolist() == [(counts * 4).tolist(), counts.tolist()]


def test_points_of_usual_texts_have_half_a_byte_a_group():
    assert len(group_counts(np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64) << np.uint64(1))) == 129

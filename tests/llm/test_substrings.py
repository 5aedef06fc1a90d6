"""Removal of repeated word windows against a plain search over all windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from articleflow.llm.queries import op11_substrings
from articleflow.llm.substrings import _Automaton, drop_repeats

from .cases import awkward, documents, empty, texts

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, size):
    """{(id, text): (number of words, removed spans, kept text)} for rows of ids and texts that differ in their ids."""
    said, out = set(), {}
    for ident, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for at in range(len(words) - size + 1):
            window = tuple(words[at : at + size])
            if window in said:
                gone[at : at + size] = [True] * size
            said.add(window)
        spans, at = [], 0
        while at < len(words):
            to = at
            while to < len(words) and gone[to]:
                to += 1
            if to > at:
                spans.append((at, to))
            at = to + 1
        out[ident] = len(words), spans, " ".join(w for w, g in zip(words, gone) if not g)
    return out


def found(df):
    return {r.id: (r.n_words, [tuple(s) for s in r.removed], r.kept) for r in df.collect()}


@pytest.mark.parametrize("hot, shard", [(2000, 40000), (2, 60)])
def test_windows_that_start_earlier(spark, hot, shard):
    rows = texts()
    got = drop_repeats(documents(spark, rows), threshold=6, hot=hot, shard=shard)
    assert found(got) == brute(list(enumerate(rows)), 6)


def test_few_words_in_ever_new_order(spark):
    rng = random.Random(8)
    rows = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a " * 90, "a " * 50 + "b", "ab " * 40]
    got = drop_repeats(documents(spark, rows), threshold=7, hot=5, shard=100)
    assert found(got) == brute(list(enumerate(rows)), 7)


def test_threshold_of_one_word_and_of_many(spark):
    rows = ["x y x", "y z", "Y y", None, ""]
    assert found(drop_repeats(documents(spark, rows), threshold=1)) == brute(list(enumerate(rows)), 1)
    long = " ".join(f"w{i % 150}" for i in range(700))
    assert found(drop_repeats(documents(spark, [long, long + " end"]), threshold=130)) == brute([(0, long), (1, long + " end")], 130)


def test_repeated_rows_null_ids_and_shared_ids(spark):
    rows = drop_repeats(awkward(spark), threshold=20).collect()
    assert len(rows) == 6
    # The text of the null id comes first and stays; all others with that text lose it, however often they are there.
    whole = [r for r in rows if r.id is None and r.n_words == 90]
    assert [(r.n_words, r.removed) for r in whole] == [(90, [])]
    assert sorted(r.n_words - sum(s.end - s.start for s in r.removed) for r in rows if r.id == 7) == [0, 0, 2, 30]


def test_nothing(spark):
    assert drop_repeats(empty(spark)).collect() == []


def test_automaton_finds_every_earlier_window():
    rng = random.Random(2)
    for size in (1, 2, 5):
        automaton, said = _Automaton(), set()
        for _ in range(200):
            words = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
            bits = 0
            for at in range(len(words) - size + 1):
                bits |= (tuple(words[at : at + size]) in said) << at
                said.add(tuple(words[at : at + size]))
            assert automaton.stream(words, size) == bits


def test_query_on_the_sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in rows], 20)
    from hashlib import sha256

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op11_substrings(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (n, sum(b - a for a, b in s), sha256(k.encode()).hexdigest()) for i, (n, s, k) in want.items()}
    assert sum(n for _, n, _ in got.values()) > 0

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from articleflow.llm import suffixes
from articleflow.llm.suffixes import Parsing, remove_repeats

from . import cases


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append((len(b), [tuple(e) for e in edges.reshape(-1, 2).tolist()], np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def found(df, parsing):
    return {r.id: (r.n_bytes, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in remove_repeats(df, parsing=parsing).collect()}


@pytest.mark.parametrize("parsing", [Parsing(40, 6, 8), Parsing(60, 4, 5), Parsing(30, 8, 40)])
def test_repeats_equal_brute_force(spark, parsing):
    rnd = random.Random(parsing.length)
    passages = [cases.prose(rnd.randint(4, 30)) for _ in range(10)]
    texts = [" ".join(rnd.choice([cases.prose(rnd.randint(1, 9)), rnd.choice(passages)]) for _ in range(rnd.randint(0, 7))) for _ in range(80)]
    texts += ["", None, "a" * 300, "a" * 200, "ab" * 150, texts[3], texts[3]]
    assert found(cases.documents(spark, texts), parsing) == dict(enumerate(brute(texts, parsing.length)))


def test_long_texts_and_awkward_rows(spark):
    texts = cases.texts()
    texts.append(texts[-1][1000:9000])
    assert found(cases.documents(spark, texts), Parsing()) == dict(enumerate(brute(texts, 400)))
    rows = remove_repeats(cases.awkward(spark), parsing=Parsing(100, 8, 16)).collect()
    assert len(rows) == 6 and sum(bool(r.removed) for r in rows) == 4
    assert remove_repeats(cases.empty(spark)).count() == 0


def test_units_and_windows_are_not_kept_together(spark, monkeypatch):
    kept, together = {}, []

    def stored(df, name, store=suffixes.stored):
        out = store(df, name)
        kept[out.stored_at] = name
        together.append(set(kept.values()))
        return out

    monkeypatch.setattr(suffixes, "stored", stored)
    monkeypatch.setattr(suffixes, "discard", lambda *tables, drop=suffixes.discard: (drop(*tables), [kept.pop(t.stored_at) for t in tables]))
    texts = ["".join(random.Random(n % 3).choices("abcd ", k=300)) for n in range(9)] + ["x" * 200]
    assert found(cases.documents(spark, texts), Parsing(40, 6, 8)) == dict(enumerate(brute(texts, 40)))
    assert any("windows" in names for names in together)
    assert not any("windows" in names and names & {"units", "classes"} for names in together)
    assert set(kept.values()) == {"repeated-ranges"}


def test_names_and_places_of_windows_without_objects_for_each():
    data = [b"ab" * 200, b"x", b""]
    whole = [xxhash.xxh3_128_intdigest(d) for d in data]
    assert suffixes._signed([xxhash.xxh3_128_digest(d) for d in data], 2).tolist() == [[(w >> 64) - (1 << 63), (w & (1 << 64) - 1) - (1 << 63)] for w in whole]
    names = np.array([[1, 1], [2, 1], [1, 1], [1, 2], [2, 1], [1, 1]])
    once, places, again = suffixes._once(np.array([7, 9, 3, 4, 5, 6]), names)
    assert dict(zip(map(tuple, once.tolist()), places.tolist(), strict=True)) == {(1, 1): 3, (1, 2): 4, (2, 1): 5}
    assert again.tolist() == [3, 5, 6, 7, 9]
    assert [x.tolist() for x in suffixes._stretches(again)] == [[3, 5, 9], [3, 7, 9]]
    assert [x.tolist() for x in suffixes._stretches(again[:0])] == [[], []]

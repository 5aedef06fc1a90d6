import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from articleflow.llm import packing, words
from articleflow.llm.packing import pack_documents, plan_bins

from . import cases

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> Hello WORLD<|ENDOFTEXT|>", "a b\x1cd\x85e", "École İstanbul ΟΣ é", "it's I'LL 123 4,5 \U0001f600한국어", "x" * 5000]


def test_pieces_are_the_tokenizer_s_and_fill_their_sequences(spark):
    texts = cases.texts() + ODD
    rows = pack_documents(cases.documents(spark, texts), PATH, capacity=256, with_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    for i, text in enumerate(texts):
        want = plain.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.piece)
        assert sum((list(r.ids) for r in own), []) == want
        assert [(r.piece, r.start, r.length) for r in own] == [(k, k * 256, min(256, len(want) - k * 256)) for k in range(-(-len(want) // 256))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / 256 + 1


def one_by_one(lengths, capacity):
    """Best-two-fit on a list of pieces, bin after bin."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        content, gap = [], capacity
        for x in list(left):
            if x <= gap:
                content.append(x)
                left.remove(x)
                gap -= x
        smallest = content[-1]
        pairs = [(a + b, a, b) for k, a in enumerate(left) for b in left[k + 1 :] if smallest < a + b <= gap + smallest]
        if gap and pairs:
            best = max(pairs)
            left.remove(best[1])
            left.remove(best[2])
            left.append(smallest)
            left.sort(reverse=True)
        bins += 1
    return bins


def test_plan_by_histogram_is_best_two_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 40, rng.integers(1, 60)).tolist()
        bins = plan_bins(Counter(lengths), 40)
        assert sum((Counter({k: n * times for k, n in content.items()}) for content, times in bins), Counter()) == Counter(lengths)
        assert all(sum(k * n for k, n in content.items()) <= 40 for content, _ in bins)
        assert sum(times for _, times in bins) == one_by_one(lengths, 40)


def test_awkward_rows(spark):
    assert pack_documents(cases.awkward(spark), PATH).count() == 6
    assert pack_documents(cases.empty(spark), PATH).count() == 0


def test_a_worker_keeps_its_words_between_tasks():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.word_encoder(path)
    assert packing.word_encoder(path) is encoder
    texts = pa.array(["One two, two three", "", "two four"], pa.large_string())
    first = encoder.encode(texts, 0)
    known = len(encoder.known)
    again = encoder.encode(texts, 0)
    assert len(encoder.known) == known
    alone = packing.WordEncoder(path).encode(texts, 0)
    assert all(x.tolist() == y.tolist() == z.tolist() for x, y, z in zip(first, again, alone, strict=True))


def test_distinct_words_are_those_of_a_sort():
    hashes = np.random.default_rng(5).integers(0, 50, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for values in (hashes, hashes[:0]):
        assert all(x.tolist() == y.tolist() for x, y in zip(words.distinct(values), np.unique(values, return_index=True, return_inverse=True), strict=True))

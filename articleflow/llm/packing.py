"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

A plan depends on piece lengths alone, so it is made on their histogram: at most ``capacity`` counts, however large the corpus. A bin
is filled greedily with the largest lengths that still fit; then its smallest piece gives way to two unpacked pieces that fill
the expanded gap more tightly, where there are such. The same bin is repeated while pieces last, which is what filling bins one after
another would do. Pieces get their rank among pieces of their length (counted in blocks, so no length goes to one task), and
the rank finds the place in the plan.

Defined results: null is the empty text, which is one token, the end; rows that repeat an id are packed one by one; an empty table gives
no pieces; other columns are not read. Texts are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.llm.common import slices, stored, texts_of, utf8
from articleflow.llm.words import distinct, find_words

#: Words whose ids an encoder keeps at most; it then starts afresh.
KEPT_WORDS = 1_000_000
#: Parts of each length for which ranks are counted apart.
BLOCKS = 256


class WordEncoder:
    """Ids of texts by a tokenizer in which white space separates and case of ASCII letters doesn't matter, so that each word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts with one of these are encoded whole: they are found in raw text, case included.
        self.marks = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _slots(self, hashes: np.ndarray, example: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the ids of each distinct word are kept."""
        at = np.searchsorted(self.known, hashes)
        hit = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == hashes[inside]
        if not hit.all():
            places = example[~hit]
            ids = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[places].tolist(), end[places].tolist(), strict=True)])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            fresh = np.arange(len(self.size), len(self.size) + len(ids))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.ids = np.concatenate([self.ids, np.array([i for word in ids for i in word], np.uint32)])
            self.known, self.slot = np.insert(self.known, at[~hit], hashes[~hit]), np.insert(self.slot, at[~hit], fresh)
            at = np.searchsorted(self.known, hashes)
        return self.slot[at]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end_id``, and where each text begins and ends in them."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        raw, bounds = utf8(texts)
        hashes, start, end, firsts = find_words(raw, bounds)
        fresh, example, which = distinct(hashes)
        data = raw.tobytes()
        slot = self._slots(fresh, example, data, start, end)[which]
        size = self.size[slot]
        ends = np.concatenate([[0], np.cumsum(size)])
        total = int(ends[-1])
        out = np.full(total + len(texts), end_id, np.uint32)
        text_of = np.repeat(np.arange(len(texts)), np.diff(firsts))
        source = np.arange(total) + np.repeat(self.first[slot] - ends[:-1], size)
        out[np.arange(total) + np.repeat(text_of, size)] = self.ids[source]
        places = ends[firsts] + np.arange(len(texts) + 1)
        low = data.lower()
        if any(mark in low for mark in self.marks):
            return self._with_marks(texts, out, places, end_id)
        return out, places

    def _with_marks(self, texts: pa.Array, out: np.ndarray, places: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [out[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        for i, text in enumerate(texts.to_pylist()):
            low = text.encode().lower()
            if any(mark in low for mark in self.marks):
                parts[i] = np.array([*self._encode([text])[0], end_id], np.uint32)
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker, which keeps its words from one task to the next."""
    return WordEncoder(path)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): documents as ids and an end, cut into pieces of ``capacity`` where they are longer."""
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(name, T.LongType()) for name in ("start", "length", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                ids, places = encoder.encode(texts_of(part), end_id)
                sizes = np.diff(places)
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                first = places[owner] + start
                spans = [ids[a : a + n] for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                columns = [part.column("id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length)]
                columns.append(pa.array([zlib.crc32(span.astype("<u4").tobytes()) for span in spans], pa.int64()))
                if with_ids:
                    columns.append(pa.array([span.astype(np.int64) for span in spans], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, T.StructType(fields))


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (pieces of each length, how many such bins), for ``counts`` pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    bins = []
    while left.any():
        content = _fill(left, capacity)
        _swap_smallest(left, content, capacity)
        times = min(int(left[length]) // n for length, n in content.items())
        for length, n in content.items():
            left[length] -= n * times
        bins.append((content, times))
    return bins


def _fill(left: np.ndarray, capacity: int) -> dict[int, int]:
    """The largest piece that fits, again and again."""
    content: dict[int, int] = {}
    gap, limit = capacity, capacity
    while gap:
        fitting = np.flatnonzero(left[: min(gap, limit) + 1])
        if not len(fitting):
            break
        length = int(fitting[-1])
        content[length] = min(int(left[length]), gap // length)
        gap -= content[length] * length
        limit = length - 1
    return content


def _swap_smallest(left: np.ndarray, content: dict[int, int], capacity: int) -> None:
    """Two pieces in the place of the smallest one of the bin, if they leave less room."""
    smallest = min(content)
    room = capacity - sum(length * n for length, n in content.items()) + smallest
    if room == smallest:
        return
    free = left[: room + 1].copy()
    for length, n in content.items():
        if length <= room:
            free[length] -= n
    large = np.flatnonzero(free)
    if not len(large):
        return
    below = np.maximum.accumulate(np.where(free > 0, np.arange(room + 1), 0))
    small = below[np.minimum(large, room - large)]
    alone = (small == large) & (free[large] < 2)
    small[alone] = below[large[alone] - 1]
    both = np.where(small > 0, large + small, 0)
    best = int(np.argmax(both))
    if both[best] <= smallest:
        return
    content[smallest] -= 1
    if not content[smallest]:
        del content[smallest]
    for length in (int(large[best]), int(small[best])):
        content[length] = content.get(length, 0) + 1


class Places:
    """Sequence and offset of the n-th piece of a length under a plan."""

    def __init__(self, bins: list[tuple[dict[int, int], int]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        for content, times in bins:
            offset = 0
            for length in sorted(content, reverse=True):
                runs.setdefault(length, []).append((content[length] * times, content[length], sequence, offset))
                offset += content[length] * length
            sequence += times
        self.sequences = sequence
        self.runs = {length: np.array(rows, np.int64).T for length, rows in runs.items()}
        self.ends = {length: np.cumsum(rows[0]) for length, rows in self.runs.items()}

    def of(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces, each, sequence, offset = self.runs[length]
        run = np.searchsorted(self.ends[length], rank, side="right")
        within = rank - (self.ends[length] - pieces)[run]
        return sequence[run] + within // each[run], offset[run] + within % each[run] * length


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (stored, with id, piece, start, length) with ``sequence_id`` and ``offset``."""
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = Places(plan_bins(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((2, len(length)), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(group):
                out[:, group] = places.of(int(lengths[group[0]]), ranks[group])
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    blocks = pieces.withColumn("block", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(BLOCKS)).cast("int"))
    own = Window.partitionBy("length", "block").orderBy("id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = blocks.groupBy("length", "block").agg(F.count("*").alias("n"))
    firsts = firsts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = blocks.withColumn("nth", F.row_number().over(own) - 1).join(firsts, ["length", "block"])
    return ranked.withColumn("place", place("length", F.col("first") + F.col("nth"))).select(*pieces.columns, "place.*")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): one row per piece, in sequences of at most ``capacity``."""
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids)
    return pack(stored(pieces, "token-pieces"), capacity)

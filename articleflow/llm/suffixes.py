"""Removal of byte strings of a given length that occur elsewhere in the corpus, by prefix-free parsing.

A rolling hash cuts texts at trigger strings, so equal text is cut alike wherever it stands, and the corpus becomes a dictionary of phrases and a parse.
Corpus order of suffixes only matters here as far as their first ``length`` bytes are equal, so suffixes are not sorted by bytes: they get names (hashes)
of what they begin with, which Spark groups at any size. The two halves of the order combine as follows.

1. Dictionary: a phrase that occurs once is in no repeated string, so every window that holds it is settled. Few windows are left.
2. Parse: the left windows with the same first trigger are one unit, a stretch of the text. Units with the same bytes are one class; a class
   that occurs twice is repeated throughout. Equal windows have their first trigger at the same place and the same bytes after it; where
   one class alone follows a trigger's bytes, nothing else can be equal to its windows.
3. Dictionary suffixes: where several classes follow, one of each gives its windows one by one, and these are grouped by their bytes.

Windows whose first trigger is far away, or that have none, are units of their own.

Defined results: null is the empty text; texts under ``length`` bytes lose nothing; rows that repeat an id count as texts of their own, so equal
rows lose all their repeated strings; texts that repeat an id and differ are told apart by a hash; other columns are not read. Names have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.llm.common import discard, slices, stored, texts_of, utf8
from articleflow.llm.words import PIECE, mixed, powers

_VALUES = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Parsing:
    length: int = 400
    trigger: int = 16
    phrase: int = 32

    @property
    def near(self) -> int:
        """How far from the start of a window its first trigger may be; as many bytes as are left name what follows it."""
        return self.length * 3 // 4

    def phrases(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Triggers of all texts, a hash of the phrase from each to the next one's end, and text i's triggers as ``firsts[i]:firsts[i + 1]``."""
        places, names = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        up, down = powers(PIECE + self.length + self.trigger + 1)
        for at in range(0, len(raw), PIECE):
            piece = raw[at : at + PIECE + self.length + self.trigger]  # a longer phrase is in no window
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_VALUES[piece] * up[: len(piece)], out=sums[1:])
            last = len(piece) - self.trigger + 1
            if last <= 0:
                break
            rolling = mixed((sums[self.trigger :] - sums[:last]) * down[:last])
            found = np.flatnonzero(rolling % np.uint64(self.phrase) == 0)
            ends = np.append(found[1:] + self.trigger, len(piece))
            names.append(mixed((sums[ends] - sums[found]) * down[found])[found < PIECE])
            places.append(found[found < PIECE] + at)
        place, name = np.concatenate(places), np.concatenate(names)
        inside = place + self.trigger <= bounds[np.searchsorted(bounds, place, side="right").clip(max=len(bounds) - 1)]
        place, name = place[inside], name[inside]
        return place, name, np.searchsorted(place, bounds)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, version and text; the two first are the key of a text."""
    return docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("version"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _keyed(docs: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([docs.schema["id"], T.StructField("version", T.IntegerType()), *fields])


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.LongType()) for name in names]


def _join(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    lists = lists.withColumnsRenamed({"id": "of_id", "version": "of_version"})
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("version") == F.col("of_version"))
    return texts.join(lists, same, how).drop("of_id", "of_version")


def phrase_rows(texts: DataFrame, parsing: Parsing) -> DataFrame:
    """(id, version, nth, phrase): the phrases that fit into a window, of texts that have windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, bounds = utf8(texts_of(part))
                place, name, firsts = parsing.phrases(raw, bounds)
                owner = np.repeat(np.arange(part.num_rows), np.diff(firsts))
                nth = np.arange(len(place)) - firsts[owner]
                whole = np.zeros(len(place), bool)
                whole[:-1] = (owner[1:] == owner[:-1]) & (place[1:] + parsing.trigger - place[:-1] <= parsing.length)
                whole &= np.diff(bounds)[owner] >= parsing.length
                keys = [part.column(c).take(pa.array(owner[whole])) for c in ("id", "version")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(nth[whole]), pa.array(name[whole].view(np.int64))], ["id", "version", "nth", "phrase"])

    return texts.mapInArrow(run, _keyed(texts, *_longs("nth", "phrase")))


def _open_windows(place: np.ndarray, repeated: np.ndarray, size: int, parsing: Parsing) -> np.ndarray:
    """Where windows start that hold no phrase of which there is only one."""
    last = size - parsing.length
    lone = ~repeated[: max(0, len(place) - 1)]
    begin, end = place[:-1][lone], place[1:][lone] + parsing.trigger
    low, high = np.maximum(0, end - parsing.length), np.minimum(begin, last)
    some = low <= high
    change = np.zeros(last + 2, np.int32)
    np.add.at(change, low[some], 1)
    np.add.at(change, high[some] + 1, -1)
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


def _signed(digests: list[bytes], words: int) -> np.ndarray:
    """Digests of so many 64-bit words each as rows of signed numbers in the order of the digests."""
    return (np.frombuffer(b"".join(digests), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).reshape(-1, words)


def _once(lows: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names and where each is first, and in ascending order all places whose name has another place."""
    order = np.lexsort((lows, names[:, 1], names[:, 0]))
    lows, names = lows[order], names[order]
    fresh = np.ones(len(lows), bool)
    fresh[1:] = (names[1:] != names[:-1]).any(axis=1)
    twice = ~fresh
    twice[:-1] |= ~fresh[1:]
    return names[fresh], lows[fresh], np.sort(lows[twice])


def _stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive places, which are ascending."""
    edge = np.flatnonzero(np.diff(places) > 1)
    return (places[np.append(0, edge + 1)], places[np.append(edge, len(places) - 1)]) if len(places) else (places, places)


def unit_rows(texts: DataFrame, parsing: Parsing) -> DataFrame:
    """(id, version, low, high, after, c1, c2): windows ``low``..``high`` are a unit of class (c1, c2); ``after`` names what follows its trigger.

    Single windows that a text repeats (periodic text without triggers) are given once, and their stretches without a class: these are settled.

    ``texts`` has ``repeated``, the numbers of the phrases that occur twice or more.
    """
    whole, short, rest = xxhash.xxh3_128_digest, xxhash.xxh3_64_digest, parsing.length - parsing.near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, bounds = utf8(texts_of(part))
                place, _, firsts = parsing.phrases(raw, bounds)
                data, numbers, rows = raw.tobytes(), part.column("repeated"), []
                none = np.zeros(0, np.int64)
                for i in np.flatnonzero(np.diff(bounds) >= parsing.length).tolist():
                    start, size = int(bounds[i]), int(bounds[i + 1] - bounds[i])
                    own = place[firsts[i] : firsts[i + 1]] - start
                    repeated = np.zeros(len(own), bool)
                    known = numbers[i].values if numbers[i].is_valid else None
                    if known is not None:
                        repeated[known.to_numpy()] = True
                    longer = np.diff(own) + parsing.trigger > parsing.length
                    repeated[:-1][longer] = True  # in no window
                    open_at = _open_windows(own, repeated, size, parsing)
                    if not len(open_at):
                        continue
                    at = np.searchsorted(own, open_at)
                    first = np.append(own, size + parsing.length)[at]
                    alone = first - open_at > parsing.near
                    fresh = np.ones(len(open_at), bool)
                    fresh[1:] = (np.diff(open_at) > 1) | (at[1:] != at[:-1]) | alone[1:] | alone[:-1]
                    begins = np.flatnonzero(fresh)
                    lows, highs = open_at[begins], open_at[np.append(begins[1:], len(open_at)) - 1]
                    single, triggers = alone[begins], first[begins]
                    names = _signed([whole(data[a:b]) for a, b in zip((lows + start).tolist(), (highs + start + parsing.length).tolist(), strict=True)], 2)
                    follows = _signed([short(data[a : a + rest]) for a in (triggers[~single] + start).tolist()], 1)[:, 0]
                    lonely, place_of, again = _once(lows[single], names[single])
                    begin, end = _stretches(again)
                    low = np.concatenate([lows[~single], place_of, begin])
                    high = np.concatenate([highs[~single], place_of, end])
                    classes = np.concatenate([names[~single], lonely, np.zeros((len(begin), 2), np.int64)])
                    after = np.concatenate([follows, lonely[:, 0], np.zeros(len(begin), np.int64)])
                    settled = np.arange(len(low)) >= len(low) - len(begin)
                    rows.append((np.full(len(low), i), low, high, after, classes[:, 0], classes[:, 1], settled))
                owner, low, high, *columns, settled = map(np.concatenate, zip(*rows, strict=True)) if rows else [*[none] * 6, none.astype(bool)]
                keys = [part.column(c).take(pa.array(owner)) for c in ("id", "version")]
                named = [pa.array(c, mask=settled) for c in columns]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(low), pa.array(high), *named], ["id", "version", "low", "high", "after", "c1", "c2"])

    return texts.mapInArrow(run, _keyed(texts, *_longs("low", "high", "after", "c1", "c2")))


def window_rows(texts: DataFrame, parsing: Parsing) -> DataFrame:
    """(id, version, low, c1, c2) for each window of the stretches in ``ranges``."""
    digest, length = xxhash.xxh3_128_digest, parsing.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, bounds = utf8(texts_of(part))
                data = raw.tobytes()
                for i, ranges in enumerate(part.column("ranges").to_pylist()):
                    start = int(bounds[i])
                    lows = np.concatenate([np.arange(r["low"], r["high"] + 1) for r in ranges])
                    for chunk in np.split(lows, np.arange(50_000, len(lows), 50_000)):
                        names = _signed([digest(data[at : at + length]) for at in (chunk + start).tolist()], 2)
                        keys = [part.column(c).take(pa.array(np.full(len(chunk), i))) for c in ("id", "version")]
                        yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, (chunk, names[:, 0], names[:, 1]))], ["id", "version", "low", "c1", "c2"])

    return texts.mapInArrow(run, _keyed(texts, *_longs("low", "c1", "c2")))


def repeated_ranges(texts: DataFrame, parsing: Parsing) -> DataFrame:
    """(id, version, low, high): stretches of window starts whose windows occur elsewhere too."""
    phrases = stored(phrase_rows(texts, parsing), "phrases")
    often = phrases.groupBy("phrase").agg(F.count("*").alias("n")).filter("n > 1").select("phrase")
    often = stored(often, "dictionary")
    known = stored(phrases.join(often, "phrase").groupBy("id", "version").agg(F.collect_set("nth").alias("repeated")), "repeated-phrases")
    discard(phrases, often)
    every = stored(unit_rows(_join(texts, known, "left").select("id", "version", "text", "repeated"), parsing), "units")
    discard(known)
    settled, units = every.filter("c1 is null").select("id", "version", "low", "high"), every.filter("c1 is not null")
    one = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "version", "low", "high")).alias("one")
    classes = stored(units.groupBy("after", "c1", "c2").agg(F.count("*").alias("n"), one), "classes")
    # Each table goes before the next large one comes, so that no two sets of units or windows are on disk together.
    whole = units.join(classes.filter("n > 1").select("c1", "c2"), ["c1", "c2"]).select("id", "version", "low", "high").distinct()
    whole = stored(whole.union(settled), "repeated-units")
    discard(every)
    several = classes.groupBy("after").agg(F.count("*").alias("n")).filter("n > 1").select("after")
    compared = classes.join(several, "after", "left_semi").select("one.id", "one.version", "one.low", "one.high")
    compared = compared.groupBy("id", "version").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    compared = stored(compared, "compared")
    discard(classes)
    windows = stored(window_rows(_join(texts, compared, "inner").select("id", "version", "text", "ranges"), parsing), "windows")
    discard(compared)
    twice = stored(windows.groupBy("c1", "c2").agg(F.count("*").alias("n")).filter("n > 1").select("c1", "c2"), "repeated-windows")
    found = windows.join(twice, ["c1", "c2"]).select("id", "version", "low", F.col("low").alias("high")).distinct()
    ranges = stored(whole.union(found), "repeated-ranges")
    discard(whole, windows, twice)
    return ranges


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parsing: Parsing = Parsing()) -> DataFrame:
    """(id, n_bytes, removed, kept): removed byte runs as (start, end) and the bytes that stay; one row per document."""
    texts = _texts(docs, id_col, text_col)
    ranges = repeated_ranges(texts, parsing).groupBy("id", "version").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    run_type = T.ArrayType(T.StructType(_longs("start", "end")))
    schema = T.StructType([texts.schema["id"], *_longs("n_bytes"), T.StructField("removed", run_type), T.StructField("kept", T.BinaryType())])
    arrow_runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, bounds = utf8(texts_of(part))
                data = raw.tobytes()
                removed, kept = [], []
                for i, ranges in enumerate(part.column("ranges")):
                    start, end = int(bounds[i]), int(bounds[i + 1])
                    if not ranges.is_valid:
                        removed.append([])
                        kept.append(data[start:end])
                        continue
                    low, high = (ranges.values.field(c).to_numpy() for c in ("low", "high"))
                    change = np.zeros(end - start + 1, np.int32)
                    np.add.at(change, low, 1)
                    np.add.at(change, high + parsing.length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    removed.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                    kept.append(raw[start:end][~gone].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(bounds)), pa.array(removed, arrow_runs), pa.array(kept, pa.binary())], schema.names)

    return _join(texts, ranges, "left").select("id", "text", "ranges").mapInArrow(run, schema)

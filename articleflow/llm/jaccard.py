"""Exact join of documents whose sets of word shingles have a Jaccard similarity at or over a threshold, and their components.

Shingles are hashed into groups; the vector of a document's group counts is a point. The overlap of two documents is at most the sum of the
smaller of their counts in each group, so a pair whose sum is too small for its sizes can't link; in a packed R-tree the
same holds of a node with the largest counts below it, and whole nodes are passed over.

Documents with the same set are one class. Which classes meet in a tree follows from the threshold: two sets that link share a shingle
among the first ``n - ceil(t n) + 1`` of each in any fixed order, here frequent shingles last, and shingles
shared by just the same classes are one meeting place. The few shingles that are frequent are found by mergeable
counts over all documents; they only set the order, results don't depend on them. Meeting classes are first tried against a few leaders of
each meeting place (so a large family of near copies costs a check or two for each member, not one for each pair); what the links found so far don't
connect meets in R-trees; pairs that survive the bound are verified on whole sets. No link between different sets is lost.

Defined results: texts without words (null, empty, white space) have an empty set and link with nothing; with fewer words than a
shingle, the whole sequence is the one shingle; a null id can't be a component's smallest id unless no other id is there; rows that repeat an id
share its component when their texts link; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.llm.common import discard, slices, stored, texts_of, utf8
from articleflow.llm.components import connected
from articleflow.llm.words import find_words, mixed, windows

#: Groups of a set of ``n`` shingles: the power of two from ``n / 2`` on, between these bounds. Counts fold to half as many groups by sums.
LEAST_GROUPS, MOST_GROUPS = 256, 1 << 16
#: Shingles counted at a time in a task, and frequent ones told apart at most.
COUNTERS, FREQUENT = 1 << 16, 20_000
#: Leaders of a place that all its classes are tried against before the trees.
LEADERS = 2
#: Classes in one leaf and in one tree.
LEAF_ROWS, TREE_ROWS = 16, 512
#: Documents whose sets are wanted that may be broadcast as ids (16 bytes each), so that texts stay where they are; more are shuffled with the texts.
BROADCAST_SETS = 500_000
#: Classes whose rows a task remembers to have given.
REMEMBERED = 1 << 20


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, bounds = utf8(texts)
    hashes, _, _, firsts = find_words(raw, bounds)
    grams = windows(hashes, size)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield windows(hashes[a:b] ^ np.uint64(b - a), b - a)
        else:
            yield np.zeros(0, np.uint64)


def class_of(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def group_counts(shingles: np.ndarray) -> bytes:
    """The point of a set: shingles in each of its groups, which are stretches of the hash range."""
    bits = min(max(len(shingles) // 2, LEAST_GROUPS) - 1, MOST_GROUPS - 1).bit_length()
    return packed(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))


def packed(counts: np.ndarray) -> bytes:
    """A byte that says how many bits a count takes, and the counts: most points have none over 15, and they are most of what is shuffled."""
    top = counts.max(initial=0)
    if top < 16:
        return b"\x04" + (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    bits = 8 if top < 1 << 8 else 16 if top < 1 << 16 else 32
    return bytes([bits]) + counts.astype(f"<u{bits // 8}").tobytes()


def groups_of(point: bytes) -> int:
    return (len(point) - 1) * 8 // point[0]


def folded(points: list[bytes], width: int | None = None) -> np.ndarray:
    """Points as rows with ``width`` groups, or else as many as the one with the fewest has."""
    width = width or min(map(groups_of, points))
    out, alike = np.empty((len(points), width), np.int32), {}
    for i, point in enumerate(points):
        alike.setdefault((point[0], len(point)), []).append(i)
    for (bits, size), at in alike.items():
        raw = np.frombuffer(b"".join([points[i] for i in at]), np.uint8).reshape(len(at), size)[:, 1:]
        counts = np.stack([raw & 15, raw >> 4], axis=2) if bits == 4 else np.ascontiguousarray(raw).view(f"<u{bits // 8}")
        out[at] = counts.reshape(len(at), width, -1).sum(axis=2, dtype=np.int32)
    return out


class FrequentCounts:
    """Counts of the frequent values of a stream in bounded memory: when there are too many, all are lowered by the same amount."""

    def __init__(self, most: int):
        self.most, self.values, self.counts = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        both, where = np.unique(np.concatenate([self.values, values]), return_inverse=True)
        weight = np.concatenate([self.counts, np.ones(len(values), np.int64)])
        counts = np.bincount(where, weight, len(both)).astype(np.int64)
        if len(both) > self.most:
            counts -= np.partition(counts, -self.most - 1)[-self.most - 1]
            both, counts = both[counts > 0], counts[counts > 0]
        self.values, self.counts = both, counts


def profiles(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """For each document (id, version, n, cls, counts), where version is a hash of the text, and rows (shingle, seen) of what is frequent in a task."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType), T.StructField("version", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()),
            T.StructField("counts", T.BinaryType()), T.StructField("shingle", T.LongType()), T.StructField("seen", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, id_type = FrequentCounts(COUNTERS), pa.null()
        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in slices(batch):
                sets = list(shingle_sets(texts_of(part), size))
                frequent.add(np.concatenate(sets))
                counts = [group_counts(s) for s in sets]
                none = pa.nulls(len(sets), pa.int64())
                columns = [part.column("id"), part.column("version"), pa.array(map(len, sets), pa.int64()), pa.array(map(class_of, sets), pa.int64()), pa.array(counts, pa.binary()), none, none]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        again = frequent.counts > 1
        if again.any():
            values, seen = pa.array(frequent.values[again].view(np.int64)), pa.array(frequent.counts[again])
            none = pa.nulls(len(values), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(values), id_type), none, none, none, pa.nulls(len(values), pa.binary()), values, seen], schema.names)

    inputs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).cast("string").alias("text"))
    return inputs.mapInArrow(run, schema)


def meetings(docs: DataFrame, text_col: str, size: int, threshold: Fraction, frequent: list[tuple[int, int]]) -> DataFrame:
    """(place, cls, n): for each class the shingles among its first ones that another class may have among its first ones."""
    values = np.array([v for v, _ in frequent], np.int64).view(np.uint64)
    weights = np.array([w for _, w in frequent], np.int64)
    order = np.argsort(values)
    values, weights = values[order], weights[order]

    def first_shingles(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a set, and which of them are frequent."""
        n = len(shingles)
        count = n - -(-threshold.numerator * n // threshold.denominator) + 1
        if not len(values):
            return shingles[:count], np.zeros(min(count, n), bool)
        at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
        known = values[at] == shingles
        if not known.any():
            return shingles[:count], known[:count]
        turn = np.lexsort((shingles, np.where(known, weights[at], 0)))[:count]
        return shingles[turn], known[turn]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for shingles in shingle_sets(texts_of(part), size):
                    cls = class_of(shingles)
                    if not len(shingles) or cls in given:
                        continue
                    if len(given) >= REMEMBERED:
                        given.clear()
                    given.add(cls)
                    places, known = first_shingles(shingles)
                    own = np.uint64(cls & 0xFFFFFFFFFFFFFFFF)
                    route = np.where(known, mixed(places ^ own), places)  # a frequent shingle goes to many tasks
                    rows.append((places, route, known, np.full(len(places), cls), np.full(len(places), len(shingles))))
                if rows:
                    place, route, known, cls, n = map(np.concatenate, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(route.view(np.int64)), pa.array(known), pa.array(cls), pa.array(n)], ["place", "route", "frequent", "cls", "n"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows, one for each (place, cls) whose place has another class or is frequent. Holds a batch and one row."""
        held: list[np.ndarray] | None = None  # the last row, and whether its place has been given already
        for batch in batches:
            if not batch.num_rows:
                continue
            place, cls, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "cls", "n"))
            wide = batch.column("frequent").to_numpy(zero_copy_only=False)
            open_place = np.zeros(len(place), bool)
            if held is not None:
                place, cls, n, wide, open_place = (np.concatenate([h, x]) for h, x in zip(held, (place, cls, n, wide, open_place), strict=True))
            fresh = np.ones(len(place), bool)
            fresh[1:] = (place[1:] != place[:-1]) | (cls[1:] != cls[:-1])
            place, cls, n, wide, open_place = place[fresh], cls[fresh], n[fresh], wide[fresh], open_place[fresh]
            same = place[1:] == place[:-1]
            give = wide.copy()
            give[1:] |= same
            give[:-1] |= same
            give |= open_place
            new = give.copy()
            if open_place[0] and held is not None:
                new[0] = False  # went out with the batch before
            ahead = len(place) - 1
            held = [place[ahead:], cls[ahead:], n[ahead:], wide[ahead:], give[ahead:]]
            if new.any():
                yield pa.RecordBatch.from_arrays([pa.array(place[new]), pa.array(cls[new]), pa.array(n[new])], ["place", "cls", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "place long, route long, frequent boolean, cls long, n long")
    dealt = rows.repartition("route").sortWithinPartitions("place", "cls")
    return dealt.mapInArrow(shared, "place long, cls long, n long")


def _fits(a: str, b: str, t: Fraction) -> Column:
    return (F.least(a, b) * t.denominator) >= (F.greatest(a, b) * t.numerator)


class CountTree:
    """A packed R-tree over points of group counts; nodes keep the largest counts and smallest size below them."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, fanout: int = 16):
        self.order = np.lexsort((counts.argmax(axis=1), sizes))
        self.sizes, self.counts, self.fanout = sizes[self.order], counts[self.order], fanout
        self.levels = [(self.sizes, self.counts)]
        while len(self.levels[-1][0]) > fanout:
            low, high = self.levels[-1]
            starts = np.arange(0, len(low), fanout)
            self.levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def reaching(self, item: int, threshold: Fraction) -> np.ndarray:
        """The items after ``item`` in tree order whose overlap with it may be large enough."""
        size, counts = int(self.sizes[item]), self.counts[item]
        t, s = threshold.numerator, threshold.numerator + threshold.denominator
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[depth]
            nodes = nodes[(nodes + 1) * self.fanout**depth > item + 1]
            bound = np.minimum(high[nodes], counts).sum(axis=1)  # of sizes after item, the least possible is ``size``
            nodes = nodes[(bound * s >= t * (np.maximum(low[nodes], size) + size)) & (low[nodes] * t <= size * threshold.denominator)]
            if depth:
                nodes = (nodes[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return nodes[nodes > item]


def tree_pairs(rows: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) of classes of one place and of different labels that survive the bound. ``rows``: place, cls, n, label.

    Sizes of a pair are in the same band or in neighbouring ones, so the rows of a place meet by bands. A few rows are one leaf, whose
    pairs are left to ``within_bound``. More rows meet in a tree; where very many do, they are split into blocks and each two blocks meet.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(threshold.denominator / threshold.numerator)) + 1e-9).cast("int")
    by_band = rows.withColumn("band", band).withColumn("meets", F.explode(F.array("band", F.col("band") + 1)))
    sizes = by_band.groupBy("place", "meets").agg(F.count("*").alias("rows"), F.min("label").alias("first"), F.max("label").alias("last"), F.max("band").alias("top"))
    sizes = sizes.filter("first <> last and top = meets").select("place", "meets", "rows")
    met = stored(by_band.join(sizes, ["place", "meets"]).select("place", "meets", "rows", "cls", "n", "label", (F.col("band") < F.col("meets")).alias("guest")), "meeting-bands")
    leaves = met.filter(F.col("rows") <= LEAF_ROWS)
    x, y = leaves.alias("x"), leaves.alias("y")
    apart = (F.col("x.cls") < F.col("y.cls")) & (F.col("x.label") != F.col("y.label")) & ~(F.col("x.guest") & F.col("y.guest")) & _fits("x.n", "y.n", threshold)
    pairs = x.join(y, (F.col("x.place") == F.col("y.place")) & (F.col("x.meets") == F.col("y.meets")) & apart).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))

    many = met.filter(F.col("rows") > LEAF_ROWS).withColumn("blocks", F.ceil(F.col("rows") / TREE_ROWS).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("place", "meets", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "guest", "cls", "n", "label")
    many = many.join(_coarse(classes).drop("n"), "cls")

    def search(group: pa.Table) -> pa.Table:
        cls, n, label, own, guest = (group[c].to_numpy() for c in ("cls", "n", "label", "own", "guest"))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(cls) > 1 and not guest.all() and (label != label[0]).any():
            tree = CountTree(n, folded(group["counts"].to_pylist()))
            cls, label, own, guest = cls[tree.order], label[tree.order], own[tree.order], guest[tree.order]
            split = group["left"][0].as_py() != group["right"][0].as_py()
            for item in range(len(cls) - 1):
                found = tree.reaching(item, threshold)
                # guests met each other in their own band, and a block's own pairs in its own tree
                found = found[(label[found] != label[item]) & ~(guest[found] & guest[item]) & ((own[found] != own[item]) | (not split))]
                if len(found):
                    a.append(np.full(len(found), cls[item]))
                    b.append(cls[found])
        x, y = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    pairs = stored(pairs.union(many.groupBy("place", "meets", "left", "right").applyInArrow(search, "a long, b long")).distinct(), "tree-pairs")
    discard(met)
    return pairs


def _coarse(classes: DataFrame) -> DataFrame:
    """The classes with points of ``LEAST_GROUPS`` groups, so that rows of pairs and trees stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [p if groups_of(p) == LEAST_GROUPS else packed(folded([p], LEAST_GROUPS)[0]) for p in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array(points, pa.binary())], ["cls", "n", "counts"])

    return classes.select("cls", "n", "counts").mapInArrow(run, "cls long, n long, counts binary")


def star_pairs(met: DataFrame, turn: int, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) of a place's leader, another one each ``turn``, and each other class there whose size fits."""
    leader = F.min(F.struct(F.xxhash64(F.lit(turn), "cls").alias("turn"), "cls", "n")).alias("leader")
    leaders = met.groupBy("place").agg(leader).select("place", F.col("leader.cls").alias("lead"), F.col("leader.n").alias("lead_n"))
    pairs = met.join(leaders, "place").filter((F.col("cls") != F.col("lead")) & _fits("n", "lead_n", threshold))
    return pairs.select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b"))


def within_bound(pairs: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs whose summed coordinate minima are large enough for a link, by coarse points first, then by full ones."""
    t, s = threshold.numerator, threshold.numerator + threshold.denominator

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (folded(batch.column(c).to_pylist(), LEAST_GROUPS) for c in ("counts_a", "counts_b"))
                total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array(np.minimum(x, y).sum(axis=1, dtype=np.int64) * s >= t * total))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                points = zip(batch.column("counts_a").to_pylist(), batch.column("counts_b").to_pylist(), strict=True)
                good = np.fromiter((np.minimum(*folded(list(pair))).sum() for pair in points), np.int64, len(total)) * s >= t * total
                yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(good))

    def both(pairs: DataFrame, points: DataFrame) -> DataFrame:
        side = lambda k: points.select(F.col("cls").alias(k), F.col("n").alias(f"n_{k}"), F.col("counts").alias(f"counts_{k}"))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    # Each join is written before the next, so that the points that one shuffled are gone when the next one shuffles its own.
    likely = stored(both(pairs, _coarse(classes)).mapInArrow(coarse, "a long, b long"), "likely-pairs")
    found = stored(both(likely, classes).mapInArrow(full, "a long, b long, n_a long, n_b long"), "pairs")
    discard(likely)
    return found


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, threshold: Fraction) -> DataFrame:
    """Links (a, b): the pairs whose whole sets are similar enough."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", F.col("doc").alias("id")), "cls")
    needed = stored(needed, "needed-sets")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    side = F.broadcast(needed) if needed.count() <= BROADCAST_SETS else needed
    found = texts.join(side, texts["id"].eqNullSafe(needed["id"])).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                wanted = part.column("cls").to_pylist()
                sets = list(shingle_sets(texts_of(part), size))
                right = [i for i, s in enumerate(sets) if class_of(s) == wanted[i]]  # another row may have the same id
                yield pa.RecordBatch.from_arrays([pa.array([wanted[i] for i in right], pa.int64()), pa.array([sets[i].view(np.int64) for i in right], pa.list_(pa.int64()))], ["cls", "shingles"])

    whole = stored(found.mapInArrow(run, "cls long, shingles array<long>"), "sets")
    sets = whole.dropDuplicates(["cls"])
    side = lambda k: sets.select(F.col("cls").alias(k), F.col("shingles").alias(f"set_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    linked = (F.col("common") * (threshold.numerator + threshold.denominator)) >= ((F.col("n_a") + F.col("n_b")) * threshold.numerator)
    links = stored(both.filter(linked).select("a", "b"), "links")
    discard(whole, needed)
    return links


def distinct_places(met: DataFrame) -> DataFrame:
    """``met`` with one place of those where just the same classes meet."""
    who = [F.count("*").alias("rows"), F.bit_xor(F.xxhash64("cls")).alias("who"), F.bit_xor(F.xxhash64(F.lit("cls"), "cls")).alias("who_else")]
    chosen = met.groupBy("place").agg(*who).filter("rows > 1").groupBy("rows", "who", "who_else").agg(F.min("place").alias("place"))
    return met.join(chosen.select("place"), "place", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """(id, version, n_shingles, label, component): one row per document; component is the smallest id that links reach.

    ``version`` is a hash of the text; ``label`` tells components apart whatever their ids, and is null for empty sets.
    """
    profile = stored(profiles(docs, id_col, text_col, size), "profiles")
    members = profile.filter("n is not null").select("id", "version", "n", "cls", "counts")
    counted = profile.filter("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    frequent = [tuple(r) for r in counted.orderBy(F.desc("seen"), "shingle").limit(FREQUENT).collect()]
    least = max(8, members.count() // 1000)
    frequent = [(v, w) for v, w in frequent if w >= least]
    classes = stored(members.filter("n > 0").groupBy("cls").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("counts").alias("counts")), "classes")
    every = stored(meetings(docs, text_col, size, threshold, frequent), "meetings")
    met = stored(distinct_places(every), "places")
    discard(every)
    stars = reduce(DataFrame.union, (star_pairs(met, turn, threshold) for turn in range(LEADERS))).distinct()
    pairs = within_bound(stars, classes, threshold)
    links = verified(pairs, classes, docs, id_col, text_col, size, threshold)
    discard(pairs)
    labels = connected(links, "a", "b").withColumnsRenamed({"id": "cls", "component": "label"})
    rows = met.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    several = rows.groupBy("place").agg(F.count("*").alias("rows"), F.min("label").alias("first"), F.max("label").alias("last")).filter("rows > 2 and first <> last")
    rows = stored(rows.join(several.select("place"), "place", "left_semi"), "open-places")
    discard(met)
    trees = tree_pairs(rows, classes, threshold)
    discard(rows)
    pairs = within_bound(trees, classes, threshold)
    more = verified(pairs, classes, docs, id_col, text_col, size, threshold)
    discard(trees, pairs)
    labels = connected(links.union(more), "a", "b")
    joined = classes.join(labels.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "doc", F.coalesce("component", "cls").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("doc").alias("component"))
    of_class = joined.join(smallest, "label").select("cls", "label", "component")
    found = members.join(of_class, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return found.select("id", "version", F.col("n").alias("n_shingles"), "label", component.alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (null last); texts without words all stay."""
    found = stored(near_duplicates(docs, id_col, text_col, size, threshold), "near-duplicates")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "version")).alias("first")
    keepers = found.filter("label is not null").groupBy("label").agg(first).select("first.id", "first.version", F.lit(True).alias("single"))
    empty = found.filter("label is null").select("id", "version", F.lit(False).alias("single")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_version"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_version") == F.col("version"))
    kept = rows.join(keepers.union(empty), same)
    nth = F.row_number().over(Window.partitionBy("row_id", "row_version").orderBy("row_id"))
    return kept.withColumn("nth", nth).filter("nth = 1 or not single").select("row.*")

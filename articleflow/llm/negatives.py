"""Hard negatives: for an anchor and one of its positives, the best rows of other labels that score nearly as high.

A threshold join in the way of L2AP, made for a stated set of anchors. Anchors come in blocks, rows in tiles, and each pair of a block and
a tile is one group. In a group the dimensions go by falling energy; the inverted lists of a dimension hold only the rows that this and the later
dimensions could still lift to a threshold (rest norm of the row times rest norm of the anchor), which leaves the tail of every row
out of the index. Scores add up list by list; rows that no anchor can bring to its threshold by their rest norms leave the lists on the way. Candidates
that remain get the left-out tail added exactly. Thresholds begin high and are lowered for those anchors only whose windows are not full yet: the
positives of an anchor over ``LADDER``, the negatives of a positive over ``BANDS`` down to the end of the window. A window of ``k`` rows needs the best k of
each tile at most, so that nothing but those leaves a group.

Components become floor(scale * x); scores are integer inner products, exact while they are below 2**53 and computed with Python's integers beyond
(reported within the range of a long). Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of different lengths
meet as if the shorter one ended in zeros; an empty vector scores 0. Ties go to the smaller id, null ids last. Repeated rows are rows of their own: each is an anchor, a positive and a negative.
An empty table, or one without anchors, gives no row. Only the named columns are read, so others may be called as they like.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.llm.common import discard, ready, stored

#: Anchors in a block, rows in a tile and rows scored at a time.
BLOCK, TILE, SLICE = 2048, 8192, 2048
#: Thresholds for positives, as shares of the anchor's own norm squared; the last takes what there is.
LADDER = (0.7, 0.4, 0.2, None)
#: Lower ends of the windows tried in turn, as shares of the way from the positive's score down to the least one allowed.
BANDS = (0.25, 0.5, 1.0)
_STEP = 8
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _packed(vectors: pa.Array, scale: float) -> list[bytes]:
    """floor(scale * x) of each vector: a letter for the type, then the numbers, two bytes each where they fit."""
    out = []
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for first, last in zip(vectors.offsets.to_numpy()[:-1], vectors.offsets.to_numpy()[1:]):
        row = np.clip(np.floor(values[first:last] * scale), -1e300, 1e300)
        small = not len(row) or np.abs(row).max() < 1 << 15
        out.append(b"h" + row.astype("<i2").tobytes() if small else b"d" + row.astype("<f8").tobytes())
    return out


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(packed), width))
    for row, data in zip(out, packed):
        values = np.frombuffer(data, "<i2" if data[:1] == b"h" else "<f8", offset=1)
        row[: len(values)] = values
    return out


def _width(packed: list[bytes]) -> int:
    return max(((len(data) - 1) // (2 if data[:1] == b"h" else 8) for data in packed), default=1) or 1


def _rests(matrix: np.ndarray) -> np.ndarray:
    """Norms of the rows from each step of dimensions on, 0 at the end; a little too large, so that rounding drops nothing."""
    squares = np.add.reduceat(matrix**2, np.arange(0, matrix.shape[1], _STEP), axis=1)
    rest = np.concatenate([np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros((len(matrix), 1))], axis=1)
    return np.sqrt(rest) * (1 + 1e-9)


def _above(anchors: np.ndarray, rests: np.ndarray, least: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose score reaches the anchor's threshold, and perhaps some others."""
    row_rests = _rests(rows)
    steps = rests.shape[1] - 1
    # The index of a row ends where the rest of it can lift no anchor from nothing to its threshold.
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(least[:, None] > 0, rests / np.maximum(least, 1e-300)[:, None], np.inf).max(axis=0)
        indexed = (row_rests * reach >= 1) | np.isinf(reach)
    ends = np.where(indexed[:, :steps].any(axis=1), steps - np.argmax(indexed[:, :steps][:, ::-1], axis=1), 0)
    order = np.argsort(-ends, kind="stable")
    order = order[ends[order] > 0]
    scores = np.zeros((len(anchors), len(order)))
    for step in range(steps):
        count = int(np.searchsorted(-ends[order], -step, side="left"))
        if not count:
            break
        own = slice(step * _STEP, (step + 1) * _STEP)
        scores[:, :count] += anchors[:, own] @ rows[order[:count], own].T
        if step + 1 < steps and step % 2:
            best = (scores[:, :count] + rests[:, step + 1, None] * row_rests[order[:count], step + 1] >= least[:, None]).any(axis=0)
            if best.sum() < 0.7 * count:  # rows that no anchor can lift any more leave the lists
                keep = np.concatenate([best, np.ones(len(order) - count, bool)])
                order, scores = order[keep], scores[:, keep]
    stop = ends[order]
    a, r = np.nonzero(scores + rests[:, stop] * row_rests[order, stop] >= least[:, None])
    tail = np.zeros(len(a))
    for end in np.unique(stop[r]) if len(r) else ():
        if end < steps:
            some = np.flatnonzero(stop[r] == end)
            tail[some] = np.einsum("ij,ij->i", anchors[a[some], end * _STEP :], rows[order[r[some]], end * _STEP :])
    found = scores[a, r] + tail
    enough = found >= least[a]
    return a[enough], order[r[enough]], found[enough]


def _all_scores(anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same without thresholds, for numbers that floats can't add up exactly."""
    whole = np.array([[int(x) for x in row] for row in anchors], object).reshape(anchors.shape)
    scores = whole @ np.array([[int(x) for x in row] for row in rows], object).reshape(rows.shape).T
    a, r = np.indices(scores.shape).reshape(2, -1)
    return a, r, np.clip(scores.ravel(), -_LONG, _LONG)


def _best(window, score, ident, key, k) -> np.ndarray:
    """Places of the first k of each window: higher scores, then smaller ids."""
    order = np.lexsort((key, ident, -score, window))
    window = window[order]
    start = np.flatnonzero(np.append(True, window[1:] != window[:-1])) if len(window) else np.zeros(0, int)
    rank = np.arange(len(window)) - np.repeat(start, np.diff(np.append(start, len(window))))
    return order[rank < k]


_FOUND = "row long, mark long, id long, score long, other long"


def _search(windows: pa.Table, rows: pa.Table, same: bool, k: int) -> pa.Table:
    """The best k rows of a tile in each window of a block of anchors, among rows of the same label or among all others."""
    columns = lambda t, *names: (t.column(n).to_numpy() for n in names)
    w_row, w_label, w_low, w_high, w_mark = columns(windows, "row", "label", "low", "high", "mark")
    order = np.argsort(w_row, kind="stable")
    w_row, w_label, w_low, w_high, w_mark = (x[order] for x in (w_row, w_label, w_low, w_high, w_mark))
    a_row, first, count = np.unique(w_row, return_index=True, return_counts=True)
    least, a_label = (np.minimum.reduceat(w_low, first) if len(first) else w_low), w_label[first]
    r_row, r_label = columns(rows, "row", "label")
    r_id = rows.column("id").fill_null(_LONG).to_numpy()
    packed = windows.column("vector").take(pa.array(order[first])).to_pylist(), rows.column("vector").to_pylist()
    width = max(map(_width, packed))
    left, right = (_matrix(side, width) for side in packed)
    exact = (np.linalg.norm(left, axis=1).max(initial=0) * np.linalg.norm(right, axis=1).max(initial=0)) < _EXACT / 4
    if exact:
        energy = np.argsort(-(right**2).sum(axis=0), kind="stable")
        left, right = left[:, energy], right[:, energy]
        rests = _rests(left)
    got = []
    for label in np.unique(a_label):
        mine = np.flatnonzero(a_label == label)
        theirs = np.flatnonzero((r_label == label) == same)
        for at in range(0, len(theirs), SLICE):
            some = theirs[at : at + SLICE]
            if exact:
                a, r, score = _above(left[mine], rests[mine], least[mine], right[some])
            else:
                a, r, score = _all_scores(left[mine], right[some])
            a, r = mine[a], some[r]
            times = count[a]
            w = np.repeat(first[a] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            r, score = np.repeat(r, times), np.repeat(score, times)
            fits = ((score >= w_low[w]) & (score <= w_high[w])).astype(bool) & (w_row[w] != r_row[r])
            w, r, score = w[fits], r[fits], score[fits].astype(np.int64)
            best = _best(w, score, r_id[r], r_row[r], k)
            got.append((w[best], r[best], score[best]))
    w, r, score = (np.concatenate(part) for part in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
    best = _best(w, score, r_id[r], r_row[r], k)
    w, r, score = w[best], r[best], score[best]
    ids = pa.array(r_id[r], pa.int64(), mask=rows.column("id").is_null().to_numpy()[r])
    return pa.table({"row": w_row[w], "mark": w_mark[w], "id": ids, "score": score, "other": r_row[r]})


def _join(windows: DataFrame, rows: DataFrame, n_tiles: int, same: bool, k: int) -> DataFrame:
    """The best ``k`` rows, with their rank, in every window of an anchor (``row, label, vector, low, high``, and ``mark`` tells windows apart)."""
    n_blocks = -(-windows.count() // BLOCK)
    deal = lambda count: F.pmod(F.xxhash64("row"), F.lit(max(count, 1)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(max(count, 1) - 1)).cast("array<bigint>"))
    block = windows.withColumn("block", deal(n_blocks)).select("*", every(n_tiles).alias("tile"))
    tile = rows.toDF(*rows.columns).withColumn("tile", deal(n_tiles)).select("*", every(n_blocks).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, same, k)

    pairs = block.groupBy("block", "tile").cogroup(tile.groupBy("block", "tile")).applyInArrow(search, _FOUND)
    order = Window.partitionBy("row", "mark").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lowered(windows: DataFrame, lows: list[Column], points: DataFrame, n_tiles: int, same: bool, k: int) -> DataFrame:
    """The best ``k`` rows of every window, by lowering the threshold over ``lows`` for windows that aren't full; the last takes what there is."""
    kept = []
    for turn, low in enumerate(lows, 1):
        found = stored(_join(windows.withColumn("low", low.cast("double")), points, n_tiles, same, k), "in-windows")
        full = found.where(F.col("rank") == k).select("row", "mark")
        kept.append(found if turn == len(lows) else found.join(full, ["row", "mark"], "left_semi"))
        windows = windows.join(full, ["row", "mark"], "left_anti")
        if windows.isEmpty():
            break
    return reduce(DataFrame.unionByName, kept)


def hard_negatives(
    rows: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
    n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    The positives of an anchor are the first ``n_positives`` other rows of its label. Negatives are the first ``n_negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    spark = ready(rows.sparkSession)
    label = F.col("label") if label is None else label
    vector = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    picked = rows.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"), vector.alias("vector"), usable.alias("usable")
    ).where(F.col("usable") & F.col("label").isNotNull())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = _packed(batch.column("vector"), scale)
            norm = [float((_matrix([data], _width([data])) ** 2).sum()) for data in packed]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("id", "label", "is_anchor")), pa.array(packed, pa.binary()), pa.array(norm, pa.float64())],
                names=["id", "label", "is_anchor", "vector", "norm"],
            )

    quantised = picked.drop("usable").mapInArrow(pack, "id long, label long, is_anchor boolean, vector binary, norm double")
    # The number of a row is fixed as its table is written.
    points = stored(quantised.withColumn("row", F.monotonically_increasing_id()), "points")
    n_tiles = -(-points.count() // TILE)
    queries, others = points.where("is_anchor"), points.select("row", "id", "label", "vector")

    ends = [F.lit(-1e300) if share is None else share * F.col("norm") for share in LADDER]
    asked = queries.select("row", "label", "vector", "norm", F.lit(1e300).alias("high"), F.lit(0).cast("long").alias("mark"))
    chosen = _lowered(asked, ends, others, n_tiles, True, n_positives)
    pairs = chosen.select("row", F.col("id").alias("positive_id"), F.col("score").alias("mark")).join(queries.select("row", F.col("id").alias("anchor_id")), "row")
    pairs = stored(pairs, "positives")

    # One window per score of a positive; a positive that scores below zero has none.
    share_of = lambda percent: F.col("mark").cast("decimal(20,0)") * percent / 100
    wanted = pairs.select("row", "mark", F.ceil(share_of(low)).cast("double").alias("least"), F.floor(share_of(high)).cast("double").alias("high")).distinct()
    windows = queries.select("row", "label", "vector").join(wanted.where("least <= high"), "row")
    ends = [F.ceil(F.col("high") - share * (F.col("high") - F.col("least"))) if share < 1 else F.col("least") for share in BANDS]
    found = _lowered(windows, ends, others, n_tiles, False, n_negatives)
    mined = pairs.join(found, ["row", "mark"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("mark").alias("positive_score"), F.col("score").alias("negative_score")
    )
    discard(points)
    return mined

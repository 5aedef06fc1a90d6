"""Near duplicates among embeddings by lattice hashing.

In each of several tables a random projection takes a unit vector to blocks of eight coordinates, and each block to the nearest point of the E8
lattice; the points are the vector's home cell. A vector also probes the cells next to its home that it is nearest to. Whoever is at home
in a cell meets those at home there and those that probe it, and pairs are verified by their cosine in double precision. A pair that meets in
several places is counted at the first of them, told from the cells of both. Cells with many vectors are split into blocks of which
each two meet; what leaves a meeting is one row per linked vector (its links there and the local root), not the pairs.

With the parameters below a pair at a cosine of 0.95 is found with a probability of 0.97, one at 0.97 with 0.995, tighter ones nearly always (see the
tests). A cell holds about one in 30,000 of unrelated vectors per table; for far more vectors take more ``blocks`` and ``tables``.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths don't
link; equal vectors are one class and all link with each other; rows that repeat an id are vectors of their own; a null id is the smallest of
a component only if no other is there; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.llm.common import stored
from articleflow.llm.components import connected
from articleflow.llm.words import mixed

#: Rows of a cell that meet in one task.
CELL_ROWS = 1024


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    out = np.zeros((len(whole), 8))
    for row, (i, j, a, b) in zip(out, whole, strict=True):
        row[i], row[j] = a, b
    signs = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([out, signs[(signs < 0).sum(axis=1) % 2 == 0]])


STEPS = _shortest()


def _nearest_even(points: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    near = np.rint(points)
    off = points - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_point(points: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight coordinates."""
    whole, half = _nearest_even(points), _nearest_even(points - 0.5) + 0.5
    closer = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@dataclass(frozen=True)
class LatticeIndex:
    tables: int = 4
    blocks: int = 2
    probes: int = 4
    scale: float = 0.75
    seed: int = 20240229

    @property
    def cells(self) -> int:
        """Cells of a vector: for each table its home and then the probed ones."""
        return self.tables * (1 + self.probes)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Cell numbers of unit vectors, of shape (vectors, cells)."""
        width = unit.shape[1]
        rng = np.random.default_rng([self.seed, width])
        out = []
        for table in range(self.tables):
            axes = rng.normal(size=(width, 8 * self.blocks)) / np.sqrt(width)
            if width >= 8 * self.blocks:
                axes = np.linalg.qr(axes)[0]
            points = unit @ axes * (np.sqrt(width / 8) / self.scale)
            homes = [nearest_point(points[:, 8 * b : 8 * b + 8]) for b in range(self.blocks)]
            further = np.concatenate([2 - 2 * (points[:, 8 * b : 8 * b + 8] - homes[b]) @ STEPS.T for b in range(self.blocks)], axis=1)
            chosen = np.argsort(further, axis=1, kind="stable")[:, : self.probes]
            home = np.stack(homes, axis=1)
            out.append(self._numbers(home, table))
            for k in range(self.probes):
                moved = home.copy()
                moved[np.arange(len(unit)), chosen[:, k] // len(STEPS)] += STEPS[chosen[:, k] % len(STEPS)]
                out.append(self._numbers(moved, table))
        return np.stack(out, axis=1)

    def _numbers(self, points: np.ndarray, table: int) -> np.ndarray:
        number = np.full(len(points), table + 1, np.uint64)
        for column in (points.reshape(len(points), -1) * 2).astype(np.int64).view(np.uint64).T:
            number = mixed(number) + column
        return mixed(number).view(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def coded(vectors: DataFrame, index: LatticeIndex, id_col: str, vector_col: str) -> DataFrame:
    """(id, cls, vector, cells): a class is all equal vectors; null for vectors that link with nothing."""
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("cls", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("cells", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array([np.nan if x is None else x for x in v] if v else [np.nan]) for v in batch.column("vector").to_pylist()]
            cls: list[int | None] = [None] * len(rows)
            data: list[bytes | None] = [None] * len(rows)
            cells: list[np.ndarray | None] = [None] * len(rows)
            good = [i for i, v in enumerate(rows) if np.isfinite(v).all() and v.any()]
            for width in {len(rows[i]) for i in good}:
                same = [i for i in good if len(rows[i]) == width]
                units = np.stack([rows[i] for i in same]) + 0.0  # -0.0 becomes 0.0
                for i, vector, numbers in zip(same, units, index.codes(_unit(units)), strict=True):
                    data[i], cells[i] = vector.astype("<f8").tobytes(), numbers
                    cls[i] = xxhash.xxh3_64_intdigest(data[i]) - (1 << 63)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cls, pa.int64()), pa.array(data, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], schema.names)

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(run, schema)


def _met_before(u: np.ndarray, v: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Whether pairs with cells u and v meet in a table before ``table``."""
    met = np.zeros(len(u), bool)
    for t in range(table):
        home = t * (1 + probes)
        met |= u[:, home] == v[:, home]
        for k in range(home + 1, home + 1 + probes):
            met |= (u[:, k] == v[:, home]) | (v[:, k] == u[:, home])
    return met


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each index is linked with, over any number of links."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(coded_rows: DataFrame, index: LatticeIndex, threshold: float) -> DataFrame:
    """(cls, links, root): for each meeting, the linked classes, their linked vectors counted there, and a class they are linked with."""
    classes = coded_rows.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("cells").alias("cells"))
    classes = stored(classes, "vector-classes")
    width = 1 + index.probes
    rows = classes.select("cls", F.posexplode("cells").alias("pos", "cell"))
    home = F.col("pos") % width == 0
    met = rows.groupBy("cell").agg(F.count("*").alias("rows"), F.count_if(home).alias("homes")).filter("rows > 1 and homes > 0")
    blocks = met.select("cell", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    pairs = rows.join(blocks, "cell").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("cell", "cls", "pos", "own", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"))
    probes = index.probes

    def meet(group: pa.Table) -> pa.Table:
        cls, pos, own, copies = (group[c].to_numpy() for c in ("cls", "pos", "own", "copies"))
        cells = group["cells"].combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
        lengths = np.array([len(v.as_py()) for v in group["vector"]])
        table = int(pos[0]) // (1 + probes)
        split = group["left"][0].as_py() != group["right"][0].as_py()
        sums, ends = np.zeros(len(cls), np.int64), []
        for size in np.unique(lengths):
            same = np.flatnonzero(lengths == size)
            vectors = _unit(np.frombuffer(b"".join(group["vector"].take(pa.array(same)).to_pylist()), "<f8").reshape(len(same), -1))
            at_home = same[pos[same] % (1 + probes) == 0]
            here = np.searchsorted(same, at_home)
            x, y = np.nonzero(vectors @ vectors[here].T >= threshold)
            u, v = same[x], at_home[y]
            both = pos[u] % (1 + probes) == 0
            keep = (cls[u] != cls[v]) & (~both | (cls[u] < cls[v]))
            if split:
                keep &= own[u] != own[v]
            u, v, both = u[keep], v[keep], both[keep]
            start = table * (1 + probes)
            # a probe that is also probed by the one at home counts at the home of the smaller class
            mutual = (cells[v][:, start + 1 : start + 1 + probes] == cells[u][:, start : start + 1]).any(axis=1)
            keep = ~_met_before(cells[u], cells[v], table, probes) & (both | ~mutual | (cls[v] < cls[u]))
            u, v = u[keep], v[keep]
            np.add.at(sums, u, copies[v])
            np.add.at(sums, v, copies[u])
            ends.append((u, v))
        a, b = (np.concatenate(e) if ends else np.zeros(0, np.int64) for e in zip(*ends, strict=True))
        root = _roots(len(cls), a, b)
        some = sums > 0
        return pa.table({"cls": cls[some], "links": sums[some], "root": cls[root[some]]})

    full = pairs.join(classes, "cls")
    return full.groupBy("cell", "left", "right").applyInArrow(meet, "cls long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, index: LatticeIndex = LatticeIndex()) -> DataFrame:
    """(id, n_links, component): one row per vector; component is the smallest id that links reach."""
    rows = stored(coded(vectors, index, id_col, vector_col), "coded-vectors")
    found = stored(linked(rows, index, threshold), "vector-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = connected(found, "cls", "root").withColumnsRenamed({"id": "cls", "component": "label"})
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    joined = classes.join(links, "cls", "left").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    joined = stored(joined, "linked-classes")
    smallest = joined.groupBy("label").agg(F.min("first").alias("component"))
    of_class = joined.join(smallest, "label").select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    out = rows.select("id", "cls").join(of_class, "cls", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))

"""What the operators share: their tables, stored steps and reading of texts inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.session import materialize, prepare, shared_dir

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> SparkSession:
    """The session, with this package on its workers and small batches."""
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@contextmanager
def _freeing_shuffles(spark: SparkSession):
    """Shuffle files of a step go as soon as its table is written."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written below spark.checkpoint.dir and read back: cuts the lineage, computes Python steps once."""
    path = shared_dir(df.sparkSession, name)
    with _freeing_shuffles(df.sparkSession):
        table = materialize(df, path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote, once all that reads them has been written too."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The texts of a batch as 64-bit-offset strings; null is the empty text."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text begins and ends in them."""
    count = len(texts)
    if not count:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, count + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, most: int = 1 << 21, name: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of text, so that work arrays stay small; a longer text is a piece of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last

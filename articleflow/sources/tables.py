"""Stored tables: scans, lookups, appends and the day-partitioned layout of the clean table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from articleflow.operators.query import DAY_COLUMN, effective_at
from articleflow.schemas import FETCH_RUNS


def raw_scan(raw: DataFrame, *, status: str | None = None, limit: int | None = None) -> DataFrame:
    rows = (raw.where(F.col("status") == status) if status else raw).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def by_id(table: DataFrame, row_id: int) -> DataFrame:
    """One row or none; the id bound reaches the Parquet row-group statistics."""
    return table.where(F.col("id") == row_id)


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(limit)


def to_fetch_runs(stats: DataFrame, runs: DataFrame, started_at, finished_at) -> DataFrame:
    """Statistics of a fetch as rows to append to ``fetch_runs``: one per source and method, a few at most."""
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    number = F.row_number().over(Window.orderBy("source_name", "collection_method"))
    numbered = stats.withColumns(
        {"id": (last + number).cast("long"), "started_at": F.lit(started_at), "finished_at": F.lit(finished_at)}
    )
    return numbered.select(*FETCH_RUNS.names)


def write_part(rows: DataFrame, path: str, part: int) -> None:
    """Store one batch of an append-only table under its own number; writing it again replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/part={part}")


def read_parts(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """An append-only table, or what it held before batch ``before``; empty when nothing was stored."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.LongType())])).parquet(path)
    if before is not None:
        rows = rows.where(F.col("part") < before)
    return rows.select(*schema.names)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def write_clean(clean: DataFrame, path: str) -> None:
    """Store clean articles by effective day, so that date filters skip whole folders.

    The rebalance hint splits days that are much larger than others and joins small ones into sound files.
    """
    days = clean.withColumn(DAY_COLUMN, F.to_date(effective_at()))
    days.hint("rebalance", DAY_COLUMN).write.mode("overwrite").partitionBy(DAY_COLUMN).parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The stored clean table; ``effective_day`` stays visible for pruning."""
    return spark.read.parquet(path)

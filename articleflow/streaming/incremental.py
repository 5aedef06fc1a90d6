"""Repeated runs as Structured Streaming jobs: each takes what is new since the last and may be replayed."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from articleflow.operators import blocks
from articleflow.operators.blocks import WIDTH
from articleflow.operators.cleaning import build_clean_rows, cleanable
from articleflow.operators.ingest import RAW_KEY
from articleflow.operators.merge import invalid_marks, merge_counts, skip_inserts, skip_winners
from articleflow.operators.numbering import number_rows
from articleflow.schemas import CLEAN_ARTICLES, RAW_ARTICLES
from articleflow.session import remove, scratch
from articleflow.sources.tables import read_parts, write_part

# Folders beside a streamed table.
REJECTS, CONFLICTS, COUNTS, IDS = "-rejects", "-conflicts", "-counts", "-ids"
DAY_COUNTS = T.StructType([T.StructField("day", T.DateType()), T.StructField("n", T.LongType())])
SEEN_URLS = T.StructType([T.StructField("source_name", T.StringType()), T.StructField("canonical_url", T.StringType())])


LAST_ID = T.StructType([T.StructField("id", T.LongType())])
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_SEEN = T.StructType([T.StructField("seen", T.BooleanType())])


def _first_unseen(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The row of a source and URL that came first, if the key is new; the state of a key is one flag."""
    if state.exists:
        return
    first = None
    for part in parts:
        row = part.loc[[part["seq"].idxmin()]]
        first = row if first is None or row["seq"].iloc[0] < first["seq"].iloc[0] else first
    state.update((True,))
    yield first


def stream_raw(rows: DataFrame, raw_path: str, checkpoint: str) -> StreamingQuery:
    """Append unseen raw rows (``to_raw_rows`` output), first per source and URL.

    Keys seen so far are state in RocksDB, without a watermark, so none is forgotten and a batch costs what is in it: the rows of earlier batches are
    not read again. A batch is stored under its number, after the last id of the batch before, which is a table of one row; a replay writes the same rows again.
    """
    unseen = (
        rows.where("storable").groupBy(*RAW_KEY)
        .applyInPandasWithState(_first_unseen, rows.schema, _SEEN, "append", GroupStateTimeout.NoTimeout)
    )

    def insert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scratch(spark) as put:
            new = put(batch, "raw-batch")
            before = spark.read.schema(LAST_ID).parquet(f"{raw_path}{IDS}/part={number - 1}").first()[0] if number else 0
            numbered = number_rows(new.select("seq", *RAW_KEY), "seq", "_nth", ties=RAW_KEY).withColumn("id", F.lit(before) + F.col("_nth"))
            write_part(new.join(numbered, ["seq", *RAW_KEY]).select(*RAW_ARTICLES.names), raw_path, number)
            write_part(new.agg((F.lit(before) + F.count("*")).alias("id")), raw_path + IDS, number)
        if number > 1:
            remove(spark, f"{raw_path}{IDS}/part={number - 2}")

    return _run(unseen, insert, checkpoint, ROCKSDB)


def stream_clean(raw: DataFrame, clean_path: str, checkpoint: str, *, policy: str = "skip", width: int = WIDTH) -> StreamingQuery:
    """Clean newly arrived raw rows and merge them.

    ``skip`` only adds rows, so a batch is an append. ``upsert`` changes rows: the table is one in blocks of ``width`` ids, and a batch
    rewrites the blocks it touches (read it with ``upserted``).

    Beside the table, each batch stores its rejects (``id, status, error_message``, to mark raw rows with), its
    counts by outcome and, for an upsert, the URLs it left alone: read them with ``batch_rejects`` and so on.
    """

    def merge_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scratch(spark) as put:
            built = put(build_clean_rows(cleanable(batch)), "clean-batch")
            usable = built.where(F.col("reject_reason").isNull()).drop("reject_reason")
            if policy == "skip":
                target = read_parts(spark, clean_path, CLEAN_ARTICLES, number)
                decided = put(skip_winners(usable, target), "winners")
                write_part(skip_inserts(usable, target, decided), clean_path, number)
                stats = merge_counts(usable, target, policy, decided)
            else:
                outcome = blocks.merge(upserted_table(spark, clean_path, width), usable, run=f"part={number}")
                write_part(outcome.conflicts, clean_path + CONFLICTS, number)
                stats = outcome.stats
            write_part(invalid_marks(built), clean_path + REJECTS, number)
            invalid = built.agg(F.count_if(F.col("reject_reason").isNotNull())).scalar()
            write_part(stats.withColumn("invalid", invalid), clean_path + COUNTS, number)

    return _run(raw, merge_batch, checkpoint)


def upserted_table(spark: SparkSession, clean_path: str, width: int = WIDTH) -> blocks.BlockTable:
    return blocks.BlockTable(spark, clean_path, CLEAN_ARTICLES, width)


def upserted(spark: SparkSession, clean_path: str) -> DataFrame:
    """The table that upserting batches have written so far."""
    return upserted_table(spark, clean_path).read()


def batch_rejects(spark: SparkSession, clean_path: str) -> DataFrame:
    """Marks for the raw rows that could not be cleaned, of all batches."""
    return spark.read.parquet(clean_path + REJECTS).drop("part")


def batch_conflicts(spark: SparkSession, clean_path: str) -> DataFrame:
    """What upserts left alone, with the batch it came in."""
    return spark.read.parquet(clean_path + CONFLICTS)


def batch_counts(spark: SparkSession, clean_path: str) -> DataFrame:
    """Counts by outcome, one row for each batch (``part``)."""
    return spark.read.parquet(clean_path + COUNTS)


def stream_daily_trend(stream: DataFrame, path: str, checkpoint: str, *, moment: str = "collected_at") -> StreamingQuery:
    """Counts per day of each batch, stored under its number: days stay open, so late rows correct them."""

    def count(batch: DataFrame, number: int) -> None:
        write_part(batch.groupBy(F.to_date(moment).alias("day")).agg(F.count("*").alias("n")), path, number)

    return _run(stream, count, checkpoint)


def daily_trend(spark: SparkSession, path: str) -> DataFrame:
    """Articles per day over all batches so far; rows without a moment are on no day."""
    parts = read_parts(spark, path, DAY_COUNTS)
    return parts.where(F.col("day").isNotNull()).groupBy("day").agg(F.sum("n").alias("n"))


def stream_distinct_urls(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Sources and URLs not seen in any batch before, kept for good: no watermark forgets them, and no batch reads earlier ones."""
    unseen = stream.select("source_name", "canonical_url").dropDuplicates()
    return _run(unseen, lambda batch, number: write_part(batch, path, number), checkpoint, ROCKSDB)


def distinct_urls(spark: SparkSession, path: str) -> DataFrame:
    """One row per source and URL of all batches so far."""
    return read_parts(spark, path, SEEN_URLS)


def _run(stream: DataFrame, step, checkpoint: str, settings: dict[str, str] | None = None) -> StreamingQuery:
    """Start a query that ends when all there is has been taken; ``settings`` hold for it alone, which has them from its start."""
    conf = stream.sparkSession.conf
    before = {key: conf.get(key, None) for key in settings or {}}
    for key, value in (settings or {}).items():
        conf.set(key, value)
    try:
        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)

"""Stored tables in blocks of consecutive ids: a keyed change rewrites the blocks it touches and leaves the other files as they are.

A block is a folder ``block=N`` with the ids from ``N * width`` on. New rows have the highest ids, so inserts go to the last blocks. What
to change is decided on key columns; then the texts of touched blocks are read, changed and put in the place of the old ones by dynamic
partition overwrite, which leaves no older version behind. Decisions of a named run are stored with the ids they give, and a run that comes again goes
by them: a job that died between two blocks ends in the same table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.operators.merge import (
    _empty_summary, merge_counts, skip_winners, update_raw_status, update_summaries, upsert_conflicts, upsert_decisions,
)
from articleflow.operators.numbering import number_rows
from articleflow.schemas import CLEAN_ARTICLES, CONTENT_COLUMNS, DUPLICATE_POLICIES, SUMMARY_COLUMNS
from articleflow.session import folders, freed_shuffles, is_complete, materialize, remove, scratch, shared_dir

WIDTH = 1 << 20
BLOCK = "block"


@dataclass(frozen=True)
class BlockTable:
    """A table of ``schema`` below ``path``; ``width``, the ids of a block, must stay the same for the life of the table."""

    spark: SparkSession
    path: str
    schema: T.StructType = CLEAN_ARTICLES
    width: int = WIDTH

    def block_of(self) -> Column:
        """The block of a row's id."""
        return F.expr(f"id div {self.width}").cast("long").alias(BLOCK)

    def blocks(self) -> list[int]:
        """The blocks that are stored."""
        return sorted(int(name.removeprefix(f"{BLOCK}=")) for name in folders(self.spark, self.path) if name.startswith(f"{BLOCK}="))

    def read(self, blocks: list[int] | None = None) -> DataFrame:
        """The table, or only some blocks of it: the others' folders are not opened."""
        if not self.blocks():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BLOCK, T.LongType())])).parquet(self.path)
        if blocks is not None:
            rows = rows.where(F.col(BLOCK).isin(blocks))
        return rows.select(*self.schema.names)

    def by_id(self, row_id: int) -> DataFrame:
        """One row or none, from one block."""
        return self.read([row_id // self.width]).where(F.col("id") == row_id)

    def last_id(self) -> int:
        """The largest id, from the last block that holds rows."""
        for block in reversed(self.blocks()):
            last = self.read([block]).agg(F.max("id")).first()[0]
            if last is not None:
                return last
        return 0

    def replace(self, rows: DataFrame) -> None:
        """Put ``rows`` in the place of all blocks they fall in. The rebalance hint gives sound files, of large blocks several."""
        placed = rows.select(*self.schema.names).withColumn(BLOCK, self.block_of())
        with freed_shuffles(self.spark):
            placed.hint("rebalance", BLOCK).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BLOCK).parquet(self.path)

    def change(self, ids: DataFrame, step: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrite the blocks that ``ids`` fall in with what ``step`` makes of their rows; ids of blocks that aren't there yet may come with it.

        The numbers of touched blocks come to the driver, as the folders of a table do when it is read.
        """
        touched = sorted(row[0] for row in ids.select(self.block_of()).distinct().collect() if row[0] is not None)
        if touched:
            self.replace(step(self.read(touched)))
        return touched


def store(rows: DataFrame, path: str, width: int = WIDTH) -> BlockTable:
    """Write ``rows`` (with ids) as a new table in blocks."""
    table = BlockTable(rows.sparkSession, path, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]), width)
    table.replace(rows)
    return table


@dataclass(frozen=True)
class MergeOutcome:
    """Which blocks a merge wrote, its counts (one row), and the batch rows an upsert left alone."""

    touched: list[int]
    stats: DataFrame
    conflicts: DataFrame | None


def decide(batch: DataFrame, keys: DataFrame, policy: str, last_id: int) -> DataFrame:
    """``upsert_decisions`` (or the like for ``skip``) with the ``id`` that each inserted or updated row gets; ``keys`` are ``id, raw_id, url`` of the table."""
    with scratch(batch.sparkSession) as put:
        if policy == "skip":
            new = put(skip_winners(batch, keys), "winners").select(F.col("raw_id").alias("first_raw"), F.col("raw_id").alias("last_raw"), F.lit("insert").alias("action"))
            decided = new.withColumn("target_id", F.lit(None).cast("long"))
        else:
            decided = put(upsert_decisions(batch, keys), "decisions")
        inserts = number_rows(decided.where(F.col("action") == "insert").select("first_raw"), "first_raw", "_nth")
        ids = decided.join(inserts, "first_raw", "left").withColumn("id", F.coalesce("target_id", F.lit(last_id) + F.col("_nth"))).drop("_nth")
        return put.keep(ids, "changes")


def merge(table: BlockTable, batch: DataFrame, *, policy: str = "upsert", run: str | None = None) -> MergeOutcome:
    """Merge cleaned rows into a stored table; its other blocks are neither read for their texts nor written.

    ``run`` names a run that may be repeated: its decisions are kept beside the table (``path-changes``) until the next run of that kind.
    A stored summary is kept, as in ``merge_upsert``. ``batch`` is read several times, so hand in a stored table where it is costly to compute.
    """
    if policy not in DUPLICATE_POLICIES:
        raise ValueError(f"duplicate policy must be one of {DUPLICATE_POLICIES}: {policy!r}")
    spark = table.spark
    kept = None if run is None else f"{table.path}-changes/{run}"
    if kept is not None and is_complete(spark, kept):
        decided = spark.read.parquet(kept)
    else:
        decided = decide(batch, table.read().select("id", "raw_id", "url"), policy, table.last_id())
        if kept is not None:
            decided = materialize(decided, kept)
            for other in folders(spark, f"{table.path}-changes"):
                if other != run:
                    remove(spark, f"{table.path}-changes/{other}")

    changes = decided.where(F.col("action") != "conflict").select("id", F.col("last_raw").alias("raw_id"))
    content = batch.select(*CONTENT_COLUMNS).join(changes, "raw_id")

    def merged(old: DataFrame) -> DataFrame:
        rows = old.alias("o").join(content.alias("n"), "id", "full_outer")
        new = F.col("n.raw_id").isNotNull()
        return rows.select(
            "id", *[F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in CONTENT_COLUMNS], *[F.col(f"o.{c}") for c in SUMMARY_COLUMNS]
        )

    touched = table.change(changes, merged)
    # Counts go by the decisions alone, whatever is in the table by now.
    if policy == "skip":
        stats = merge_counts(batch, batch.limit(0), "skip", decided.select(F.col("last_raw").alias("raw_id")))
        return MergeOutcome(touched, stats, None)
    return MergeOutcome(touched, merge_counts(batch, batch, "upsert", decided), upsert_conflicts(batch, decided))


def write_summaries(table: BlockTable, summaries: DataFrame) -> list[int]:
    """``update_summaries`` on a stored table; gives the blocks that were rewritten."""
    return table.change(summaries, lambda old: update_summaries(old, summaries))


def write_status(table: BlockTable, marks: DataFrame) -> list[int]:
    """``update_raw_status`` on a stored raw table; gives the blocks that were rewritten."""
    return table.change(marks, lambda old: update_raw_status(old, marks))

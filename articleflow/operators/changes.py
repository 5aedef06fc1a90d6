"""A report over a table that changes: signed counts per run that add up to the numbers of the table.

Beside a table in blocks lie its *facts*, one narrow row per article (labels, days, whether there is a body and a summary), in blocks of ids too. A run of changes
takes the old facts of the touched ids away and adds the new ones, and only their counts are kept. The texts of the table are never read;
the bodies of a batch are looked at once, when its facts are made.

A run is stored step by step: its moves (old and new facts), the facts with the moves, its counts. A run that died anywhere may come again under
its name and goes on where it stopped; one whose counts are there changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.functions.text import filled, is_blank
from articleflow.operators.blocks import WIDTH, BlockTable
from articleflow.operators.query import effective_at
from articleflow.schemas import UNKNOWN
from articleflow.session import folders, freed_shuffles, is_complete, remove

_KEYS = ("category", "source", "day", "effective_day")
_FLAGS = ("has_body", "has_summary")
FACTS = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in _KEYS[:2]]
    + [T.StructField(name, T.DateType()) for name in _KEYS[2:]]
    + [T.StructField(name, T.BooleanType()) for name in _FLAGS]
)
COUNTS = ("clean_count", "body_count", "summarized_count")


def facts(articles: DataFrame, key: str = "id", *extra: str) -> DataFrame:
    """What a report counts of an article, beside ``extra`` columns; articles of a batch have no summary yet."""
    summary = ~is_blank("summary") if "summary" in articles.columns else F.lit(False)
    day = F.to_date(F.coalesce("collected_at", "published_at"))
    return articles.select(
        F.col(key).cast("long").alias(key), *extra, filled("category").alias("category"), filled("source").alias("source"), day.alias("day"),
        F.to_date(effective_at()).alias("effective_day"), (~is_blank("body")).alias("has_body"), summary.alias("has_summary"),
    )


def _summed(rows: DataFrame, sign: Column) -> DataFrame:
    counted = [sign, F.when(F.col("has_body"), sign).otherwise(0), F.when(F.col("has_summary"), sign).otherwise(0)]
    return rows.groupBy(*_KEYS).agg(*[F.sum(c).cast("long").alias(name) for c, name in zip(counted, COUNTS)])


@dataclass(frozen=True)
class ChangingReport:
    """Facts and signed counts below ``path``; ``width`` is that of the facts' blocks."""

    spark: SparkSession
    path: str
    width: int = WIDTH

    @property
    def _facts(self) -> BlockTable:
        return BlockTable(self.spark, f"{self.path}/facts", FACTS, self.width)

    def begin(self, clean: DataFrame) -> None:
        """Take the facts of a table as it is; the only pass over its texts."""
        self.begin_with(facts(clean))

    def begin_with(self, known: DataFrame) -> None:
        """``begin`` from facts that are there already."""
        self._facts.replace(known)
        self._write(_summed(self._facts.read(), F.lit(1)), "counts/run=begin")

    def follow_merge(self, decisions: DataFrame, batch: DataFrame, run: str) -> None:
        """Count what a merge did: ``decisions`` are those of ``blocks.decide`` (or of a stored run of ``blocks.merge``), ``batch`` its rows.

        An updated article takes the labels, dates and body of its last row in the batch and keeps its summary.
        """
        changed = decisions.where(F.col("action") != "conflict").select("id", F.col("last_raw").alias("raw_id"))
        new = facts(batch.select("raw_id", "category", "source", "published_at", "collected_at", "body"), "raw_id").join(changed, "raw_id").drop("raw_id", "has_summary")
        self._follow(new, run)

    def follow_summaries(self, summaries: DataFrame, run: str) -> None:
        """Count summaries (``id, summary``) that were written; a NULL one leaves an article as it is."""
        new = summaries.where(F.col("summary").isNotNull()).select("id", (~is_blank("summary")).alias("has_summary"))
        self._follow(new, run, inserts=False)

    def _follow(self, new: DataFrame, run: str, inserts: bool = True) -> None:
        for other in folders(self.spark, f"{self.path}/moves"):
            if other != f"run={run}" and not is_complete(self.spark, f"{self.path}/counts/{other}"):
                raise ValueError(f"{other} did not come to its end: repeat it first")
            if other != f"run={run}":
                remove(self.spark, f"{self.path}/moves/{other}")
        counts, kept = f"counts/run={run}", f"moves/run={run}"
        if is_complete(self.spark, f"{self.path}/{counts}"):
            return
        if not is_complete(self.spark, f"{self.path}/{kept}"):
            touched = sorted(row[0] for row in new.select(self._facts.block_of()).distinct().collect() if row[0] is not None)
            old = self._facts.read(touched).alias("o")
            joined = old.join(new.alias("n"), "id", "right" if inserts else "inner")
            names = [f.name for f in FACTS if f.name != "id"]
            kept_value = {name: F.coalesce(F.col(f"o.{name}"), F.lit(False)) if name in _FLAGS else F.col(f"o.{name}") for name in names}
            value = {name: F.col(f"n.{name}") if name in new.columns else kept_value[name] for name in names}
            # Of an article without facts so far there is nothing to take away; has_body is never NULL otherwise.
            before = F.when(F.col("o.has_body").isNotNull(), F.struct(*[F.col(f"o.{name}").alias(name) for name in names]))
            self._write(joined.select("id", before.alias("old"), F.struct(*[value[name].alias(name) for name in names]).alias("new")), kept)
        moves = self.spark.read.parquet(f"{self.path}/{kept}")
        after = moves.select("id", "new.*")
        self._facts.change(after, lambda stored: stored.join(after, "id", "left_anti").unionByName(after))
        signed = moves.select(F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("new").alias("fact")), F.struct(F.lit(-1).alias("sign"), F.col("old").alias("fact")))).alias("m"))
        signed = signed.select("m.sign", "m.fact.*").where(F.col("has_body").isNotNull())
        self._write(_summed(signed, F.col("sign")), counts)
        remove(self.spark, f"{self.path}/{kept}")

    def _write(self, rows: DataFrame, name: str) -> None:
        with freed_shuffles(self.spark):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def cube(self, *, date_from: str | None = None, date_to: str | None = None, category: str | None = None) -> DataFrame:
        """``report_cube`` of the table as it is now, out of the counts of all runs; filters as there, by whole days."""
        runs = [f"{self.path}/counts/{name}" for name in folders(self.spark, f"{self.path}/counts") if is_complete(self.spark, f"{self.path}/counts/{name}")]
        rows = self.spark.read.parquet(*runs)
        if date_from:
            rows = rows.where(F.col("effective_day") >= F.lit(date_from).cast("date"))
        if date_to:
            rows = rows.where(F.col("effective_day") <= F.lit(date_to).cast("date"))
        if category:
            rows = rows.where(F.col("category") == category)
        labels = [F.coalesce(F.col(name), F.lit(UNKNOWN)).alias(name) for name in ("category", "source")]
        return rows.groupBy(*labels, "day").agg(*[F.sum(name).alias(name) for name in COUNTS]).where(F.col("clean_count") != 0)

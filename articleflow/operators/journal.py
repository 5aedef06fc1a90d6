"""Model calls that survive a lost job: finished calls are written down as their tasks end, and a run that comes again makes only the others.

A journal is a table of replies by request, the SHA-256 of model, system text, row key and prompt. Open requests are dealt to tasks of at most ``per_task``
calls; every task that ends puts its replies into the journal at once (the committer moves files task by task), so that a job that dies loses the calls of its
running tasks only. Calls that failed are written down too, but made again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.operators.completion import Client, with_completion
from articleflow.sources.tables import exists

JOURNAL = T.StructType(
    [
        T.StructField("request", T.StringType()),
        T.StructField("reply", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("called_at", T.TimestampType()),
    ]
)
PER_TASK = 64
MOST_TASKS = 20_000


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All calls that were written down; a request may be there more than once."""
    return spark.read.schema(JOURNAL).parquet(path) if exists(spark, path) else spark.createDataFrame([], JOURNAL)


def with_journal(
    rows: DataFrame, factory: Callable[[], Client], path: str, *, system: str, prompt: str = "prompt", key: str = "id",
    json_mode: bool = False, model: str = "", per_task: int = PER_TASK,
) -> DataFrame:
    """``with_completion`` by way of a journal: ``reply``, ``error`` and ``called_at`` beside every row.

    Calls are made here, when the function runs, and only for requests without a reply. A task has ``per_task`` calls, more only
    where there would be over ``MOST_TASKS`` tasks. Equal rows (same key and prompt) share a call.
    """
    spark = rows.sparkSession
    parts = [F.lit(model), F.lit(system), F.lit(str(json_mode)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(prompt), F.lit(""))]
    request = F.sha2(F.concat_ws("\u0000", *parts), 256)
    asked = rows.withColumn("request", request)

    finished = read_journal(spark, path).where(F.col("error").isNull()).select("request").distinct()
    open_ = asked.select("request", key, prompt).join(finished, "request", "left_anti").dropDuplicates(["request"])
    count = open_.count()
    if count:
        tasks = min(-(-count // per_task), MOST_TASKS)
        called = with_completion(open_.repartition(tasks, "request"), factory, system=system, prompt=prompt, key=key, json_mode=json_mode)
        noted = called.select("request", "reply", "error", F.current_timestamp().alias("called_at"))
        noted.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)

    # A reply beats a failure, and the last call counts.
    best = F.max_by(F.struct("reply", "error", "called_at"), F.struct(F.col("error").isNull(), "called_at"))
    answers = read_journal(spark, path).groupBy("request").agg(best.alias("_a"))
    return asked.join(answers, "request", "left").select(*rows.columns, "_a.reply", "_a.error", "_a.called_at")

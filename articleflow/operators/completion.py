"""Batched model calls: a pluggable client per task, a failing row never stops the others."""

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.functions.prompts import SUMMARY_BODY_LIMIT, SUMMARY_SYSTEM, summary_prompt
from articleflow.functions.text import is_blank, strip
from articleflow.operators.query import filter_articles, query_articles
from articleflow.session import materialize


class ModelError(Exception):
    """A call that failed; its message is stored with the row."""


class Client(Protocol):
    """What a call needs. ``key`` identifies the row, for clients that answer by row."""

    def complete(self, system: str, user: str, *, json_mode: bool, key: object) -> str: ...


@dataclass(frozen=True)
class HandlerClient:
    """Answers with a function of the prompt; it may raise."""

    handler: Callable[[str, str], str]

    def complete(self, system, user, *, json_mode, key):
        return self.handler(system, user)


@dataclass(frozen=True)
class KeyedClient:
    """Answers from a table of replies by row key; an exception as reply is raised, a missing one is an error.

    A script in call order makes no sense when calls run in parallel, hence the keys.
    """

    replies: Mapping[object, str | Exception]

    def complete(self, system, user, *, json_mode, key):
        if key not in self.replies:
            raise ModelError("no reply scripted")
        reply = self.replies[key]
        if isinstance(reply, Exception):
            raise reply
        return reply


# Fixed value: the error of a reply without text.
EMPTY_REPLY = "빈 요약"


def _call(client: Client, system: str, prompt: str, json_mode: bool, key: object) -> tuple[str | None, str | None]:
    try:
        return client.complete(system, prompt, json_mode=json_mode, key=key), None
    except ModelError as problem:
        return None, str(problem)
    except Exception as problem:
        return None, type(problem).__name__


def with_completion(
    rows: DataFrame, factory: Callable[[], Client], *, system: str, prompt: str = "prompt", key: str = "id",
    json_mode: bool = False,
) -> DataFrame:
    """Add ``reply`` (trimmed, NULL when blank or failed) and ``error`` to every row.

    ``factory`` runs on the executors, once per task, so clients and their secrets are never shipped. There is
    no retry within a task; store the result before reading it twice, or the calls are made again.
    """
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("_reply", T.StringType()), T.StructField("_error", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for batch in batches:
            client = client or factory()
            pairs = zip(batch.column(prompt).to_pylist(), batch.column(key).to_pylist())
            answers = [_call(client, system, text, json_mode, row) for text, row in pairs]
            columns = [pa.array(values, pa.string()) for values in zip(*answers)] or [pa.array([], pa.string())] * 2
            names = [*batch.schema.names, "_reply", "_error"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    called = rows.mapInArrow(run, schema)
    reply = strip("_reply")
    blank = F.col("_error").isNull() & is_blank("_reply")
    return called.select(
        *rows.columns,
        F.when(~is_blank("_reply"), reply).alias("reply"),
        F.when(blank, EMPTY_REPLY).otherwise(F.col("_error")).alias("error"),
    )


MODES = ("all", "id", "unsummarized")


def select_targets(
    clean: DataFrame, mode: str = "unsummarized", *, article_id: int | None = None, limit: int | None = None, force: bool = False
) -> DataFrame:
    """The articles to summarize: one by id, those without a summary, or (``all`` with ``force``) every one.

    Only a limit makes the order matter, so only then is there a sort.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    if mode == "id":
        if article_id is None:
            raise ValueError("mode 'id' needs an article id")
        return clean.where(F.col("id") == article_id)
    status = "all" if mode == "all" and force else "unsummarized"
    if limit is None:
        return filter_articles(clean, status=status)
    return query_articles(clean, status=status, limit=limit)


@dataclass(frozen=True)
class SummarizeResult:
    """Outcome per target (``outcome`` succeeded, failed or skipped), the summaries to store, and the counts."""

    outcomes: DataFrame
    summaries: DataFrame
    stats: DataFrame


def summarize(
    clean: DataFrame, factory: Callable[[], Client], *, model: str = "unknown", mode: str = "unsummarized",
    article_id: int | None = None, limit: int | None = None, force: bool = False,
    body_limit: int = SUMMARY_BODY_LIMIT, stage_path: str | None = None, stage: bool = True, journal: str | None = None,
) -> SummarizeResult:
    """Summarize the selected articles; write the result back with ``update_summaries`` or ``blocks.write_summaries``.

    The outcomes are stored before anything is counted, so every call is made once. With a ``journal`` (a path) replies are kept as
    tasks end, and a run that died goes on where it stopped.
    """
    targets = select_targets(clean, mode, article_id=article_id, limit=limit, force=force)
    already = F.lit(False) if force else ~is_blank("summary")
    asked = targets.where(~already).select(
        "id", summary_prompt(body_limit).alias("prompt"), F.coalesce(F.length("body"), F.lit(0)).cast("long").alias("original_length")
    )
    if journal is None:
        called = with_completion(asked, factory, system=SUMMARY_SYSTEM).withColumn("called_at", F.current_timestamp())
    else:
        from articleflow.operators.journal import with_journal

        called = with_journal(asked, factory, journal, system=SUMMARY_SYSTEM, model=model)
    answered = called.select("id", "original_length", "reply", "error", F.col("called_at").alias("summarized_at"))
    outcomes = answered.withColumn("outcome", F.when(F.col("error").isNull(), "succeeded").otherwise("failed"))
    if mode == "id" and not force:
        # Only a choice by id can hit an article that has a summary.
        skipped = targets.where(already).select("id", F.lit("skipped").alias("outcome"))
        outcomes = outcomes.unionByName(skipped, allowMissingColumns=True)
    if stage:
        outcomes = materialize(outcomes, stage_path, "summaries")
    done = outcomes.where(F.col("outcome") == "succeeded").select(
        "id", F.col("reply").alias("summary"), F.lit(model).alias("summary_model"), "summarized_at", "original_length"
    )
    return SummarizeResult(outcomes, done, summarize_stats(outcomes))


def summarize_stats(outcomes: DataFrame) -> DataFrame:
    outcome = F.col("outcome")
    return outcomes.agg(
        F.count_if(outcome != "skipped").alias("attempted"),
        F.count_if(outcome == "succeeded").alias("succeeded"),
        F.count_if(outcome == "failed").alias("failed"),
        F.count_if(outcome == "skipped").alias("skipped"),
    )

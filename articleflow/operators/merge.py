"""Merging cleaned rows into the clean table, and keyed updates of stored rows.

A batch has unique ``raw_id``; the table has unique ``raw_id`` and unique ``url``. A row matches the table by
either key, which is done as two equi joins. Decisions are taken on the two key columns alone; texts are
joined to the rows that win, once.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.operators.cleaning import build_clean_rows, cleanable
from articleflow.operators.ingest import first_per_key
from articleflow.operators.numbering import assign_ids
from articleflow.schemas import CLEAN_ARTICLES, CONTENT_COLUMNS, DUPLICATE_POLICIES, RAW_INVALID, SUMMARY_COLUMNS
from articleflow.session import materialize


def _empty_summary(rows: DataFrame) -> DataFrame:
    for name in SUMMARY_COLUMNS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(CLEAN_ARTICLES[name].dataType))
    return rows


def skip_winners(batch: DataFrame, target: DataFrame) -> DataFrame:
    """``raw_id`` of the rows that ``skip`` inserts: new by both keys, and first of their URL in the batch.

    Rows known by ``raw_id`` leave before the first per URL is taken, so they cannot shadow a later row. The
    URL probe comes last, when each URL is there once, so a much repeated URL is no hot key in the join.
    """
    keys = batch.select("raw_id", "url").join(target.select("raw_id"), "raw_id", "left_anti")
    firsts = first_per_key(keys, ("url",), "raw_id")
    return firsts.join(target.select("url"), "url", "left_anti").select("raw_id")


def skip_inserts(batch: DataFrame, target: DataFrame, winners: DataFrame | None = None) -> DataFrame:
    """The rows that a ``skip`` merge adds to the table, with their ids.

    The winners, one number each, are stored first: they are counted, numbered and joined, and the texts of
    the batch move once.
    """
    if winners is None:
        winners = materialize(skip_winners(batch, target), name="winners")
    numbered = assign_ids(winners, target, "raw_id")
    return _empty_summary(batch.join(numbered, "raw_id")).select(*CLEAN_ARTICLES.names)


def merge_skip(batch: DataFrame, target: DataFrame, winners: DataFrame | None = None) -> DataFrame:
    """The table after a ``skip`` merge; existing rows are left alone."""
    return target.select(*CLEAN_ARTICLES.names).unionByName(skip_inserts(batch, target, winners))


def upsert_decisions(batch: DataFrame, target: DataFrame) -> DataFrame:
    """One row per URL of the batch: ``first_raw, last_raw, n`` and what happens to it.

    ``action`` is ``update`` (of ``target_id``), ``insert`` or ``conflict`` (its rows point at two table rows).
    The last row of a URL gives the content. When two URLs match one table row - it moved to a new URL while
    another took its old one - the one whose match comes first gets the row and the other is inserted.

    The URL groups are aggregated before they meet the table, so every join is one to one.
    """
    by_raw = target.select("raw_id", F.col("id").alias("_by_raw"))
    by_url = target.select("url", F.col("id").alias("_by_url"))
    groups = (
        batch.select("raw_id", "url")
        .join(by_raw, "raw_id", "left")
        .groupBy("url")
        .agg(
            F.count("*").alias("n"),
            F.min("raw_id").alias("first_raw"),
            F.max("raw_id").alias("last_raw"),
            F.min("_by_raw").alias("_low"),
            F.max("_by_raw").alias("_high"),
            F.min(F.when(F.col("_by_raw").isNotNull(), F.col("raw_id"))).alias("_first_hit"),
        )
        .join(by_url, "url", "left")
    )
    matched = groups.select(
        "url", "n", "first_raw", "last_raw", "_by_url", "_first_hit",
        F.least("_low", "_by_url").alias("target_id"),
        (F.least("_low", "_by_url") != F.greatest("_high", "_by_url")).alias("_two_rows"),
        F.when(F.col("_by_url").isNotNull(), F.col("first_raw")).otherwise(F.col("_first_hit")).alias("_first_match"),
    ).withColumn("_two_rows", F.coalesce("_two_rows", F.lit(False)))

    # A group without a match gets a key of its own, so that NULL is no hot window partition.
    claim = F.when(F.col("target_id").isNull() | F.col("_two_rows"), -1 - F.col("last_raw")).otherwise(F.col("target_id"))
    rank = F.row_number().over(Window.partitionBy("_claim").orderBy("_first_match"))
    claimed = matched.withColumn("_claim", claim).withColumn("_rank", rank)

    has_row = F.col("target_id").isNotNull() & (F.col("_rank") == 1)
    # An earlier row of the group would be inserted before a later one matches: two rows again.
    late_hit = has_row & F.col("_by_url").isNull() & (F.col("_first_hit") > F.col("first_raw"))
    action = F.when(F.col("_two_rows") | late_hit, "conflict").when(has_row, "update").otherwise("insert")
    return claimed.select(
        "url", "n", "first_raw", "last_raw", action.alias("action"),
        F.when(action == "update", F.col("target_id")).alias("target_id"),
    )


def merge_upsert(
    batch: DataFrame, target: DataFrame, decisions: DataFrame | None = None, *, mark_stale: bool = False
) -> DataFrame:
    """The table after an ``upsert`` merge; a stored summary is kept. Conflicting URLs change nothing.

    ``mark_stale`` adds ``summary_stale``: there is a summary and the content it was made from has changed.
    """
    if decisions is None:
        decisions = materialize(upsert_decisions(batch, target), name="decisions")
    content = batch.select(*CONTENT_COLUMNS)

    updates = decisions.where(F.col("action") == "update").select("target_id", F.col("last_raw").alias("raw_id"))
    changed = content.join(updates, "raw_id").alias("u")
    hit = F.col("u.target_id").isNotNull()
    kept = target.alias("t").join(changed, F.col("t.id") == F.col("u.target_id"), "left").select(
        "t.id",
        *[F.when(hit, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in CONTENT_COLUMNS],
        *[F.col(f"t.{c}") for c in SUMMARY_COLUMNS],
        F.coalesce(
            hit & F.col("t.summary").isNotNull() & ~F.col("t.content_hash").eqNullSafe(F.col("u.content_hash")),
            F.lit(False),
        ).alias("summary_stale"),
    )

    inserts = decisions.where(F.col("action") == "insert").select("first_raw", F.col("last_raw").alias("raw_id"))
    numbered = assign_ids(inserts, target, "first_raw").drop("first_raw")
    added = _empty_summary(content.join(numbered, "raw_id")).withColumn("summary_stale", F.lit(False))

    columns = [*CLEAN_ARTICLES.names, *(["summary_stale"] if mark_stale else [])]
    return kept.select(*columns).unionByName(added.select(*columns))


def upsert_conflicts(batch: DataFrame, decisions: DataFrame) -> DataFrame:
    """Batch rows whose URL points at two table rows."""
    return batch.join(decisions.where(F.col("action") == "conflict").select("url"), "url", "left_semi")


def merge_counts(batch: DataFrame, target: DataFrame, policy: str, decided: DataFrame | None = None) -> DataFrame:
    """One row ``inserted, updated, skipped, conflicts`` for a batch of usable rows.

    ``decided`` is what the merge went by, if it is stored: ``skip_winners`` or ``upsert_decisions``.
    """
    if policy not in DUPLICATE_POLICIES:
        raise ValueError(f"duplicate policy must be one of {DUPLICATE_POLICIES}: {policy!r}")
    zero = F.lit(0).cast("long")
    if policy == "skip":
        winners = skip_winners(batch, target) if decided is None else decided
        inserted = winners.agg(F.count("*")).scalar()
        return batch.agg(F.count("*").alias("_n")).select(
            inserted.alias("inserted"), zero.alias("updated"), (F.col("_n") - inserted).alias("skipped"), zero.alias("conflicts")
        )
    decisions = upsert_decisions(batch, target) if decided is None else decided
    total = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), zero)
    action = F.col("action")
    return decisions.agg(
        F.count_if(action == "insert").alias("inserted"),
        total(action == "update", F.col("n")).alias("_on_stored"),
        total(action == "insert", F.col("n") - 1).alias("_on_new"),
        total(action == "conflict", F.col("n")).alias("conflicts"),
    ).select("inserted", (F.col("_on_stored") + F.col("_on_new")).alias("updated"), zero.alias("skipped"), "conflicts")


def update_raw_status(raw: DataFrame, marks: DataFrame) -> DataFrame:
    """``raw`` with ``status`` and ``error_message`` of the ids in ``marks`` replaced."""
    joined = raw.alias("r").join(marks.alias("m"), "id", "left")
    hit = F.col("m.status").isNotNull()
    picked = {c: F.when(hit, F.col(f"m.{c}")).otherwise(F.col(f"r.{c}")) for c in ("status", "error_message")}
    return joined.select(*[picked.get(c, F.col(f"r.{c}") if c != "id" else F.col("id")).alias(c) for c in raw.columns])


def invalid_marks(built: DataFrame) -> DataFrame:
    """Status marks for the rows cleaning rejected."""
    return built.where(F.col("reject_reason").isNotNull()).select(
        F.col("raw_id").alias("id"), F.lit(RAW_INVALID).alias("status"), F.col("reject_reason").alias("error_message")
    )


def update_summaries(clean: DataFrame, summaries: DataFrame) -> DataFrame:
    """``clean`` with the summaries of ``id, summary, summary_model, summarized_at, original_length`` written."""
    new = summaries.withColumn("summary_length", F.length("summary").cast("long")).alias("s")
    joined = clean.alias("c").join(new, "id", "left")
    written = (*SUMMARY_COLUMNS, "original_length")
    hit = F.col("s.summary").isNotNull()
    picked = {c: F.when(hit, F.col(f"s.{c}")).otherwise(F.col(f"c.{c}")) for c in written}
    return joined.select(*[picked.get(c, F.col(f"c.{c}") if c != "id" else F.col("id")).alias(c) for c in clean.columns])


def orphans(clean: DataFrame, raw: DataFrame) -> DataFrame:
    """Clean rows whose raw row is gone."""
    return clean.join(raw.select(F.col("id").alias("raw_id")), "raw_id", "left_anti")


def duplicate_content(clean: DataFrame) -> DataFrame:
    """Articles that share a content hash: a report, nothing is merged.

    Hot hashes are folded map-side; the set of sources is bounded by the registry, not by the copies. Rows
    without a hash count as none, which needs no filter that would work a hash out a second time.
    """
    return (
        clean.groupBy("content_hash")
        .agg(
            F.count("content_hash").alias("copies"),
            F.min("id").alias("first_id"),
            F.array_sort(F.collect_set("source")).alias("sources"),
        )
        .where(F.col("copies") > 1)
    )


@dataclass(frozen=True)
class CleanResult:
    """What a cleaning run gives: the new clean table, the marked raw table, counts and rejects."""

    clean: DataFrame
    raw: DataFrame
    stats: DataFrame
    conflicts: DataFrame | None


def clean_articles(
    raw: DataFrame, clean: DataFrame, *, policy: str = "skip", limit: int | None = None, stage_path: str | None = None
) -> CleanResult:
    """Clean the usable raw rows and merge them; running it again changes nothing.

    The cleaned batch is written once as a stage table, so that the normalizers run once however often the
    merge reads it.
    """
    if policy not in DUPLICATE_POLICIES:
        raise ValueError(f"duplicate policy must be one of {DUPLICATE_POLICIES}: {policy!r}")
    built = materialize(build_clean_rows(cleanable(raw, limit)), stage_path, "cleaned")
    batch = built.where(F.col("reject_reason").isNull()).drop("reject_reason")

    conflicts = None
    if policy == "skip":
        decided = materialize(skip_winners(batch, clean), name="winners")
        merged = merge_skip(batch, clean, decided)
    else:
        decided = materialize(upsert_decisions(batch, clean), name="decisions")
        merged = merge_upsert(batch, clean, decided)
        conflicts = upsert_conflicts(batch, decided)
    processed = built.agg(F.count("*")).scalar()
    invalid = built.agg(F.count_if(F.col("reject_reason").isNotNull())).scalar()
    stats = merge_counts(batch, clean, policy, decided).select(
        processed.alias("processed"), "inserted", "updated", "skipped", invalid.alias("invalid"), "conflicts"
    )
    return CleanResult(merged, update_raw_status(raw, invalid_marks(built)), stats, conflicts)

"""Collected items and failures to raw rows, first-wins insertion, and the statistics of a run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.functions.text import filled
from articleflow.functions.urls import normalize_url
from articleflow.operators.numbering import assign_ids
from articleflow.schemas import RAW_ARTICLES, RAW_ERROR, RAW_OK, RAW_PARTIAL
from articleflow.session import materialize

RAW_KEY = ("source_name", "canonical_url")
# Fixed value: message of an item without a title.
NO_TITLE = "제목을 찾지 못했습니다"
# Failures of a run are stored after its items.
_AFTER_ITEMS = 1 << 61


def item_payload(*extra: str) -> Column:
    """The JSON object stored with a raw row; ``extra`` columns are added and win over base fields."""
    base = {
        "source": F.col("source_name"),
        "url": F.col("url"),
        "title": F.col("title"),
        "body": F.col("body"),
        "published_at": F.col("published_raw"),
        "category": F.col("category"),
        "external_id": F.col("external_id"),
    }
    fields = base | {name: F.col(name) for name in extra}
    return F.to_json(F.struct(*[col.alias(name) for name, col in fields.items()]), {"ignoreNullFields": "false"})


def to_raw_rows(
    collected: DataFrame, method: str, collected_at: Column | None = None, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Items and failures in one table of raw rows, with ``seq``, ``attempted`` and ``storable`` beside the columns.

    ``collected`` is what ``parse_feeds`` or ``crawl`` give: ``source_name, ok, seq, url, title, body,
    published_raw, external_id, category, source_url, error``. A row with an empty canonical URL is kept for
    the counts (``storable`` false) but never stored.
    """
    ok = F.col("ok")
    canonical = collected.withColumn("canonical_url", F.coalesce(normalize_url("url"), F.lit("")))
    failure = F.to_json(F.struct("url", "error"), {"ignoreNullFields": "false"})
    untitled = filled("title").isNull()
    rows = canonical.select(
        F.when(ok, F.col("external_id")).alias("external_id"),
        "source_name",
        "source_url",
        F.lit(method).alias("collection_method"),
        (F.current_timestamp() if collected_at is None else collected_at).alias("collected_at"),
        "canonical_url",
        F.when(ok, item_payload(*extra)).otherwise(failure).alias("raw_payload"),
        F.when(~ok, RAW_ERROR).when(untitled, RAW_PARTIAL).otherwise(RAW_OK).alias("status"),
        F.when(~ok, F.col("error")).when(untitled, NO_TITLE).alias("error_message"),
        (F.col("seq") + F.when(ok, F.lit(0)).otherwise(F.lit(_AFTER_ITEMS))).alias("seq"),
        "attempted",
        (F.col("canonical_url") != "").alias("storable"),
    )
    return rows


def first_per_key(rows: DataFrame, keys: tuple[str, ...], *order: str, last: bool = False) -> DataFrame:
    """The first (or last) row per key. Spark prunes to one row per key and task before it shuffles."""
    sort = [F.col(name).desc() if last else F.col(name).asc() for name in order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))
    return rows.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def _fingerprint() -> Column:
    """Tells rows apart that share source, URL and ``seq``: versions of one item. The moment of collection is no part of it; it may be that of the query."""
    return F.xxhash64("status", "raw_payload")


def new_raw_keys(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Which rows to insert: first per (source, URL) in arrival order, unless the table has that key already.

    Payloads are left behind; the result is ``seq`` and a fingerprint (``version``, where there are payloads) with the short columns. ``seq`` may be
    repeated: of one URL's rows with the same ``seq`` the one of least fingerprint counts.
    """
    short = [name for name in ("seq", "collection_method", "status", *RAW_KEY) if name in rows.columns]
    storable = rows.where("storable")
    if "raw_payload" in rows.columns:
        firsts = first_per_key(storable.select(*short, _fingerprint().alias("version")), RAW_KEY, "seq", "version")
        return firsts.join(existing.select(*RAW_KEY), list(RAW_KEY), "left_anti").select(*short, "version")
    firsts = first_per_key(storable.select(*short), RAW_KEY, "seq")
    return firsts.join(existing.select(*RAW_KEY), list(RAW_KEY), "left_anti").select(*short)


def insert_raw(rows: DataFrame, existing: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The rows to append to ``raw_articles``, with their ids: one row and one id per key, also where ``seq`` is repeated.

    ``keys`` takes ``new_raw_keys`` when they are stored. ``rows`` is best a stored table too: it is read for
    its keys and again for the payloads of the rows that win.
    """
    if keys is None:
        keys = materialize(new_raw_keys(rows, existing), name="new-keys")
    by = ["seq", *RAW_KEY, "version"]
    numbered = assign_ids(keys.select(*by), existing, "seq", ties=RAW_KEY)
    # Rows that are the same throughout would all match; the join has them side by side already.
    return rows.withColumn("version", _fingerprint()).join(numbered, by).dropDuplicates(by).select(*RAW_ARTICLES.names)


def retried_errors(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """``existing`` with failed entries replaced by a later success, keeping their ids. Not the default: a
    failed URL otherwise keeps its key for good."""
    better = first_per_key(rows.where("storable").where(F.col("status") != RAW_ERROR), RAW_KEY, "seq")
    columns = [name for name in RAW_ARTICLES.names if name not in ("id", *RAW_KEY)]
    joined = existing.alias("e").join(better.alias("b"), list(RAW_KEY), "left")
    replace = (F.col("e.status") == RAW_ERROR) & F.col("b.status").isNotNull()
    picked = [F.when(replace, F.col(f"b.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in columns]
    return joined.select("e.id", *RAW_KEY, *picked).select(*RAW_ARTICLES.names)


def fetch_run_stats(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Attempted, stored, failed and duplicate counts per source and method, from all rows and ``new_raw_keys``.

    Duplicates follow from the two counts, so no row-level outcome has to be shuffled. A repeated failure
    counts as failed, not as duplicate.
    """
    by = ["source_name", "collection_method"]
    is_item = F.col("status") != RAW_ERROR
    seen = rows.groupBy(*by).agg(
        F.greatest(F.sum("attempted"), F.count("*")).alias("attempted_count"),
        F.count_if(~is_item | ~F.col("storable")).alias("failure_count"),
        F.count_if(is_item & F.col("storable")).alias("_items"),
    )
    stored = keys.where(is_item).groupBy(*by).agg(F.count("*").alias("success_count"))
    success = F.coalesce(F.col("success_count"), F.lit(0))
    return seen.join(stored, by, "left").select(
        *by, "attempted_count", success.alias("success_count"), "failure_count",
        (F.col("_items") - success).alias("duplicate_count"),
    )

"""The article query: conjunctive filters, ordering, paging, and the list and detail views."""

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions import ColumnOrName, as_column
from articleflow.functions.dates import day_bounds, day_text, to_iso
from articleflow.functions.text import filled, is_blank, shorten
from articleflow.schemas import SUMMARY_STATES

# Partition column of a stored clean table (see sources.tables.write_clean).
DAY_COLUMN = "effective_day"


def effective_at() -> Column:
    return F.coalesce(F.col("published_at"), F.col("collected_at"))


def contains_keyword(text: ColumnOrName, keyword: str) -> Column:
    """Substring search that ignores the case of ASCII letters only; ``%`` and ``_`` are wildcards.

    Java patterns fold ASCII alone unless told otherwise, and search a text without first rewriting it.
    """
    wildcards = {"%": ".*", "_": "."}
    literal = lambda mark: mark if mark.isalnum() or not mark.isascii() else "\\" + mark
    pattern = "".join(wildcards.get(mark) or literal(mark) for mark in keyword)
    return F.rlike(F.coalesce(as_column(text), F.lit("")), F.lit("(?is)" + pattern))


def _has_text(name: str) -> Column:
    """Not NULL and not just spaces (U+0020 only, as the stored filter does)."""
    return F.col(name).isNotNull() & (F.trim(F.col(name)) != "")


def article_filter(
    columns: list[str],
    *,
    date_from: str | datetime | None = None,
    date_to: str | datetime | None = None,
    category: str | None = None,
    source: str | None = None,
    status: str | None = "all",
    keyword: str | None = None,
    require_body: bool = False,
) -> Column:
    """All given conditions at once. Days are whole UTC days; datetimes are inclusive bounds."""
    if status not in (*SUMMARY_STATES, None):
        raise ValueError(f"unknown summary status: {status!r}")
    conditions = []
    if date_from:
        bound = day_bounds(date_from, None)[0] if isinstance(date_from, str) else date_from
        conditions.append(effective_at() >= F.lit(bound))
        if DAY_COLUMN in columns:
            conditions.append(F.col(DAY_COLUMN) >= F.lit(bound.date()))
    if date_to:
        if isinstance(date_to, str):
            conditions.append(effective_at() < F.lit(day_bounds(None, date_to)[1]))
            last_day = datetime.fromisoformat(date_to).date()
        else:
            conditions.append(effective_at() <= F.lit(date_to))
            last_day = date_to.date()
        if DAY_COLUMN in columns:
            conditions.append(F.col(DAY_COLUMN) <= F.lit(last_day))
    if category:
        conditions.append(F.col("category") == category)
    if source:
        conditions.append(F.col("source") == source)
    if status == "summarized":
        conditions.append(_has_text("summary"))
    elif status == "unsummarized":
        conditions.append(~_has_text("summary"))
    if require_body:
        conditions.append(_has_text("body"))
    if keyword:
        conditions.append(contains_keyword("title", keyword) | contains_keyword("body", keyword))
    return reduce(lambda left, right: left & right, conditions, F.lit(True))


def filter_articles(clean: DataFrame, **filters) -> DataFrame:
    return clean.where(article_filter(clean.columns, **filters))


def article_order(descending: bool) -> list[Column]:
    keys = [effective_at(), F.col("id")]
    return [key.desc() if descending else key.asc() for key in keys]


def query_articles(
    clean: DataFrame, *, limit: int | None = None, offset: int = 0, order: str = "ASC", **filters
) -> DataFrame:
    """Filtered articles by effective date and id, both in one direction."""
    rows = filter_articles(clean, **filters).orderBy(*article_order(order.upper() == "DESC"))
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def list_view(articles: DataFrame) -> DataFrame:
    """The columns of a listing; the order of ``articles`` is kept."""
    return articles.select(
        "id",
        F.when(is_blank("summary"), "요약X").otherwise("요약O").alias("marker"),
        day_text(effective_at()).alias("day"),
        "category",
        "source",
        "title",
    )


def list_page(clean: DataFrame, page: int, page_size: int, **filters) -> DataFrame:
    """Page ``page`` (from 1) of the listing, newest first."""
    rows = query_articles(clean, limit=page_size, offset=(page - 1) * page_size, order="DESC", **filters)
    return list_view(rows)


def list_page_after(clean: DataFrame, last_at: datetime | None, last_id: int | None, page_size: int, **filters) -> DataFrame:
    """The page after the row with this effective date and id: the same pages, at a cost that does not grow with depth."""
    rows = filter_articles(clean, **filters)
    if last_at is not None:
        at = F.lit(last_at)
        rows = rows.where((effective_at() < at) | ((effective_at() == at) & (F.col("id") < last_id)))
    return list_view(rows.orderBy(*article_order(True)).limit(page_size))


def page_count(clean: DataFrame, page_size: int, **filters) -> DataFrame:
    """``total`` and ``pages`` (at least 1)."""
    total = filter_articles(clean, **filters).agg(F.count("*").alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long")
    return total.select("total", pages.alias("pages"))


# What stands in for missing parts of an article, and the mark of a cut body.
NO_SUMMARY, NO_BODY, NOTHING = "(요약 없음)", "(본문 없음)", "-"
BODY_PREVIEW, BODY_CUT = 2000, "\n...(생략)"


def detail_view(articles: DataFrame) -> DataFrame:
    """Everything shown of an article, with stand-ins for missing parts and a bounded body preview."""
    return articles.select(
        "id",
        "title",
        "url",
        "source",
        "category",
        F.coalesce(to_iso("published_at"), F.lit(NOTHING)).alias("published"),
        to_iso("collected_at").alias("collected"),
        "clean_status",
        F.coalesce(filled("summary_model"), F.lit(NOTHING)).alias("summary_model"),
        F.coalesce(F.col("summary_length"), F.lit(0)).cast("long").alias("summary_length"),
        F.coalesce(filled("summary"), F.lit(NO_SUMMARY)).alias("summary"),
        shorten(F.coalesce(filled("body"), F.lit(NO_BODY)), BODY_PREVIEW, BODY_CUT).alias("body_preview"),
    )

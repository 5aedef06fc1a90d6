"""Counts, ratios, top lists and the report."""

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from articleflow.functions import ColumnOrName, as_column
from articleflow.functions.text import filled, is_blank
from articleflow.operators.analysis import latest_analysis
from articleflow.operators.query import filter_articles
from articleflow.schemas import UNKNOWN
from articleflow.session import materialize


def safe_ratio(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """A ratio from 0 to 1; 0 where there is nothing to divide by."""
    part, whole = as_column(numerator).cast("double"), as_column(denominator).cast("double")
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


@arrow_udf(T.StringType())
def format_percent(ratios: pa.Array) -> pa.Array:
    """A ratio as a percentage with one decimal, ties to even. For the few values a report shows."""
    return pa.array([None if ratio is None else f"{ratio * 100:.1f}%" for ratio in ratios.to_pylist()], pa.string())


def count_rows(table: DataFrame, name: str = "n") -> DataFrame:
    return table.agg(F.count("*").alias(name))


def count_articles(clean: DataFrame, **filters) -> DataFrame:
    """Number of articles a query would give; limit and offset play no part. Reads only the filtered columns."""
    filters = {name: value for name, value in filters.items() if name not in ("limit", "offset")}
    return count_rows(filter_articles(clean, **filters))


def _counts_by(rows: DataFrame, name: str) -> DataFrame:
    label = F.coalesce(filled(name), F.lit(UNKNOWN)).alias(name)
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(name))


def category_counts(clean: DataFrame, **filters) -> DataFrame:
    return _counts_by(filter_articles(clean, **filters), "category")


def source_counts(clean: DataFrame, **filters) -> DataFrame:
    return _counts_by(filter_articles(clean, **filters), "source")


def top_counts(counts: DataFrame, name: str, top_n: int) -> DataFrame:
    """The first ``top_n`` of a count list with their place, ties broken by name."""
    top = counts.orderBy(F.desc("n"), F.asc(name)).limit(top_n)
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.asc(name)))
    return top.select(place.cast("long").alias("place"), name, "n")


def daily_counts(clean: DataFrame, **filters) -> DataFrame:
    """Articles per day of collection (publication where that is missing); days without any are left out."""
    day = F.to_date(F.coalesce("collected_at", "published_at")).alias("day")
    rows = filter_articles(clean, **filters).select(day).where(F.col("day").isNotNull())
    return rows.groupBy("day").agg(F.count("*").alias("n")).orderBy("day")


def _quality_counts() -> list[Column]:
    return [
        F.count("*").alias("clean_count"),
        F.count_if(~is_blank("body")).alias("body_count"),
        F.count_if(~is_blank("summary")).alias("summarized_count"),
    ]


def _with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "clean_rate": safe_ratio("clean_count", "raw_count"),
            "body_rate": safe_ratio("body_count", "clean_count"),
            "summary_rate": safe_ratio("summarized_count", "clean_count"),
        }
    )


def report_metrics(clean: DataFrame, raw: DataFrame, by: tuple[str, ...] = (), **filters) -> DataFrame:
    """Counts and quality ratios of the filtered articles, in one pass, for all or per ``by`` group.

    ``clean_rate`` divides by *all* raw rows, whatever the filters and the status.
    """
    raw_count = raw.agg(F.count("*")).scalar()
    rows = filter_articles(clean, **filters)
    counts = rows.groupBy(*by).agg(*_quality_counts()) if by else rows.agg(*_quality_counts())
    return _with_rates(counts.withColumn("raw_count", raw_count))


def report_cube(clean: DataFrame, **filters) -> DataFrame:
    """Counts per category, source and day: all numbers of a report add up from these.

    One pass over the articles, bodies included; what follows reads this small table only.
    """
    day = F.to_date(F.coalesce("collected_at", "published_at")).alias("day")
    labels = [F.coalesce(filled(name), F.lit(UNKNOWN)).alias(name) for name in ("category", "source")]
    return filter_articles(clean, **filters).groupBy(*labels, day).agg(*_quality_counts())


@dataclass(frozen=True)
class Report:
    """The tables of a report: one wide row, two ranked lists, the daily series and the attached analysis."""

    metrics: DataFrame
    top_sources: DataFrame
    top_categories: DataFrame
    daily: DataFrame
    analysis: DataFrame | None


def build_report(
    clean: DataFrame, raw: DataFrame, runs: DataFrame | None = None, *, top_n: int = 5,
    date_from: str | None = None, date_to: str | None = None, category: str | None = None,
    cube: DataFrame | None = None,
) -> Report:
    """All numbers of a report out of one scan of the articles.

    ``cube`` takes a stored ``report_cube``; without it one is written to the shared scratch folder.
    """
    filters = {"date_from": date_from, "date_to": date_to, "category": category}
    if cube is None:
        cube = materialize(report_cube(clean, **filters), name="report")
    names = ("clean_count", "body_count", "summarized_count")
    totals = cube.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])
    metrics = _with_rates(totals.withColumn("raw_count", raw.agg(F.count("*")).scalar()))

    def listed(name: str) -> DataFrame:
        return top_counts(cube.groupBy(name).agg(F.sum("clean_count").alias("n")), name, top_n)

    daily = cube.where(F.col("day").isNotNull()).groupBy("day").agg(F.sum("clean_count").alias("n")).orderBy("day")
    analysis = None if runs is None else latest_analysis(runs, date_from=date_from, date_to=date_to, category=category)
    return Report(metrics, listed("source"), listed("category"), daily, analysis)

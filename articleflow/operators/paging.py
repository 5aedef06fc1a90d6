"""Pages far down a listing, found by sums instead of by skipping rows.

A directory holds row counts per effective day and block of ids; it is small (days times blocks) and may be stored beside the table. Running
sums over it find the day in which a page begins. A day with more rows than ``width`` is counted once more in ever smaller units of time, and
a single moment by blocks of ids, down to at most ``width`` rows, of which only dates and ids are ordered. The page itself is a range from the row found.

A directory counts the table and filters it was made for; after a change it is made anew. Ids must be unique and not NULL.
"""

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.operators.query import article_order, effective_at, filter_articles, list_view

WIDTH = 1 << 16
# Microseconds of the units a day is split into: hour, minute, second, millisecond, microsecond.
UNITS = (3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)


def _id_block(width: int) -> Column:
    return F.expr(f"id div {width}").cast("long")


def page_directory(clean: DataFrame, width: int = WIDTH, **filters) -> DataFrame:
    """(day, block, n, first_at, last_at): counts of the filtered articles, summed before the shuffle; ``day`` is NULL for articles without dates."""
    at = effective_at()
    rows = filter_articles(clean, **filters).select(F.to_date(at).alias("day"), _id_block(width).alias("block"), at.alias("at"))
    return rows.groupBy("day", "block").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def _bin_at(counts: DataFrame, key: str, rank: int) -> tuple[Row, int] | None:
    """Which bin holds the row with this rank (from 0, newest first, a NULL key last), and the row's rank in it."""
    upto = F.sum("n").over(Window.orderBy(F.desc_nulls_last(key)))
    found = counts.withColumn("_upto", upto).where(F.col("_upto") > rank).orderBy("_upto").first()
    return None if found is None else (found, rank - (found["_upto"] - found["n"]))


def row_at(clean: DataFrame, directory: DataFrame, rank: int, width: int = WIDTH, **filters) -> tuple[int | None, int] | None:
    """Effective date (in microseconds of Unix time) and id of the article with this rank (from 0, newest first); None behind the last one.

    ``width`` is that of the directory. Each step brings one count to the driver.
    """
    alone = F.min("first_at").eqNullSafe(F.max("last_at"))
    found = _bin_at(directory.groupBy("day").agg(F.sum("n").alias("n"), alone.alias("one_moment")), "day", rank)
    if found is None:
        return None
    day, rank = found
    rows = _of_day(filter_articles(clean, **filters), day["day"]).select("id", F.unix_micros(effective_at()).alias("at"))

    size = day["n"]
    if size > width and not day["one_moment"]:
        for unit in UNITS:
            place = F.expr(f"at div {unit}")
            part, rank = _bin_at(rows.groupBy(place.alias("unit")).agg(F.count("*").alias("n")), "unit", rank)
            rows, size = rows.where(place == part["unit"]), part["n"]
            if size <= width:
                break
    if size > width:
        # One moment: the directory has its blocks if it is alone in its day, else they are counted.
        if day["one_moment"]:
            blocks = directory.where(F.col("day").eqNullSafe(F.lit(day["day"]))).select("block", "n")
        else:
            blocks = rows.groupBy(_id_block(width).alias("block")).agg(F.count("*").alias("n"))
        block, rank = _bin_at(blocks, "block", rank)
        rows = rows.where((F.col("id") >= block["block"] * width) & (F.col("id") < (block["block"] + 1) * width))
    # At most ``width`` rows are left: the first ones, then the last of these.
    last = rows.orderBy(F.desc("at"), F.desc("id")).limit(rank + 1).orderBy("at", "id").first()
    return last["at"], last["id"]


def _of_day(rows: DataFrame, day: date | None) -> DataFrame:
    """Articles of one effective day; a table stored by days skips the others."""
    if day is None:
        return rows.where(effective_at().isNull())
    return filter_articles(rows, date_from=day.isoformat(), date_to=day.isoformat())


def deep_page(clean: DataFrame, directory: DataFrame, page: int, page_size: int, width: int = WIDTH, **filters) -> DataFrame:
    """``list_page`` for any depth: page ``page`` (from 1) of the listing, newest first, without skipping the pages before it.

    A page behind the last one is empty. The page is cut out between its first and its last row, so no other text is ordered.
    """
    rows = filter_articles(clean, **filters)
    total = directory.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    begin, end = (page - 1) * page_size, min(page * page_size, total) - 1
    if begin > end:
        return list_view(rows.where(F.lit(False)))
    first = row_at(clean, directory, begin, width, **filters)
    last = row_at(clean, directory, end, width, **filters)
    if last[0] is not None:
        rows = filter_articles(rows, date_from=_moment(last[0]), date_to=_moment(first[0]))
    rows = rows.where(_from_row(*first) & _up_to_row(*last))
    return list_view(rows.orderBy(*article_order(True)).limit(page_size))


def _moment(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


def _from_row(micros: int | None, row_id: int) -> Column:
    """At the row with this date and id in the listing, or after it; articles without dates come last."""
    at = F.unix_micros(effective_at())
    if micros is None:
        return at.isNull() & (F.col("id") <= row_id)
    return at.isNull() | (at < micros) | ((at == micros) & (F.col("id") <= row_id))


def _up_to_row(micros: int | None, row_id: int) -> Column:
    at = F.unix_micros(effective_at())
    if micros is None:
        return at.isNotNull() | (F.col("id") >= row_id)
    return (at > micros) | ((at == micros) & (F.col("id") >= row_id))

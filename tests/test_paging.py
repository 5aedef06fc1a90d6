"""Deep pages against the listing by offset."""

from datetime import datetime, timedelta

import pytest

from articleflow.operators import paging, query
from articleflow.schemas import CLEAN_ARTICLES
from articleflow.session import materialize
from articleflow.sources import tables

START = datetime(2026, 8, 1)


def articles(spark, moments):
    """Articles published at ``moments``; None stands for no date at all."""
    rows = [
        (i, i, f"t{i}", "b", f"https://h/{i}", "s", "AI" if i % 3 else "IT", None if at is None else at, at, None, "ok", "x" if i % 2 else None, None, None, 1, 1)
        for i, at in enumerate(moments, 1)
    ]
    schema = CLEAN_ARTICLES.fromJson(CLEAN_ARTICLES.jsonValue())
    for field in schema:
        field.nullable = True
    return materialize(spark.createDataFrame(rows, schema))


MOMENTS = {
    "days": [START + timedelta(days=i % 7) for i in range(60)],
    "one moment": [START] * 60,
    "a hot day": [START + timedelta(seconds=i // 4, microseconds=(i % 2) * 1500) for i in range(50)] + [START + timedelta(days=i) for i in range(1, 11)],
    "a hot moment in a day": [START + timedelta(hours=1)] * 45 + [START + timedelta(hours=i) for i in range(15)],
    "no dates": [None if i % 2 else START + timedelta(days=i) for i in range(60)],
}


@pytest.mark.parametrize("case", MOMENTS)
def test_every_page_equals_the_one_by_offset(spark, case):
    clean = articles(spark, MOMENTS[case])
    directory = materialize(paging.page_directory(clean, 8))
    want = [tuple(r) for r in query.list_view(query.query_articles(clean, order="DESC")).collect()]
    for page in (1, 3, 5, 9, 10):
        got = [tuple(r) for r in paging.deep_page(clean, directory, page, 7, 8).collect()]
        assert got == want[(page - 1) * 7 : page * 7]


def test_filters_and_days(spark, tmp_path):
    path = str(tmp_path / "clean")
    tables.write_clean(articles(spark, MOMENTS["a hot day"]), path)
    clean = spark.read.parquet(path)
    for filters in ({"category": "AI", "date_from": "2026-08-01", "date_to": "2026-08-06"}, {"status": "summarized", "date_from": START + timedelta(seconds=3)}):
        directory = materialize(paging.page_directory(clean, 4, **filters))
        for page in (1, 2, 4):
            got = paging.deep_page(clean, directory, page, 6, 4, **filters)
            assert [tuple(r) for r in got.collect()] == [tuple(r) for r in query.list_page(clean, page, 6, **filters).collect()]


def test_no_row_is_skipped_and_other_days_are_not_read(spark, tmp_path, plan_of):
    path = str(tmp_path / "clean")
    tables.write_clean(articles(spark, MOMENTS["days"]), path)
    clean = spark.read.parquet(path)
    page = paging.deep_page(clean, paging.page_directory(clean, 8), 5, 7, 8)
    plan = plan_of(page)
    assert "offset=" not in plan and "TakeOrderedAndProject" in plan
    assert "effective_day" in plan[plan.index("PartitionFilters") :].split("]")[0]


def test_empty_table_and_pages_behind_the_last(spark):
    clean = articles(spark, MOMENTS["days"])
    directory = paging.page_directory(clean, 8)
    assert paging.deep_page(clean, directory, 100, 7, 8).count() == 0
    assert paging.row_at(clean, directory, 60, 8) is None
    nothing = clean.limit(0)
    assert paging.deep_page(nothing, paging.page_directory(nothing, 8), 1, 7, 8).count() == 0

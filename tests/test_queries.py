"""Registered queries against their SQL, whatever the number of partitions, and the plans they get."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from articleflow.plans.ansi import SQL
from articleflow.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def ordered(rows, columns):
    """Rows as a multiset: columns by name, floats rounded, NaN as missing."""
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(tidy(row[i]) for i in places) for row in rows), key=repr)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    got = entry.queries()[name](spark, SMALL)
    want = sql.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered([tuple(r) for r in got.collect()], got.columns) == ordered(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["merge_upsert", "merge_skip", "raw_inserts", "fetch_slots", "analysis_prompts"])
def test_partitions_do_not_matter(spark, name):
    results = []
    for partitions in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            df = entry.queries()[name](spark, SMALL)
            results.append(ordered([tuple(r) for r in df.collect()], df.columns))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins(spark, plan_of, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize(
    "name, wanted",
    [
        ("dedup_raw_first_wins", r"WindowGroupLimit .* Partial"),
        ("raw_new_only", r"WindowGroupLimit .* Partial"),
        ("extract_links_all", r"^(?!.*ArrowEvalPython.*ArrowEvalPython)"),
        ("analysis_blocks", r"WindowGroupLimit .* 50, Partial"),
        ("list_page", r"TakeOrderedAndProject"),
        ("latest_analysis", r"TakeOrderedAndProject"),
        ("filter_keyword", r"RLIKE\(.*\(\?is\)THE\)"),
        ("filter_category_source", r"PushedFilters: \[[^\]]*EqualTo\(lang,en\)"),
        ("article_by_id", r"PushedFilters: \[[^\]]*EqualTo\(doc_id,42\)"),
        ("category_counts", r"ReadSchema: struct<lang:string>"),
        ("page_count", r"ReadSchema: struct<lang:string>"),
        ("raw_count", r"ReadSchema: struct<>"),
        ("merge_decisions", r"partial_min\(_by_raw"),
    ],
)
def test_plan_shapes(spark, plan_of, name, wanted):
    assert re.search(wanted, plan_of(entry.queries()[name](spark, SMALL)), re.DOTALL if wanted[0] == "^" else 0)

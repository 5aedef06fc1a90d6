"""Reports from signed counts against reports over the whole table."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from articleflow.operators import aggregates, blocks, changes
from articleflow.schemas import CLEAN_ARTICLES, CONTENT_COLUMNS
from articleflow.session import materialize, remove

AT = datetime(2026, 8, 6)


def articles(spark, ids, shift=0):
    """Labels, days and bodies that differ with the id and ``shift``; one category and some bodies are blank."""
    rows = [
        (
            i, i * 10, f"t{i}", (None, " ", "body")[(i + shift) % 3], f"https://h/{i}", f"s{(i + shift) % 2}", ("", "AI", "IT")[(i + 2 * shift) % 3],
            AT + timedelta(days=(i + shift) % 4) if i % 2 else None, AT + timedelta(days=i % 5 + shift), f"h{i}{shift}", "ok", "s" if i % 2 else None, None, None, 4, 1,
        )
        for i in ids
    ]
    return materialize(spark.createDataFrame(rows, CLEAN_ARTICLES))


def counts(df):
    return sorted((tuple(r[c] for c in ("category", "source", "day", *changes.COUNTS)) for r in df.collect()), key=repr)


def same(report, table):
    assert counts(report.cube()) == counts(aggregates.report_cube(table.read()))
    some = {"date_from": "2026-08-07", "date_to": "2026-08-09", "category": "AI"}
    assert counts(report.cube(**some)) == counts(aggregates.report_cube(table.read(), **some))


def begun(spark, tmp_path, ids=range(1, 61)):
    table = blocks.store(articles(spark, ids), str(tmp_path / "clean"), width=10)
    report = changes.ChangingReport(spark, str(tmp_path / "report"), 10)
    report.begin(table.read())
    return table, report


def merged(spark, table, report, batch, policy, run):
    blocks.merge(table, batch, policy=policy, run=f"run={run}")
    report.follow_merge(spark.read.parquet(f"{table.path}-changes/run={run}"), batch, run)


@pytest.mark.parametrize("policy", ["upsert", "skip"])
def test_three_batches_equal_the_whole_table(spark, tmp_path, policy):
    table, report = begun(spark, tmp_path)
    same(report, table)
    for run, ids in enumerate(([3, 4, 5, 100, 101], range(40, 90), [100, 4, 200])):
        batch = articles(spark, ids, run + 1).select(*CONTENT_COLUMNS)
        merged(spark, table, report, batch, policy, str(run))
        same(report, table)


def test_summaries_count(spark, tmp_path):
    table, report = begun(spark, tmp_path)
    new = spark.createDataFrame([(2, "new"), (3, " "), (4, None), (900, "nobody")], "id long, summary string")
    whole = new.select("*", F.lit("m").alias("summary_model"), F.lit(AT).alias("summarized_at"), F.lit(4).cast("long").alias("original_length"))
    blocks.write_summaries(table, whole)
    report.follow_summaries(new, "summaries")
    same(report, table)
    report.follow_summaries(new, "summaries")
    same(report, table)


def test_a_run_that_died_comes_again(spark, tmp_path, monkeypatch):
    table, report = begun(spark, tmp_path)
    batch = articles(spark, [3, 4, 100], 1).select(*CONTENT_COLUMNS)
    write = changes.ChangingReport._write

    def dying(self, rows, name):
        if name.startswith("counts/"):
            raise RuntimeError("executor lost")
        write(self, rows, name)

    monkeypatch.setattr(changes.ChangingReport, "_write", dying)
    with pytest.raises(RuntimeError):
        merged(spark, table, report, batch, "upsert", "a")
    monkeypatch.setattr(changes.ChangingReport, "_write", write)
    with pytest.raises(ValueError, match="run=a"):
        report.follow_summaries(spark.createDataFrame([(2, "x")], "id long, summary string"), "b")
    for _ in range(2):
        merged(spark, table, report, batch, "upsert", "a")
        same(report, table)


def test_the_table_itself_is_not_read(spark, tmp_path):
    table, report = begun(spark, tmp_path)
    batch = articles(spark, [3, 100], 1).select(*CONTENT_COLUMNS)
    blocks.merge(table, batch, run="run=a")
    want = counts(aggregates.report_cube(table.read()))
    remove(spark, table.path)
    report.follow_merge(spark.read.parquet(f"{table.path}-changes/run=a"), batch, "a")
    assert counts(report.cube()) == want


def test_empty_table_and_empty_batch(spark, tmp_path):
    table, report = begun(spark, tmp_path, [])
    assert report.cube().count() == 0
    merged(spark, table, report, articles(spark, [1]).limit(0).select(*CONTENT_COLUMNS), "upsert", "a")
    merged(spark, table, report, articles(spark, [7, 8]).select(*CONTENT_COLUMNS), "skip", "b")
    same(report, table)


def test_a_report_is_built_from_it(spark, tmp_path):
    table, report = begun(spark, tmp_path)
    got = aggregates.build_report(table.read(), table.read(), cube=report.cube())
    want = aggregates.build_report(table.read(), table.read())
    assert got.metrics.first() == want.metrics.first()
    assert got.top_categories.collect() == want.top_categories.collect()

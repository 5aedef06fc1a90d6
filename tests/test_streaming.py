"""Incremental runs: what arrives later is merged, what is replayed changes nothing."""

import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from articleflow.operators import ingest
from articleflow.plans import bindings
from articleflow.schemas import CLEAN_ARTICLES, RAW_ARTICLES
from articleflow.sources.tables import read_parts
from articleflow.streaming import incremental
from tests.test_operators import COLLECTED


def drop(spark, folder, *rows):
    """Put one more file of collected items into a folder."""
    full = [("src", True, seq, 1, url, title, "b", None, url, "AI", "https://src", None) for seq, url, title in rows]
    spark.createDataFrame(full, COLLECTED).coalesce(1).write.mode("append").parquet(str(folder))


def test_raw_stream(spark, tmp_path):
    inbox, table, log = tmp_path / "in", str(tmp_path / "raw"), str(tmp_path / "log")
    drop(spark, inbox, (0, "https://h/1", "one"), (1, "https://h/1#again", "dup"), (2, "https://h/2", "two"))

    def run(checkpoint=log):
        stream = spark.readStream.schema(COLLECTED).parquet(str(inbox))
        incremental.stream_raw(ingest.to_raw_rows(stream, "rss"), table, checkpoint).awaitTermination()
        return sorted((r.id, r.canonical_url, json.loads(r.raw_payload)["title"]) for r in read_parts(spark, table, RAW_ARTICLES).collect())

    first = run()
    assert first == [(1, "https://h/1", "one"), (2, "https://h/2", "two")]
    assert run() == first
    drop(spark, inbox, (10, "https://h/2", "later"), (11, "https://h/3", "three"))
    second = run()
    assert second == first + [(3, "https://h/3", "three")]
    # A lost log makes every file arrive again, as batch 0.
    assert [row[1:] for row in run(str(tmp_path / "log2"))][:2] == [row[1:] for row in first]


def raw_files(spark, folder, *rows):
    full = [
        (i, None, "src", None, "rss", datetime(2026, 8, 6), url, json.dumps({"title": title, "url": url}), "ok", None) for i, url, title in rows
    ]
    spark.createDataFrame(full, RAW_ARTICLES).coalesce(1).write.mode("append").parquet(str(folder))


def test_clean_stream_skip(spark, tmp_path):
    inbox, table = tmp_path / "raw", str(tmp_path / "clean")
    run = lambda: incremental.stream_clean(spark.readStream.schema(RAW_ARTICLES).parquet(str(inbox)), table, str(tmp_path / "log")).awaitTermination()
    raw_files(spark, inbox, (1, "https://h/1", "a"), (2, "https://h/2", " "))
    run()
    raw_files(spark, inbox, (3, "https://h/1", "b"), (4, "https://h/4", "c"))
    run()
    rows = read_parts(spark, table, CLEAN_ARTICLES).orderBy("id").collect()
    assert [(r.id, r.raw_id, r.title) for r in rows] == [(1, 1, "a"), (2, 4, "c")]


def test_clean_stream_upsert(spark, tmp_path):
    inbox, table = tmp_path / "raw", str(tmp_path / "clean")
    run = lambda: incremental.stream_clean(
        spark.readStream.schema(RAW_ARTICLES).parquet(str(inbox)), table, str(tmp_path / "log"), policy="upsert"
    ).awaitTermination()
    raw_files(spark, inbox, (1, "https://h/1", "a"))
    run()
    raw_files(spark, inbox, (3, "https://h/1", "b"), (4, "https://h/4", "c"))
    run()
    rows = incremental.upserted(spark, table).orderBy("id").collect()
    assert [(r.id, r.raw_id, r.title) for r in rows] == [(1, 3, "b"), (2, 4, "c")]
    assert sorted(os.listdir(tmp_path)) == ["clean", "clean-changes", "clean-conflicts", "clean-counts", "clean-rejects", "log", "raw"]


def test_clean_stream_keeps_rejects_counts_and_conflicts(spark, tmp_path):
    inbox, table = tmp_path / "raw", str(tmp_path / "clean")
    run = lambda: incremental.stream_clean(
        spark.readStream.schema(RAW_ARTICLES).parquet(str(inbox)), table, str(tmp_path / "log"), policy="upsert"
    ).awaitTermination()
    raw_files(spark, inbox, (1, "https://h/1", "a"), (2, "https://h/2", " "))
    run()
    raw_files(spark, inbox, (3, "https://h/1", "b"), (4, "https://h/4", ""))
    run()
    assert sorted(r.id for r in incremental.batch_rejects(spark, table).collect()) == [2, 4]
    counts = {r.part: r for r in incremental.batch_counts(spark, table).collect()}
    assert [(counts[n].inserted, counts[n].updated, counts[n].invalid) for n in (0, 1)] == [(1, 0, 1), (0, 1, 1)]
    assert incremental.batch_conflicts(spark, table).count() == 0


def in_six_files(spark, folder, events):
    """The events dealt over six files in random order, one micro-batch each."""
    rows = spark.read.parquet(events)
    for part in rows.randomSplit([1.0] * 6, seed=3):
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_rows_change_no_result(spark, tmp_path):
    events = "/root/testdata/sf0.001/events.parquet"
    stream = in_six_files(spark, tmp_path / "in", events)
    moments = stream.select(F.col("ts").cast("timestamp").alias("collected_at"))
    incremental.stream_daily_trend(moments, str(tmp_path / "days"), str(tmp_path / "log1")).awaitTermination()
    whole = spark.read.parquet(events).groupBy(F.to_date("ts").alias("day")).count()
    assert sorted(map(tuple, incremental.daily_trend(spark, str(tmp_path / "days")).collect())) == sorted(map(tuple, whole.collect()))
    keys = lambda df: bindings.as_fetched(df).select("source_name", F.col("url").alias("canonical_url"))
    incremental.stream_distinct_urls(keys(stream), str(tmp_path / "urls"), str(tmp_path / "log2")).awaitTermination()
    found = sorted(map(tuple, incremental.distinct_urls(spark, str(tmp_path / "urls")).collect()))
    assert found == sorted(map(tuple, keys(spark.read.parquet(events)).distinct().collect()))


def test_a_batch_costs_what_is_in_it(spark, tmp_path):
    """Twelve batches of as many rows, some of them again: a late one reads no more bytes than an early one, and nothing stays behind."""
    inbox, table = tmp_path / "in", str(tmp_path / "raw")
    scratch_before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    for batch in range(12):
        rows = [(batch * 100 + i, f"https://h/{(batch * 50 + i) if i < 50 else i}", f"t{batch}-{i}") for i in range(100)]
        drop(spark, inbox, *rows)
    read = []
    statistics = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    def counting(step):
        def run(batch, number):
            before = statistics()
            step(batch, number)
            read.append(statistics() - before)

        return run

    real = incremental._run
    incremental._run = lambda stream, step, *rest: real(stream, counting(step), *rest)
    try:
        stream = spark.readStream.schema(COLLECTED).option("maxFilesPerTrigger", 1).parquet(str(inbox))
        incremental.stream_raw(ingest.to_raw_rows(stream, "rss"), table, str(tmp_path / "log")).awaitTermination()
    finally:
        incremental._run = real
    assert len(read) == 12
    assert max(read[8:]) < 1.5 * max(read[1:5])
    stored = read_parts(spark, table, RAW_ARTICLES).collect()
    first = {}
    for batch in range(12):
        for i in range(100):
            first.setdefault(f"https://h/{(batch * 50 + i) if i < 50 else i}", f"t{batch}-{i}")
    assert {r.canonical_url: json.loads(r.raw_payload)["title"] for r in stored} == first
    assert sorted(r.id for r in stored) == list(range(1, len(first) + 1))
    assert set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == scratch_before
    assert len(os.listdir(table + incremental.IDS)) == 2

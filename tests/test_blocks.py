"""Merges and updates of tables in blocks: same rows as the merges of whole tables, and untouched files stay."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from articleflow.operators import blocks, merge
from articleflow.plans import bindings
from articleflow.schemas import CLEAN_ARTICLES, CONTENT_COLUMNS
from articleflow.session import materialize

SMALL = "/root/testdata/sf0.001"


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                full = os.path.join(folder, name)
                found[os.path.relpath(full, path)] = os.stat(full).st_mtime_ns
    return found


def rows_of(df):
    return sorted(map(tuple, df.select(*CLEAN_ARTICLES.names).collect()), key=lambda r: r[0])


def articles(spark, ids, title="old", summary="s"):
    at = datetime(2026, 8, 6)
    rows = [(i, i * 10, f"{title} {i}", "body", f"https://h/{i}", "src", "AI", None, at, f"hash {title} {i}", "ok", summary, "m", at, 4, 1) for i in ids]
    return spark.createDataFrame(rows, CLEAN_ARTICLES)


@pytest.fixture(scope="module")
def merged(spark):
    return materialize(bindings.merge_batch(spark, SMALL)), bindings.merge_target(spark, SMALL)


@pytest.mark.parametrize("policy", ["upsert", "skip"])
def test_merge_equals_that_of_whole_tables(spark, tmp_path, merged, policy):
    batch, target = merged
    table = blocks.store(target, str(tmp_path / "clean"), width=50)
    outcome = blocks.merge(table, batch, policy=policy)
    whole = merge.merge_upsert(batch, target) if policy == "upsert" else merge.merge_skip(batch, target)
    assert rows_of(table.read()) == rows_of(whole)
    assert outcome.stats.first() == merge.merge_counts(batch, target, policy).first()


def test_small_upsert_rewrites_only_its_blocks(spark, tmp_path):
    path = str(tmp_path / "clean")
    table = blocks.store(articles(spark, range(1, 1001)), path, width=100)
    before = files(path)
    assert len(table.blocks()) == 11
    ids = [203, 204, 207, 250, 251, 640, 641, 642, 643, 644]
    batch = articles(spark, ids, "new").select(*CONTENT_COLUMNS)
    assert blocks.merge(table, batch).touched == [2, 6]
    after = files(path)
    unchanged = {name: at for name, at in before.items() if not name.startswith(("block=2/", "block=6/"))}
    assert unchanged.items() <= after.items()
    assert not {name for name in before if name.startswith(("block=2/", "block=6/"))} & set(after)
    titles = {r.id: (r.title, r.summary) for r in table.read().collect()}
    assert len(titles) == 1000 and all(titles[i] == (f"{'new' if i in ids else 'old'} {i}", "s") for i in titles)


def test_inserts_go_to_the_last_blocks(spark, tmp_path):
    path = str(tmp_path / "clean")
    table = blocks.store(articles(spark, range(1, 151)), path, width=100)
    first_block = {name: at for name, at in files(path).items() if name.startswith("block=0/")}
    new = articles(spark, range(500, 600), "new").select(*CONTENT_COLUMNS)
    assert blocks.merge(table, new).touched == [1, 2]
    assert first_block.items() <= files(path).items()
    assert sorted(r.id for r in table.read().collect()) == list(range(1, 251))
    assert table.last_id() == 250 and table.by_id(151).first().title == "new 500"


def test_a_run_that_comes_again_gives_the_same_table(spark, tmp_path):
    """A job that died after the first of its blocks: the run goes by its stored decisions."""
    table = blocks.store(articles(spark, range(1, 201)), str(tmp_path / "clean"), width=100)
    batch = materialize(articles(spark, [50, 900, 901, 902], "new").select(*CONTENT_COLUMNS))
    blocks.merge(table, batch, run="part=0")
    want = rows_of(table.read())
    old = articles(spark, range(1, 201))
    table.replace(old.where("id < 100"))  # the first block as it was
    outcome = blocks.merge(table, batch, run="part=0")
    assert rows_of(table.read()) == want and len(want) == 203
    assert (outcome.stats.first().inserted, outcome.stats.first().updated) == (3, 1)
    blocks.merge(table, batch, run="part=1")
    assert rows_of(table.read()) == want
    assert os.listdir(f"{table.path}-changes") == ["part=1"]


def test_keyed_updates(spark, tmp_path):
    path = str(tmp_path / "clean")
    table = blocks.store(articles(spark, range(1, 301)), path, width=100)
    before = files(path)
    at = F.to_timestamp(F.lit("2026-08-07"))
    new = spark.createDataFrame([(150, "short"), (5000, "nobody")], "id long, summary string").select(
        "id", "summary", F.lit("m2").alias("summary_model"), at.alias("summarized_at"), F.lit(9).cast("long").alias("original_length")
    )
    assert blocks.write_summaries(table, new) == [1, 50]
    row = table.by_id(150).first()
    assert (row.summary, row.summary_model, row.summary_length, row.original_length) == ("short", "m2", 5, 9)
    assert table.read().count() == 300
    assert {n: t for n, t in before.items() if not n.startswith("block=1/")}.items() <= files(path).items()


def test_empty_table_and_empty_batch(spark, tmp_path):
    table = blocks.BlockTable(spark, str(tmp_path / "clean"), width=10)
    assert table.read().count() == 0 and table.last_id() == 0
    nothing = articles(spark, [1]).select(*CONTENT_COLUMNS).limit(0)
    assert blocks.merge(table, nothing).touched == []
    blocks.merge(table, articles(spark, [7, 8], "new").select(*CONTENT_COLUMNS), policy="skip")
    assert sorted((r.id, r.raw_id) for r in table.read().collect()) == [(1, 70), (2, 80)]
    with pytest.raises(ValueError):
        blocks.merge(table, nothing, policy="other")

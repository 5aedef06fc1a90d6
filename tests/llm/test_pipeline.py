import corpus_pipeline
import pytest

from articleflow.llm import quality
from articleflow.llm.common import fold, table
from articleflow.llm.jaccard import near_duplicates
from articleflow.llm.queries import QUERIES
from articleflow.llm.sql import SQL

from . import cases
from .test_jaccard import brute as components
from .test_lines import brute as lines

SMALL = "/root/testdata/sf0.001"


def test_stages_one_after_another_equal_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    model = quality.train(docs, table(spark, SMALL, "labels"), fold("doc_id", 3) != 1, metadata=("n_chars",))
    scores = {r.doc_id: r.score for r in docs.select("doc_id", quality.score(model, metadata=("n_chars",)).alias("score")).collect()}
    (_, good), (_, thin), (_, single), (_, clean), (_, pack) = corpus_pipeline.STAGES
    kept = good(spark, docs, SMALL)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if p >= 0.5}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    shorter = thin(spark, kept, SMALL)
    assert shorter.schema == docs.schema and sorted((r.doc_id, r.text, r.n_chars) for r in shorter.collect()) == [(i, t, len(t)) for i, _, _, t in lines(rows)]
    rows = [(r.doc_id, r.text) for r in shorter.collect()]
    one = single(spark, shorter, SMALL)
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in components(rows).items() if i == c)
    left = clean(spark, one, SMALL)
    items = [r.text for r in table(spark, SMALL, "benchmark").collect()]
    held = {r.doc_id for r in one.collect() if any(t in r.text for t in items)}
    assert left.columns == columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in one.collect()} - held
    pieces = pack(spark, left, SMALL)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in left.collect()}


def test_stages_stand_awkward_rows_and_keep_other_columns(spark, tmp_path):
    docs = cases.documents(spark).unionAll(cases.awkward(spark))
    spark.createDataFrame([(1, 1), (9, 0)], "doc_id int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, cases.SHARED[4])], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, cases.empty(spark)):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert rows.schema == docs.schema
        rows.count()


def test_every_operator_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = QUERIES[name](spark, SMALL), con.sql(SQL[name])
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_near_duplicates_of_the_sample_tables_need_no_id(spark):
    docs = table(spark, SMALL, "documents").selectExpr("cast(null as bigint) as doc_id", "text")
    assert near_duplicates(docs).filter("label is not null").select("label").distinct().count() > 100

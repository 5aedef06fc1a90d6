"""Ingest, cleaning, merging, queries, reports, model calls and exports on small tables."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from articleflow import schemas
from articleflow.operators import aggregates, analysis, cleaning, completion, ingest, merge, query
from articleflow.operators.numbering import number_rows
from articleflow.sources import exports, tables

UTC = timezone.utc


def at(month, day, hour=0):
    return datetime(2026, month, day, hour)


def clean_table(spark, *rows):
    """Clean rows given as dictionaries; what is not said is filled in."""
    full = []
    for i, row in enumerate(rows, start=1):
        base = {
            "id": i, "raw_id": i, "title": f"title {i}", "body": "some body", "url": f"https://h/{i}", "source": "s1", "category": "AI",
            "published_at": at(8, 5), "collected_at": at(8, 6), "content_hash": None, "clean_status": "ok", "summary": None,
            "summary_model": None, "summarized_at": None, "original_length": 9, "summary_length": None,
        } | row
        full.append(tuple(base[name] for name in schemas.CLEAN_ARTICLES.names))
    return spark.createDataFrame(full, schemas.CLEAN_ARTICLES)


def raw_table(spark, *rows):
    full = []
    for i, row in enumerate(rows, start=1):
        base = {
            "id": i, "external_id": None, "source_name": "src", "source_url": None, "collection_method": "rss", "collected_at": at(8, 6),
            "canonical_url": f"https://h/{i}", "raw_payload": json.dumps({"title": f"t{i}", "url": f"https://h/{i}", "body": f"b{i}"}),
            "status": "ok", "error_message": None,
        } | row
        full.append(tuple(base[name] for name in schemas.RAW_ARTICLES.names))
    return spark.createDataFrame(full, schemas.RAW_ARTICLES)


# -- numbering -------------------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_number_rows(spark, partitions):
    values = random.Random(1).sample(range(1 << 40), 300) + [5, 6, 7, (1 << 62) + 3]
    rows = spark.createDataFrame([(v, v % 3) for v in values], "v long, g long").repartition(partitions)
    want = {v: n for n, v in enumerate(sorted(values), start=1)}
    assert {r.v: r.n for r in number_rows(rows, "v", "n").collect()} == want
    got = {(r.g, r.v): r.n for r in number_rows(rows, "v", "n", by=["g"]).collect()}
    for g in range(3):
        assert [got[(g, v)] for v in sorted(values) if v % 3 == g] == list(range(1, sum(v % 3 == g for v in values) + 1))


# -- ingest ----------------------------------------------------------------------------------------

COLLECTED = (
    "source_name string, ok boolean, seq long, attempted int, url string, title string, body string, published_raw string, "
    "external_id string, category string, source_url string, error string"
)


def collected(spark, *rows):
    full = []
    for i, (url, title, error) in enumerate(rows):
        full.append(("src", error is None, i, 1, url, title, "b", None, url, "AI", "https://src", error))
    return spark.createDataFrame(full, COLLECTED)


@pytest.fixture()
def batch(spark):
    return collected(
        spark, ("https://H/1#x", "one", None), ("https://h/1", "again", None), ("https://h/2", "", None), ("  ", "no url", None),
        ("https://h/3", None, "HTTP 500"), ("https://h/3", "three", None), ("", None, "broken"),
    )


def test_raw_rows(batch):
    rows = {r.seq: r for r in ingest.to_raw_rows(batch, "rss").collect()}
    assert rows[0].canonical_url == "https://h/1" and rows[0].status == "ok"
    assert json.loads(rows[0].raw_payload) == {
        "source": "src", "url": "https://H/1#x", "title": "one", "body": "b", "published_at": None, "category": "AI", "external_id": "https://H/1#x",
    }
    assert (rows[2].status, rows[2].error_message) == ("partial", ingest.NO_TITLE)
    failed = [r for seq, r in rows.items() if seq > 1000]
    assert {json.loads(r.raw_payload)["error"] for r in failed} == {"HTTP 500", "broken"}


def test_insert_first_wins_and_stats(spark, batch):
    rows = ingest.to_raw_rows(batch, "rss")
    empty = raw_table(spark).limit(0)
    stored = ingest.insert_raw(rows, empty)
    got = [(r.id, r.canonical_url, r.status) for r in stored.orderBy("id").collect()]
    assert got == [(1, "https://h/1", "ok"), (2, "https://h/2", "partial"), (3, "https://h/3", "ok")]
    stats = ingest.fetch_run_stats(rows, ingest.new_raw_keys(rows, empty)).first()
    assert (stats.attempted_count, stats.success_count, stats.failure_count, stats.duplicate_count) == (7, 3, 3, 1)
    again = ingest.fetch_run_stats(rows, ingest.new_raw_keys(rows, stored)).first()
    assert (again.success_count, again.failure_count, again.duplicate_count) == (0, 3, 4)
    assert ingest.insert_raw(rows, stored).count() == 0


def test_same_url_other_source(spark):
    rows = ingest.to_raw_rows(collected(spark, ("https://h/1", "a", None)), "rss")
    stored = raw_table(spark, {"source_name": "other", "canonical_url": "https://h/1"})
    assert [r.id for r in ingest.insert_raw(rows, stored).collect()] == [2]


def test_retried_errors(spark):
    stored = raw_table(spark, {"canonical_url": "https://h/1", "status": "error"}, {"canonical_url": "https://h/2"})
    rows = ingest.to_raw_rows(collected(spark, ("https://h/1", "now", None), ("https://h/2", "x", None)), "rss")
    assert ingest.insert_raw(rows, stored).count() == 0
    fixed = {r.id: r for r in ingest.retried_errors(rows, stored).collect()}
    assert fixed[1].status == "ok" and json.loads(fixed[1].raw_payload)["title"] == "now"
    assert json.loads(fixed[2].raw_payload)["title"] == "t2"


# -- cleaning --------------------------------------------------------------------------------------


def payload(**fields):
    return json.dumps(fields, ensure_ascii=False)


CASES = [
    (payload(title="<b>제목</b>", url="https://Example.test/a?utm_source=x#y", body="<p>본문&nbsp;입니다</p>", category="AI", published_at="Mon, 04 Aug 2026 09:30:00 +0000"),
     ("제목", "https://example.test/a", "본문 입니다", "AI", at(8, 4, 9).replace(minute=30), "ok", None)),
    (payload(title="t", url=""), ("t", "https://h/2", None, "unknown", None, "no_body", None)),
    (payload(title="t", body="  ", summary="s"), ("t", "https://h/3", None, "unknown", None, "no_body", None)),
    (payload(title="t", body="", summary="", description="d", published="2026-08-05"), ("t", "https://h/4", "d", "unknown", at(8, 5), "ok", None)),
    (payload(title="t", published_at=[2026, 8, 5, 1, 2, 3, 0, 0, 0]), ("t", "https://h/5", None, "unknown", datetime(2026, 8, 5, 1, 2, 3), "no_body", None)),
    (payload(title="t", body=0, summary=[], description="d", category=None), ("t", "https://h/6", "d", "unknown", None, "ok", None)),
    (payload(title="t", body=float("nan")), cleaning.BAD_TYPE),
    (payload(title=" "), cleaning.NO_TITLE),
    (payload(url="https://h/x"), cleaning.NO_TITLE),
    (payload(title=5), cleaning.BAD_TYPE),
    (payload(title="t", body={"a": 1}), cleaning.BAD_TYPE),
    (payload(title="t", url="http://[x"), cleaning.NO_URL),
    ("{broken", cleaning.BAD_JSON),
    ("", cleaning.BAD_JSON),
    ('["x"]', cleaning.BAD_JSON),
    ('"text"', cleaning.BAD_JSON),
    ("null", cleaning.BAD_JSON),
    ("{'title': 't'}", cleaning.BAD_JSON),
    ('{"title":"t"} tail', cleaning.BAD_JSON),
    ('{"title":"t"}]', cleaning.BAD_JSON),
    ('{"title":"a","title":"last"}', ("last", "https://h/21", None, "unknown", None, "no_body", None)),
]


def test_clean_rows(spark):
    built = cleaning.build_clean_rows(raw_table(spark, *[{"raw_payload": p} for p, _ in CASES]))
    rows = {r.raw_id: r for r in built.collect()}
    for i, (_, want) in enumerate(CASES, start=1):
        row = rows[i]
        if isinstance(want, str):
            assert row.reject_reason == want % i, i
        else:
            assert (row.title, row.url, row.body, row.category, row.published_at, row.clean_status, row.reject_reason) == want, i
            assert row.original_length == len(row.body or "") and len(row.content_hash) == 64 and row.source == "src"


def test_source_name_falls_back_to_payload(spark):
    raw = raw_table(spark, {"source_name": "", "raw_payload": payload(title="t", source="paper")}, {"source_name": ""})
    assert [r.source for r in cleaning.build_clean_rows(raw).orderBy("raw_id").collect()] == ["paper", "unknown"]


def test_cleaning_is_idempotent(spark):
    raw = raw_table(
        spark, {}, {}, {"raw_payload": payload(title="")}, {"status": "partial"}, {"raw_payload": payload(title="x", url="https://h/1/")}
    )
    empty = clean_table(spark).limit(0)
    first = merge.clean_articles(raw, empty)
    stats = first.stats.first()
    assert (stats.processed, stats.inserted, stats.updated, stats.skipped, stats.invalid) == (4, 2, 0, 1, 1)
    assert {r.id: r.status for r in first.raw.collect()} == {1: "ok", 2: "ok", 3: "invalid", 4: "partial", 5: "ok"}
    second = merge.clean_articles(first.raw, first.clean)
    stats = second.stats.first()
    assert (stats.processed, stats.inserted, stats.skipped, stats.invalid) == (3, 0, 3, 0)
    third = merge.clean_articles(first.raw, second.clean, policy="upsert")
    stats = third.stats.first()
    assert (stats.inserted, stats.updated, stats.skipped) == (0, 3, 0)
    assert sorted((r.id, r.title) for r in third.clean.collect()) == [(1, "x"), (2, "t2")]
    limited = merge.clean_articles(raw, empty, limit=1)
    assert [r.raw_id for r in limited.clean.collect()] == [1]
    with pytest.raises(ValueError):
        merge.clean_articles(raw, empty, policy="replace")


# -- merging ---------------------------------------------------------------------------------------


def batch_rows(spark, *rows):
    """Batch rows as (raw_id, url, title)."""
    full = [(r, t, "b", u, "s", "c", None, at(8, 6), "h" + t, "ok", 1) for r, u, t in rows]
    kinds = ", ".join(f"{name} {schemas.CLEAN_ARTICLES[name].dataType.simpleString()}" for name in schemas.CONTENT_COLUMNS)
    return spark.createDataFrame(full, kinds)


def test_upsert_keeps_summary_and_flags_stale(spark):
    stored = clean_table(spark, {"summary": "kept", "content_hash": "old"}, {"content_hash": "hsame"})
    new = batch_rows(spark, (1, "https://h/1", "fresh"), (2, "https://h/2", "same"), (9, "https://h/9", "new"))
    rows = {r.id: r for r in merge.merge_upsert(new, stored, mark_stale=True).collect()}
    assert (rows[1].title, rows[1].summary, rows[1].summary_stale) == ("fresh", "kept", True)
    assert (rows[2].title, rows[2].summary_stale) == ("same", False)
    assert (rows[3].raw_id, rows[3].summary) == (9, None)


def row_by_row(table, rows, policy):
    """The merge as a loop over rows, in order; None when a row hits two stored rows."""
    table, counts = [dict(t) for t in table], {"inserted": 0, "updated": 0, "skipped": 0}
    next_id = max((t["id"] for t in table), default=0) + 1
    for raw_id, url, title in sorted(rows):
        hits = [t for t in table if t["raw_id"] == raw_id or t["url"] == url]
        if policy == "skip" and hits:
            counts["skipped"] += 1
        elif len(hits) > 1:
            return None
        elif hits:
            hits[0].update(raw_id=raw_id, url=url, title=title)
            counts["updated"] += 1
        else:
            table.append({"id": next_id, "raw_id": raw_id, "url": url, "title": title})
            next_id, counts["inserted"] = next_id + 1, counts["inserted"] + 1
    return table, counts


@pytest.mark.parametrize("policy", ["skip", "upsert"])
def test_merge_equals_row_loop(spark, policy):
    """Many random small merges at once: every case has keys of its own."""
    dice = random.Random(7)
    stored, incoming, cases = [], [], []
    for case in range(1500):
        name = lambda n: f"https://{case}/{n}"
        raws, links = dice.sample(range(6), dice.randint(0, 4)), dice.sample(range(5), 4)
        table = [{"id": case * 100 + i + 1, "raw_id": case * 100 + r, "url": name(u), "title": "old"} for i, (r, u) in enumerate(zip(raws, links))]
        rows = [(case * 100 + r, name(dice.randrange(5)), f"n{r}") for r in dice.sample(range(6), dice.randint(1, 5))]
        stored, incoming = stored + table, incoming + rows
        cases.append((case, table, rows))
    target = clean_table(spark, *stored)
    batch = batch_rows(spark, *incoming).repartition(5)
    merged = merge.merge_skip(batch, target) if policy == "skip" else merge.merge_upsert(batch, target)
    got = {}
    for r in merged.select("id", "raw_id", "url", "title").collect():
        got.setdefault(int(r.url.split("/")[2]), []).append(r)
    conflicts = set()
    if policy == "upsert":
        decisions = merge.upsert_decisions(batch, target)
        conflicts = {int(r.url.split("/")[2]) for r in decisions.where("action = 'conflict'").select("url").collect()}
    last_id = max(t["id"] for t in stored)
    compared = 0
    for case, table, rows in cases:
        want = row_by_row(table, rows, policy)
        if want is None or case in conflicts:
            assert policy == "upsert"
            continue
        compared += 1
        old = {t["id"] for t in table}
        key = lambda i, raw, url, title: (i if i in old else None, raw, url, title)
        assert sorted((key(r.id, r.raw_id, r.url, r.title) for r in got.get(case, [])), key=repr) == sorted(
            (key(t["id"], t["raw_id"], t["url"], t["title"]) for t in want[0]), key=repr
        ), (case, table, rows)
        assert all(r.id in old or r.id > last_id for r in got.get(case, []))
    assert compared > (1490 if policy == "skip" else 700)


@pytest.mark.parametrize("policy", ["skip", "upsert"])
def test_merge_counts_and_new_id_order(spark, policy):
    target = clean_table(spark, {"raw_id": 1, "url": "https://h/1"})
    batch = batch_rows(spark, (1, "https://h/1", "a"), (7, "https://h/7", "b"), (5, "https://h/5", "c"), (6, "https://h/7", "d"), (9, "https://h/1", "e"))
    counts = merge.merge_counts(batch, target, policy).first()
    want = row_by_row([{"id": 1, "raw_id": 1, "url": "https://h/1", "title": "x"}], [(1, "https://h/1", "a"), (7, "https://h/7", "b"), (5, "https://h/5", "c"), (6, "https://h/7", "d"), (9, "https://h/1", "e")], policy)
    assert counts.asDict() == want[1] | {"conflicts": 0}
    merged = merge.merge_skip(batch, target) if policy == "skip" else merge.merge_upsert(batch, target)
    assert sorted((r.id, r.raw_id, r.url) for r in merged.collect()) == sorted((t["id"], t["raw_id"], t["url"]) for t in want[0])


def test_conflicts_are_listed(spark):
    target = clean_table(spark, {"raw_id": 1, "url": "https://h/1"}, {"raw_id": 2, "url": "https://h/2"})
    batch = batch_rows(spark, (1, "https://h/2", "both"), (3, "https://h/3", "new"))
    decisions = merge.upsert_decisions(batch, target)
    assert [r.raw_id for r in merge.upsert_conflicts(batch, decisions).collect()] == [1]
    assert sorted(r.url for r in merge.merge_upsert(batch, target).collect()) == ["https://h/1", "https://h/2", "https://h/3"]
    assert merge.merge_counts(batch, target, "upsert").first().conflicts == 1


def test_keyed_updates_and_orphans(spark):
    clean = clean_table(spark, {}, {"raw_id": 77})
    assert [r.id for r in merge.orphans(clean, raw_table(spark, {}, {})).collect()] == [2]
    new = spark.createDataFrame([(2, "요약문", "m", at(9, 1), 9)], "id long, summary string, summary_model string, summarized_at timestamp, original_length long")
    rows = {r.id: r for r in merge.update_summaries(clean, new).collect()}
    assert rows[1].summary is None and (rows[2].summary, rows[2].summary_length, rows[2].summary_model) == ("요약문", 3, "m")


def test_duplicate_content(spark):
    clean = clean_table(spark, {"content_hash": "x", "source": "b"}, {"content_hash": "x", "source": "a"}, {"content_hash": "y"}, {})
    assert [tuple(r) for r in merge.duplicate_content(clean).collect()] == [("x", 2, 1, ["a", "b"])]


# -- queries ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def articles(spark):
    return clean_table(
        spark,
        {"published_at": at(7, 1), "category": "IT", "title": "제목 100% Done"},
        {"published_at": at(8, 9, 23), "category": "AI", "summary": "s", "body": None},
        {"published_at": None, "collected_at": at(8, 10, 5), "category": "", "source": "s2", "summary": " ", "body": "Élan vital"},
        {"published_at": at(8, 9, 23), "category": "AI", "body": " ", "summary": "x"},
    )


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    "filters, want",
    [
        ({}, [1, 2, 4, 3]),
        ({"order": "DESC"}, [3, 4, 2, 1]),
        ({"date_from": "2026-08-01"}, [2, 4, 3]),
        ({"date_to": "2026-07-31"}, [1]),
        ({"date_from": "2026-08-09", "date_to": "2026-08-09"}, [2, 4]),
        ({"date_to": at(8, 9, 23).replace(tzinfo=UTC)}, [1, 2, 4]),
        ({"category": "AI"}, [2, 4]),
        ({"category": "ai"}, []),
        ({"source": "s2"}, [3]),
        ({"status": "summarized"}, [2, 4]),
        ({"status": "unsummarized"}, [1, 3]),
        ({"require_body": True}, [1, 3]),
        ({"keyword": "제목"}, [1]),
        ({"keyword": "DONE"}, [1]),
        ({"keyword": "0% d"}, [1]),
        ({"keyword": "él"}, []),
        ({"keyword": "ÉLAN"}, [3]),
        ({"keyword": "t_tle"}, [2, 4, 3]),
        ({"keyword": "a\\b"}, []),
        ({"limit": 2, "offset": 1}, [2, 4]),
        ({"offset": 3}, [3]),
    ],
)
def test_query(articles, filters, want):
    assert ids(query.query_articles(articles, **filters)) == want


def test_unknown_status(articles):
    with pytest.raises(ValueError):
        query.filter_articles(articles, status="odd")


def test_pages(articles):
    assert query.page_count(articles, 3).first().asDict() == {"total": 4, "pages": 2}
    assert query.page_count(articles, 3, source="none").first().asDict() == {"total": 0, "pages": 1}
    pages = [ids(query.list_page(articles, n, 3)) for n in (1, 2, 3)]
    assert pages == [[3, 4, 2], [1], []]
    assert ids(query.list_page_after(articles, None, None, 3)) == pages[0]
    assert ids(query.list_page_after(articles, at(8, 9, 23).replace(tzinfo=UTC), 2, 3)) == pages[1]


def test_views(articles):
    listed = {r.id: r for r in query.list_view(articles).collect()}
    assert (listed[3].marker, listed[3].day, listed[2].marker) == ("요약X", "2026-08-10", "요약O")
    shown = {r.id: r for r in query.detail_view(articles).collect()}
    assert (shown[2].body_preview, shown[1].summary, shown[3].published) == ("(본문 없음)", "(요약 없음)", "-")
    long = clean_table(articles.sparkSession, {"body": "x" * 2001})
    assert query.detail_view(long).first().body_preview == "x" * 2000 + "\n...(생략)"


# -- reports ---------------------------------------------------------------------------------------


def test_counts(articles):
    assert [tuple(r) for r in aggregates.category_counts(articles).collect()] == [("AI", 2), ("IT", 1), ("unknown", 1)]
    assert [tuple(r) for r in aggregates.source_counts(articles).collect()] == [("s1", 3), ("s2", 1)]
    assert [(str(r.day), r.n) for r in aggregates.daily_counts(articles).collect()] == [("2026-08-06", 3), ("2026-08-10", 1)]
    assert aggregates.count_articles(articles, category="AI", limit=1).first().n == 2
    top = aggregates.top_counts(aggregates.category_counts(articles), "category", 2)
    assert [tuple(r) for r in top.collect()] == [(1, "AI", 2), (2, "IT", 1)]


def test_report(spark, articles):
    raw = raw_table(spark, {}, {}, {}, {}, {"status": "error"})
    metrics = aggregates.report_metrics(articles, raw).first()
    assert (metrics.raw_count, metrics.clean_count, metrics.body_count, metrics.summarized_count) == (5, 4, 2, 2)
    assert (metrics.clean_rate, metrics.body_rate, metrics.summary_rate) == (0.8, 0.5, 0.5)
    report = aggregates.build_report(articles, raw, top_n=1)
    assert report.metrics.select(*metrics.asDict()).first() == metrics
    assert [tuple(r) for r in report.top_categories.collect()] == [(1, "AI", 2)]
    assert [tuple(r) for r in report.top_sources.collect()] == [(1, "s1", 3)]
    assert [r.n for r in report.daily.collect()] == [3, 1]
    only = aggregates.build_report(articles, raw, category="AI").metrics.first()
    assert (only.clean_count, only.clean_rate) == (2, 0.4)


def test_empty_report(spark, articles):
    metrics = aggregates.build_report(articles.limit(0), raw_table(spark).limit(0)).metrics.first()
    assert metrics.raw_count == metrics.clean_count == 0
    assert metrics.clean_rate == metrics.body_rate == metrics.summary_rate == 0.0


# -- model calls -----------------------------------------------------------------------------------


def scripted(**replies):
    return lambda: completion.KeyedClient({int(k[1:]): v for k, v in replies.items()})


def test_summarize_isolates_failures(spark):
    clean = clean_table(spark, {}, {}, {}, {"summary": "done"}, {})
    factory = scripted(_1=" 요약 하나 ", _2=completion.ModelError("limit"), _3="  ", _5=KeyError("x"))
    result = completion.summarize(clean, factory, model="m", mode="all")
    got = {r.id: (r.outcome, r.error) for r in result.outcomes.collect()}
    assert got == {1: ("succeeded", None), 2: ("failed", "limit"), 3: ("failed", completion.EMPTY_REPLY), 5: ("failed", "KeyError")}
    assert result.stats.first().asDict() == {"attempted": 4, "succeeded": 1, "failed": 3, "skipped": 0}
    stored = {r.id: r for r in merge.update_summaries(clean, result.summaries).collect()}
    assert (stored[1].summary, stored[1].summary_model, stored[1].summary_length, stored[1].original_length) == ("요약 하나", "m", 5, 9)
    assert stored[4].summary == "done" and stored[2].summary is None


def test_summarize_modes(spark):
    clean = clean_table(spark, {}, {"summary": "done"}, {})
    echo = lambda: completion.HandlerClient(lambda system, prompt: "r")
    stats = lambda **options: completion.summarize(clean, echo, stage=False, **options).stats.first().asDict()
    assert stats() == {"attempted": 2, "succeeded": 2, "failed": 0, "skipped": 0}
    assert stats(limit=1)["attempted"] == 1
    assert stats(mode="all", force=True)["attempted"] == 3
    assert stats(mode="id", article_id=2) == {"attempted": 0, "succeeded": 0, "failed": 0, "skipped": 1}
    assert stats(mode="id", article_id=2, force=True)["succeeded"] == 1
    for bad in ({"mode": "id"}, {"mode": "some"}):
        with pytest.raises(ValueError):
            completion.select_targets(clean, **bad)


def test_analysis_budget(spark):
    clean = clean_table(spark, *[{"summary": "x" * 500, "published_at": at(8, 1 + i)} for i in range(20)])
    rows = analysis.analysis_blocks(clean, max_chars=2000).orderBy("number").collect()
    assert 0 < len(rows) < 20 and rows[0].id == 20
    assert [r.number for r in rows] == list(range(1, len(rows) + 1)) and rows[-1].running_length <= 2000
    assert rows[0].block.startswith("[1] 제목: title 20\n    출처: s1 | 카테고리: AI | 일자: 2026-08-20\n    내용: x")
    assert len(analysis.analysis_blocks(clean, max_chars=10).collect()) == 1
    assert len(analysis.analysis_blocks(clean, limit=3).collect()) == 3
    with pytest.raises(ValueError):
        analysis.analysis_blocks(clean, limit=0)


def test_analysis_block_texts(spark):
    clean = clean_table(spark, {"body": "y" * 801}, {"body": " "}, {"body": "short", "summary": " sum "})
    rows = {r.id: r.block.split("내용: ")[1] for r in analysis.analysis_blocks(clean).collect()}
    assert rows == {1: "y" * 800 + "…", 2: "(요약/본문 없음)", 3: "sum"}


VALID = json.dumps({"trends": ["t"], "keywords": ["k"], "implications": ["i"]})


def test_analyze(spark):
    clean = clean_table(spark, {}, {"category": "IT"}, {"category": "IT"}, {"category": "no"})
    runs = spark.createDataFrame([], schemas.ANALYSIS_RUNS)

    def reply(system, prompt):
        if "카테고리=no," in prompt:
            return "no json"
        return f"```json\n{VALID}\n```"

    factory = lambda: completion.HandlerClient(reply)
    result = analysis.analyze(clean, runs, factory, model="m", by=("category",), date_from="2026-08-01")
    got = {r.category: r for r in result.runs.collect()}
    assert {c: (r.article_count, r.trends, r.date_from, r.date_to, r.model) for c, r in got.items()} == {
        "AI": (1, ["t"], "2026-08-01", None, "m"), "IT": (2, ["t"], "2026-08-01", None, "m"),
    }
    assert sorted(r.id for r in got.values()) == [1, 2]
    assert [r.category for r in result.failures.collect()] == ["no"]
    single = analysis.analyze(clean, result.runs, factory, category="IT").runs.collect()
    assert [(r.id, r.category, r.article_count, r.commonalities_differences) for r in single] == [(3, "IT", 2, [])]
    assert analysis.analyze(clean, runs, factory, category="none").runs.count() == 0


def test_latest_analysis(spark):
    rows = [(i, f, None, c, 1, ["t"], ["k"], [], ["i"], "m", at(8, i)) for i, f, c in ((1, "2026-08-01", "AI"), (2, "2026-08-02", "IT"), (3, "2026-08-02", "AI"))]
    runs = spark.createDataFrame(rows, schemas.ANALYSIS_RUNS)
    pick = lambda **c: [(r.id, r.is_fallback) for r in analysis.latest_analysis(runs, **c).collect()]
    assert pick() == [(3, False)]
    assert pick(category="IT") == [(2, False)]
    assert pick(category="AI", date_from="2026-08-01") == [(1, False)]
    assert pick(category="none") == [(3, True)]
    assert analysis.latest_analysis(runs.limit(0)).count() == 0
    one = spark.range(1)
    assert analysis.attach_latest(one, runs, category="IT").first().analysis.id == 2
    assert analysis.attach_latest(one, runs.limit(0)).first().analysis is None
    assert {r.category: r.id for r in analysis.latest_analysis_by(runs, "category").collect()} == {"AI": 3, "IT": 2}


# -- stored tables and exports ---------------------------------------------------------------------


def test_scans(spark):
    raw = raw_table(spark, {}, {"status": "error"}, {})
    assert ids(tables.raw_scan(raw)) == [1, 2, 3] and ids(tables.raw_scan(raw, status="ok", limit=1)) == [1]
    assert ids(tables.by_id(raw, 2)) == [2] and ids(tables.by_id(raw, 9)) == []
    stats = spark.createDataFrame([("b", "rss", 3, 2, 1, 0), ("a", "rss", 1, 1, 0, 0)], "source_name string, collection_method string, attempted_count long, success_count long, failure_count long, duplicate_count long")
    runs = tables.to_fetch_runs(stats, spark.createDataFrame([], schemas.FETCH_RUNS), at(8, 1), at(8, 2))
    assert [(r.id, r.source_name) for r in tables.recent_runs(runs, 1).collect()] == [(2, "b")]


EXPORTED = (
    {"title": "한글 제목: \"quoted\", 🇰🇷", "body": " line one\nline “two”, \\x ", "summary": "요약", "published_at": datetime(2026, 8, 5, 1, 2, 3, 400)},
    {"published_at": None, "summary": None},
)


def test_csv_export(spark, tmp_path):
    path, count = exports.export_articles(clean_table(spark, *EXPORTED), "csv", str(tmp_path / "c"))
    assert count == 2
    files = [f for f in (tmp_path / "c").iterdir() if f.suffix == ".csv"]
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbfid,title,") for f in files)
    rows = exports.read_csv_export(spark, path)
    assert tuple(rows.columns) == schemas.EXPORT_COLUMNS
    first, second = rows.orderBy("id").collect()
    assert (first.title, first.body, first.published_at) == (EXPORTED[0]["title"], EXPORTED[0]["body"], "2026-08-05T01:02:03.000400+00:00")
    assert (second.summary, second.original_length, second.summary_length) == (None, "9", None)


def test_jsonl_export(spark, tmp_path):
    path, count = exports.export_articles(clean_table(spark, *EXPORTED), "jsonl", str(tmp_path / "j"), status="unsummarized")
    assert count == 1
    lines = [line for f in (tmp_path / "j").glob("*.json") for line in f.read_text(encoding="utf-8").splitlines()]
    record = json.loads(lines[0])
    assert tuple(record) == schemas.EXPORT_COLUMNS and record["summary"] is None and "\\u" not in lines[0]
    with pytest.raises(ValueError):
        exports.export_articles(clean_table(spark), "xlsx", path)
    with pytest.raises(ValueError):
        exports.export_articles(clean_table(spark), "csv", path, status="odd")


def test_empty_export_has_a_header(spark, tmp_path):
    path, count = exports.export_articles(clean_table(spark, {}), "csv", str(tmp_path / "e"), category="none")
    assert count == 0
    text = "".join(f.read_text(encoding="utf-8-sig") for f in (tmp_path / "e").glob("*.csv"))
    assert text.strip() == ",".join(schemas.EXPORT_COLUMNS)


def test_day_layout_prunes(spark, tmp_path, plan_of, articles):
    tables.write_clean(articles, str(tmp_path / "clean"))
    stored = tables.read_clean(spark, str(tmp_path / "clean"))
    found = query.query_articles(stored, date_from="2026-08-09", date_to="2026-08-09")
    assert ids(found) == [2, 4]
    assert "PartitionFilters: [isnotnull(effective_day" in plan_of(found)


def test_a_very_long_body_is_kept(spark):
    body = "word " * 5_000_000
    payload = json.dumps({"title": "t", "url": "https://h/1", "body": body})
    raw = spark.createDataFrame([(1, None, "src", None, "rss", datetime(2026, 8, 6), "https://h/1", payload, "ok", None)], schemas.RAW_ARTICLES)
    row = cleaning.build_clean_rows(raw).select("reject_reason", F.length("body").alias("n")).first()
    assert row.reject_reason is None and row.n == len(body) - 1


def test_large_payloads_are_read_as_small_ones(spark, monkeypatch):
    """Beyond what a VARIANT holds, fields are read as text; on small payloads both ways must agree."""
    texts = ["x", "", " ", "5", "true", "[1]", "null"]
    values = texts + [None, 5, 0, 0.0, 1.5, True, False, [], [1, "a"], {}, {"a": 1}, ["x"]]
    payloads = [json.dumps({"title": v, "url": "https://h/1", "body": w}) for v in values for w in ("b", v)]
    payloads += [json.dumps({"title": "t", "url": v, "category": w, "published": v, "source": v}) for v in values for w in ("c", v)]
    payloads += ["{", "[]", "5", "null", '"x"', '{"title": "t"}]', "{'title': 't'}", '{"title": "t"} x', '{"title": "a", "body": "' + "long " * 500 + '", "url": "https://h"}', '{"title":{"a":[1,{"b":2}]}}']
    rows = [(i, None, None if i % 2 else "s", None, "rss", datetime(2026, 8, 6), f"https://c/{i}", p, "ok", None) for i, p in enumerate(payloads)]
    raw = spark.createDataFrame(rows, "id long, external_id string, source_name string, source_url string, collection_method string, collected_at timestamp, canonical_url string, raw_payload string, status string, error_message string")
    columns = ("raw_id", "title", "body", "url", "source", "category", "published_at", "original_length", "reject_reason")
    small = sorted(map(tuple, cleaning.build_clean_rows(raw).select(*columns).collect()))
    monkeypatch.setattr(cleaning, "LARGE", 3)
    large = sorted(map(tuple, cleaning.build_clean_rows(raw).select(*columns).collect()))
    wrong = [(payloads[a[0]], a, b) for a, b in zip(small, large) if a != b]
    assert wrong == []


def test_insert_with_repeated_seq_gives_one_row_and_id_per_key(spark):
    items = [("src", True, seq, 1, url, title, "b", None, url, "AI", "https://src", None) for seq, url, title in
             [(1, "https://h/1", "new"), (1, "https://h/1", "old"), (1, "https://h/2", "x"), (1, "https://h/2", "x"), (2, "https://h/1", "late"), (2, "https://h/3", "y")]]
    rows = ingest.to_raw_rows(spark.createDataFrame(items, COLLECTED), "rss")
    for partitions in (1, 5):
        got = sorted((r.id, r.canonical_url, json.loads(r.raw_payload)["title"]) for r in ingest.insert_raw(rows.repartition(partitions), spark.createDataFrame([], schemas.RAW_ARTICLES)).collect())
        assert [(i, u) for i, u, _ in got] == [(1, "https://h/1"), (2, "https://h/2"), (3, "https://h/3")]
        assert got[0][2] in ("new", "old") and got[1][2] == "x"


@pytest.mark.parametrize("fmt", ["csv", "jsonl"])
def test_ordered_parts_are_the_file_of_one_task(spark, tmp_path, fmt):
    clean = clean_table(spark, *[dict(row, id=90 - i) for i, row in enumerate(EXPORTED * 8)]).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        exports.write_ordered(clean, fmt, str(tmp_path / "parts"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-"))
    one = exports.export_view(query.query_articles(clean)).coalesce(1)
    (exports.write_csv if fmt == "csv" else exports.write_jsonl)(one, str(tmp_path / "one"))
    whole = b"".join(p.read_bytes() for p in (tmp_path / "one").iterdir() if p.name.startswith("part-"))
    assert len(parts) > 1 and b"".join(p.read_bytes() for p in parts) == whole
    exports.write_ordered(clean.limit(0), fmt, str(tmp_path / "none"))
    left = b"".join(p.read_bytes() for p in (tmp_path / "none").iterdir() if p.name.startswith("part-")).decode()
    assert left.startswith("\ufeffid,title") and left.count("\n") == 1 if fmt == "csv" else left == ""

"""The registered queries: every operator on the sample tables, each over whole tables and whole texts."""

import json
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions.dates import normalize_date, to_iso
from articleflow.functions.prompts import summary_prompt
from articleflow.functions.replies import decode_list, encode_list, parse_analysis
from articleflow.functions.text import content_hash, http_error, normalize_text, redact, strip_html
from articleflow.functions.urls import is_tracking_param, normalize_url, query_params, request_url, url_host, url_origin
from articleflow.operators import aggregates, analysis, blocks, changes, cleaning, completion, ingest, merge, paging, query
from articleflow.operators.journal import read_journal
from articleflow.plans import bindings
from articleflow.session import materialize, shared_dir, spread
from articleflow.schemas import CLEAN_ARTICLES, RAW_ARTICLES
from articleflow.sources import exports, feeds, registry, robots, tables
from articleflow.sources.pages import crawl, crawl_frontier, crawl_links, extract_article, extract_links
from articleflow.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REPORT_RANGE = {"date_from": "2024-01-05", "date_to": "2024-01-25"}
KEYWORD, WILDCARD = "THE", "e_e%TI"
# Ids of a block of stored tables.
BLOCK_WIDTH = 4096


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _clean(spark, sf_dir, summaries=True):
    return bindings.clean_view(spark, sf_dir, summaries=summaries)


def _raw(spark, sf_dir):
    return bindings.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))


# -- reports ---------------------------------------------------------------------------------------


@register
def report_metrics(spark, sf_dir):
    return aggregates.report_metrics(_clean(spark, sf_dir), _raw(spark, sf_dir), **REPORT_RANGE)


@register
def report_metrics_by_category(spark, sf_dir):
    return aggregates.report_metrics(_clean(spark, sf_dir), _raw(spark, sf_dir), by=("category",))


@register
def report_cube(spark, sf_dir):
    return aggregates.report_cube(_clean(spark, sf_dir))


@register
def report_with_analysis(spark, sf_dir):
    metrics = aggregates.report_metrics(_clean(spark, sf_dir), _raw(spark, sf_dir), category="fr")
    attached = analysis.attach_latest(metrics, bindings.analysis_runs(spark, sf_dir), category="fr")
    return attached.select("clean_count", "raw_count", F.col("analysis.id").alias("run_id"), F.array_join("analysis.keywords", ", ").alias("keywords"))


@register
def report_build(spark, sf_dir):
    """All tables of a report as one list: counts and rates, top sources and categories, days, the attached analysis."""
    runs = bindings.analysis_runs(spark, sf_dir)
    report = aggregates.build_report(_clean(spark, sf_dir), _raw(spark, sf_dir), runs, top_n=3, **REPORT_RANGE)
    none = lambda kind: F.lit(None).cast(kind)
    listed = lambda rows, part, name: rows.select(F.lit(part).alias("part"), "place", F.col(name).alias("name"), "n", none("string").alias("share"))
    counts = report.metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("clean_count", "body_count", "summarized_count", "raw_count")])).alias("_c"))
    rates = report.metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("rate")) for c in ("clean_rate", "body_rate", "summary_rate")])).alias("_c"))
    parts = [
        counts.select(F.lit("count").alias("part"), none("bigint").alias("place"), "_c.name", "_c.n", none("string").alias("share")),
        rates.select(F.lit("rate").alias("part"), none("bigint").alias("place"), "_c.name", none("bigint").alias("n"), aggregates.format_percent("_c.rate").alias("share")),
        listed(report.top_sources, "source", "source"),
        listed(report.top_categories, "category", "category"),
        report.daily.select(F.lit("day").alias("part"), none("bigint").alias("place"), F.date_format("day", "yyyy-MM-dd").alias("name"), "n", none("string").alias("share")),
        report.analysis.select(F.lit("analysis").alias("part"), none("bigint").alias("place"), F.col("category").alias("name"), F.col("id").alias("n"), none("string").alias("share")),
    ]
    return reduce(DataFrame.unionByName, parts)


@register
def category_counts(spark, sf_dir):
    return aggregates.category_counts(_clean(spark, sf_dir, False))


@register
def source_counts(spark, sf_dir):
    return aggregates.source_counts(_clean(spark, sf_dir, False), **REPORT_RANGE)


@register
def top_sources(spark, sf_dir):
    return aggregates.top_counts(aggregates.source_counts(_clean(spark, sf_dir, False)), "source", 5)


@register
def top_categories(spark, sf_dir):
    return aggregates.top_counts(aggregates.category_counts(_clean(spark, sf_dir, False)), "category", 3)


@register
def daily_counts(spark, sf_dir):
    return aggregates.daily_counts(_clean(spark, sf_dir, False))


@register
def daily_event_counts(spark, sf_dir):
    events = bindings.table(spark, sf_dir, "events")
    rows = events.select(F.col("ts").cast("timestamp").alias("collected_at"), F.lit(None).cast("timestamp").alias("published_at"))
    return aggregates.daily_counts(rows)


@register
def raw_count(spark, sf_dir):
    return aggregates.count_rows(bindings.raw_documents(spark, sf_dir), "raw_count")


@register
def clean_count(spark, sf_dir):
    return aggregates.count_articles(_clean(spark, sf_dir), status="summarized", limit=10, **REPORT_RANGE)


@register
def analysis_run_count(spark, sf_dir):
    return aggregates.count_rows(bindings.analysis_runs(spark, sf_dir), "runs")


# -- filters, lists, details -----------------------------------------------------------------------


def _listed(spark, sf_dir, **filters):
    summaries = filters.pop("summaries", True)
    return query.list_view(query.query_articles(_clean(spark, sf_dir, summaries), **filters))


@register
def filter_dates(spark, sf_dir):
    return _listed(spark, sf_dir, **REPORT_RANGE)


@register
def filter_instants(spark, sf_dir):
    at = lambda day: datetime(2024, 1, day, tzinfo=timezone.utc)
    return _listed(spark, sf_dir, date_from=at(5), date_to=at(25))


@register
def filter_category_source(spark, sf_dir):
    return _listed(spark, sf_dir, category="en", source="src1")


@register
def filter_summarized(spark, sf_dir):
    return _listed(spark, sf_dir, status="summarized")


@register
def filter_unsummarized(spark, sf_dir):
    return _listed(spark, sf_dir, status="unsummarized", order="DESC")


@register
def filter_require_body(spark, sf_dir):
    return _listed(spark, sf_dir, require_body=True)


@register
def filter_keyword(spark, sf_dir):
    return _listed(spark, sf_dir, keyword=KEYWORD)


@register
def filter_keyword_wildcard(spark, sf_dir):
    return _listed(spark, sf_dir, keyword=WILDCARD)


@register
def filter_combined(spark, sf_dir):
    return _listed(spark, sf_dir, category="en", status="unsummarized", keyword=KEYWORD, require_body=True, order="DESC", **REPORT_RANGE)


@register
def list_page(spark, sf_dir):
    return query.list_page(_clean(spark, sf_dir), 3, 20, category="en")


@register
def list_page_after(spark, sf_dir):
    at = datetime(2024, 1, 20, tzinfo=timezone.utc)
    return query.list_page_after(_clean(spark, sf_dir), at, 500, 20)


@register
def list_page_deep(spark, sf_dir):
    """The page in the middle of the whole listing, found by way of a stored directory."""
    rows = _clean(spark, sf_dir)
    directory = materialize(paging.page_directory(rows, BLOCK_WIDTH), name="directory")
    total = directory.agg(F.sum("n")).first()[0]
    return paging.deep_page(rows, directory, total // 2 // 20 + 1, 20, BLOCK_WIDTH)


@register
def page_count(spark, sf_dir):
    return query.page_count(_clean(spark, sf_dir, False), 20, category="en")


@register
def article_details(spark, sf_dir):
    return query.detail_view(_clean(spark, sf_dir))


@register
def article_by_id(spark, sf_dir):
    return query.detail_view(tables.by_id(_clean(spark, sf_dir), 42))


@register
def raw_scan(spark, sf_dir):
    return tables.raw_scan(bindings.raw_documents(spark, sf_dir), status="ok").select("id", "source_name", "canonical_url", "status")


# -- ingest ----------------------------------------------------------------------------------------


@register
def dedup_raw_first_wins(spark, sf_dir):
    rows = bindings.page_keys(spark, sf_dir)
    return ingest.first_per_key(rows, ingest.RAW_KEY, "seq").select("seq", *ingest.RAW_KEY)


@register
def raw_new_only(spark, sf_dir):
    rows = bindings.page_keys(spark, sf_dir)
    secure = F.col("url").startswith("https:")
    return ingest.new_raw_keys(rows.where(secure), rows.where(~secure))


@register
def raw_from_pages(spark, sf_dir):
    rows = ingest.to_raw_rows(bindings.collected_pages(spark, sf_dir), "crawl", F.lit("2024-02-01").cast("timestamp"))
    stored = ingest.first_per_key(rows.where("storable"), ingest.RAW_KEY, "seq")
    return stored.select("seq", *ingest.RAW_KEY, "raw_payload", "status", "error_message")


def _event_rows(spark, sf_dir):
    """Fetched events as stored raw rows: the new ones, and the purchases as those already there."""
    collected = spread(bindings.fetched_events(spark, sf_dir), "seq")
    rows = materialize(ingest.to_raw_rows(collected, "rss", F.to_timestamp(F.lit("2024-02-01"))), name="event-rows")
    return rows.where(~F.col("canonical_url").endswith("/purchase")), rows.where(F.col("canonical_url").endswith("/purchase"))


@register
def raw_inserts(spark, sf_dir):
    rows, stored = _event_rows(spark, sf_dir)
    existing = stored.withColumn("id", F.col("seq") + 1)
    return ingest.insert_raw(rows, existing).select("id", *ingest.RAW_KEY, "status", "error_message", "external_id", "raw_payload")


@register
def raw_inserts_refetched(spark, sf_dir):
    """Feeds that were fetched several times, stored from the newest documents: one row and one id per entry."""
    docs = bindings.feed_documents(spark, sf_dir)
    sources = docs.select(
        F.col("doc_no").alias("source_no"), "source_name", "category", F.col("source_url").alias("url"), F.lit(None).cast("map<string,string>").alias("params")
    )
    at = lambda day: F.to_timestamp(F.lit(f"2024-02-0{day}")).alias("fetched_at")
    nothing = F.lit(None).cast("string")
    newest = docs.select(F.col("source_url").alias("url"), "content", nothing.alias("error"), at(2))
    older = docs.select(F.col("source_url").alias("url"), F.replace("content", F.lit("<title>"), F.lit("<title>old ")).alias("content"), nothing.alias("error"), at(1))
    failed = docs.select(F.col("source_url").alias("url"), nothing.alias("content"), F.lit("HTTP 503").alias("error"), at(3))
    items = feeds.collect_feeds(sources, older.unionAll(newest).unionAll(newest).unionAll(failed))
    rows = materialize(ingest.to_raw_rows(items, "rss", F.to_timestamp(F.lit("2024-02-02")), extra=("feed_title",)), name="feed-rows")
    return ingest.insert_raw(rows, spark.createDataFrame([], RAW_ARTICLES)).select("id", *ingest.RAW_KEY, "status", "error_message", "raw_payload")


@register
def fetch_run_stats(spark, sf_dir):
    rows, stored = _event_rows(spark, sf_dir)
    return ingest.fetch_run_stats(rows, ingest.new_raw_keys(rows, stored))


@register
def recent_runs(spark, sf_dir):
    runs = spark.createDataFrame([], tables.FETCH_RUNS)
    at = datetime(2024, 2, 1, tzinfo=timezone.utc)
    stored = tables.to_fetch_runs(fetch_run_stats(spark, sf_dir), runs, at, at)
    return tables.recent_runs(stored, 3).select("id", "source_name", "attempted_count", "success_count", "failure_count", "duplicate_count")


@register
def feed_items(spark, sf_dir):
    items = feeds.parse_feeds(bindings.feed_documents(spark, sf_dir))
    return items.select("source_name", "pos", "seq", "ok", "url", "title", "body", "published_raw", "external_id", "feed_title", "error")


@register
def feed_items_limited(spark, sf_dir):
    items = feeds.parse_feeds(bindings.feed_documents(spark, sf_dir), limit=2)
    return items.groupBy("ok").agg(F.sum("attempted").alias("attempted"), F.count("error").alias("errors"))


@register
def feed_items_mended(spark, sf_dir):
    """Feeds under prefixes of their own, cut off, or broken in an entry."""
    items = feeds.parse_feeds(bindings.odd_feeds(spark, sf_dir))
    return items.select("source_name", "pos", "attempted", "ok", "url", "title", "body", "published_raw", "feed_title", "error")


@register
def feed_large(spark, sf_dir):
    """All turns as the items of one feed, written in parts and read in splits."""
    path = bindings.large_feed(spark, sf_dir, shared_dir(spark, "large-feed"))
    rows = feeds.read_large_feed(spark, path, source_name="talks", category="talk", source_no=5, source_url="https://talk.example.com/feed")
    return rows.select("pos", "seq", "ok", "url", "title", "body", "published_raw", "feed_title", "error")


@register
def feed_collect(spark, sf_dir):
    """Feed sources for every conversation; documents of the first turns only were fetched."""
    docs = bindings.feed_documents(spark, sf_dir)
    sources = docs.select(
        F.col("doc_no").alias("source_no"), "source_name", "category", F.col("source_url").alias("url"),
        F.create_map(F.lit("display"), F.lit("500"), F.lit("q"), F.col("category")).alias("params"),
    )
    asked = F.concat("source_url", F.lit("?display=30&q=talk"))
    fetched = docs.where(~F.col("content").contains("/5?")).select(
        asked.alias("url"), "content", F.lit(None).cast("string").alias("error")
    )
    return feeds.collect_feeds(sources, fetched, limit=30).select("source_name", "attempted", "ok", "url", "error")


def _crawl_inputs(spark, sf_dir):
    index = bindings.index_pages(spark, sf_dir)
    found = ingest.first_per_key(bindings.pages(spark, sf_dir), ("url",), "page_id")
    # Plain-http pages could not be fetched.
    fetched = found.select("url", F.when(F.col("url").startswith("https"), F.col("html")).alias("html"))
    listed = index.select(F.col("list_url").alias("url"), "html")
    stored = fetched.unionByName(listed).withColumn("error", F.when(F.col("html").isNull(), "HTTP 503"))
    return index.drop("html"), stored


_CRAWLED = ("source_name", "pos", "ok", "url", "title", "body", "published_raw", "external_id", "source_url", "error")


@register
def crawl_pages(spark, sf_dir):
    return crawl(*_crawl_inputs(spark, sf_dir)).select(*_CRAWLED)


@register
def crawl_allowed(spark, sf_dir):
    """The crawl as the robots files of the pages' origins allow it."""
    return crawl(*_crawl_inputs(spark, sf_dir), rules=bindings.page_rules(spark, sf_dir)).select(*_CRAWLED)


@register
def crawl_slots(spark, sf_dir):
    """The distinct pages of the crawl with their permissions and request slots."""
    sources, stored = _crawl_inputs(spark, sf_dir)
    links = materialize(crawl_links(sources, stored), name="links")
    return crawl_frontier(links, bindings.page_rules(spark, sf_dir)).select("link", "origin", "allowed", "slot_seconds")


@register
def registry_match(spark, sf_dir):
    """Requests of every page against a registry of their hosts, of either type."""
    rows = bindings.pages(spark, sf_dir).select("page_id", url_host("url").alias("source_name"))
    known = rows.select("source_name").distinct().where(~F.col("source_name").startswith("blog.")).select(
        "source_name", F.when(F.col("source_name").startswith("www."), "rss").otherwise("web").alias("type"),
        F.lit("news").alias("category"), F.lit(None).cast("string").alias("problem"),
    )
    return registry.match_sources(rows.withColumn("collection_method", F.lit("crawl")), known).select("page_id", "source_name", "category", "problem")


@register
def source_registry(spark, sf_dir):
    """A configuration text per customer segment and nation, exploded and checked."""
    customers = bindings.table(spark, sf_dir, "customer")
    name = F.concat(F.lit("c"), "c_custkey")
    is_rss = F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")
    source = F.create_map(
        F.lit("type"), F.when(is_rss, "rss").when(F.col("c_mktsegment") == "MACHINERY", "ftp").otherwise("web"),
        F.lit("url"), F.when(F.col("c_acctbal") < 0, "REPLACE_WITH_URL").otherwise(F.concat(F.lit("https://example.com/"), name)),
        F.lit("category"), F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment")).otherwise(""),
        F.lit("list_url"), F.concat(F.lit("https://example.com/list/"), name),
        F.lit("article_link_selector"), F.lit("a"), F.lit("title_selector"), F.lit("h1"),
        F.lit("body_selector"), F.when(F.col("c_acctbal") > 9000, "").otherwise("p"),
    )
    config = customers.select(F.to_json(F.struct(F.create_map(name, source).alias("sources"))).alias("text"))
    return registry.source_registry(config).select("source_name", "type", "category", "url", "problem")


# -- pages -----------------------------------------------------------------------------------------


@register
def extract_articles(spark, sf_dir):
    rows = spread(bindings.pages(spark, sf_dir), "page_id")
    article = extract_article("html", "article h1", "article p", "article time")
    return rows.select("page_id", article.alias("_a")).select("page_id", "_a.title", "_a.body", "_a.published_raw")


@register
def article_titles(spark, sf_dir):
    rows = spread(bindings.pages(spark, sf_dir), "page_id")
    article = extract_article("html", "h2.missing", "footer", None)
    return rows.select("page_id", article.alias("_a")).select("page_id", "_a.title", "_a.body")


@register
def extract_links_all(spark, sf_dir):
    rows = spread(bindings.pages(spark, sf_dir), "page_id").withColumn("base", url_origin("url"))
    return extract_links(rows, "nav a", F.col("base")).select("page_id", "pos", "link")


@register
def extract_links_limited(spark, sf_dir):
    rows = spread(bindings.pages(spark, sf_dir), "page_id")
    return extract_links(rows, "nav li a[href]", F.col("url"), limit=3).select("page_id", "pos", "link")


@register
def strip_html_pages(spark, sf_dir):
    return bindings.pages(spark, sf_dir).select("page_id", strip_html("html").alias("text"))


@register
def normalized_pages(spark, sf_dir):
    return spread(bindings.pages(spark, sf_dir), "page_id").select("page_id", normalize_text("html").alias("text"))


@register
def normalized_documents(spark, sf_dir):
    return spread(bindings.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", normalize_text("text").alias("text"))


@register
def normalized_urls(spark, sf_dir):
    return bindings.pages(spark, sf_dir).select("page_id", "url", normalize_url("url").alias("canonical_url"))


@register
def tracking_params(spark, sf_dir):
    params = bindings.pages(spark, sf_dir).select(F.explode(query_params("url")).alias("_p"))
    return params.groupBy("_p.name").agg(F.count("*").alias("n")).withColumn("tracking", is_tracking_param("name"))


@register
def request_urls(spark, sf_dir):
    params = F.create_map(F.lit("display"), F.lit("20"), F.lit("page"), F.lit("a b"))
    return bindings.pages(spark, sf_dir).select("page_id", request_url("url", params, 300).alias("request"))


@register
def robots_allowed(spark, sf_dir):
    marked = robots.mark_allowed(bindings.pages(spark, sf_dir).select("page_id", "url"), bindings.page_rules(spark, sf_dir))
    return marked.select("page_id", "origin", "allowed", "crawl_delay")


@register
def fetch_slots(spark, sf_dir):
    marked = robots.mark_allowed(bindings.pages(spark, sf_dir).select("page_id", "url"), bindings.page_rules(spark, sf_dir))
    allowed = materialize(marked.where("allowed").select("page_id", "origin", "crawl_delay"), name="allowed")
    slots = robots.fetch_slots(allowed, seq="page_id", delay=1.0)
    return slots.select("page_id", "origin", "slot_seconds")


@register
def fetch_errors(spark, sf_dir):
    rows = bindings.pages(spark, sf_dir)
    return rows.select("page_id", http_error(F.lit(503), "url", "html").alias("message"))


@register
def normalized_dates(spark, sf_dir):
    """Order dates written in a different way for every priority, read back."""
    written = {
        "1-URGENT": F.date_format("o_orderdate", "EEEE, MMMM d, yyyy"),
        "2-HIGH": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+09:00'"),
        "3-MEDIUM": F.concat(F.lit("입력 :"), F.date_format("o_orderdate", "yyyy/MM/dd HH:mm"), F.lit("  수정")),
        "4-NOT SPECIFIED": F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss '-0230'"),
    }
    text = F.date_format("o_orderdate", "yyyy.MM.dd")
    for priority, form in written.items():
        text = F.when(F.col("o_orderpriority") == priority, form).otherwise(text)
    orders = spread(bindings.table(spark, sf_dir, "orders"), "o_orderkey")
    return orders.select("o_orderkey", to_iso(normalize_date(text)).alias("moment"))


# -- cleaning and merging --------------------------------------------------------------------------


@register
def clean_rows(spark, sf_dir):
    raw = spread(cleaning.cleanable(bindings.raw_documents(spark, sf_dir)), "id")
    built = cleaning.build_clean_rows(raw)
    usable = F.col("reject_reason").isNull()
    shown = ("title", "body", "url", "source", "category", "clean_status", "original_length", "content_hash")
    return built.select(
        "raw_id", "reject_reason", *[F.when(usable, F.col(name)).alias(name) for name in shown],
        F.when(usable, to_iso("published_at")).alias("published_at"),
    )


@register
def clean_outcomes(spark, sf_dir):
    raw = cleaning.cleanable(bindings.raw_documents(spark, sf_dir))
    built = cleaning.build_clean_rows(spread(raw, "id"))
    outcome = F.when(F.col("reject_reason").isNotNull(), "invalid").otherwise(F.col("clean_status"))
    return built.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@register
def clean_run(spark, sf_dir):
    """The counts of a first clean run over all raw documents."""
    empty = spark.createDataFrame([], CLEAN_ARTICLES)
    return merge.clean_articles(bindings.raw_documents(spark, sf_dir), empty, policy="skip").stats


@register
def clean_rerun(spark, sf_dir):
    """The counts of a second run under either policy: everything is there already."""
    raw = bindings.raw_documents(spark, sf_dir)
    first = materialize(merge.clean_articles(raw, spark.createDataFrame([], CLEAN_ARTICLES)).clean, name="first-run")
    runs = [merge.clean_articles(raw, first, policy=policy).stats.withColumn("policy", F.lit(policy)) for policy in ("skip", "upsert")]
    return runs[0].unionByName(runs[1])


@register
def clean_limited(spark, sf_dir):
    """A cleaning run over the first hundred usable raw rows."""
    built = cleaning.build_clean_rows(cleaning.cleanable(bindings.raw_documents(spark, sf_dir), 100))
    return built.select("raw_id", "reject_reason", F.when(F.col("reject_reason").isNull(), F.col("title")).alias("title"))


def _shown(rows):
    """All sixteen columns, moments as text."""
    moments = ("published_at", "collected_at", "summarized_at")
    return rows.select(*[to_iso(name).alias(name) if name in moments else F.col(name) for name in CLEAN_ARTICLES.names])


@register
def merge_skip(spark, sf_dir):
    return _shown(merge.merge_skip(bindings.merge_batch(spark, sf_dir), bindings.merge_target(spark, sf_dir)))


@register
def merge_upsert(spark, sf_dir):
    return _shown(merge.merge_upsert(bindings.merge_batch(spark, sf_dir), bindings.merge_target(spark, sf_dir)))


def _merged_in_blocks(spark, sf_dir, policy):
    table = blocks.store(bindings.merge_target(spark, sf_dir, stored=False), shared_dir(spark, "clean-blocks"), width=BLOCK_WIDTH)
    blocks.merge(table, bindings.merge_batch(spark, sf_dir), policy=policy)
    return _shown(table.read())


@register
def merge_upsert_blocks(spark, sf_dir):
    """The upsert on a stored table of which it rewrites the touched blocks."""
    return _merged_in_blocks(spark, sf_dir, "upsert")


@register
def merge_skip_blocks(spark, sf_dir):
    return _merged_in_blocks(spark, sf_dir, "skip")


@register
def report_changes(spark, sf_dir):
    """The report's counts after a merge under either policy, out of signed counts; the table's bodies are read before the merge only."""
    batch = bindings.merge_batch(spark, sf_dir)
    # Texts become facts before rows are compared by their URLs, so that no text is shuffled for that.
    known = changes.facts(bindings.older_articles(spark, sf_dir), "id", "raw_id", "url")
    target = materialize(ingest.first_per_key(known, ("url",), "id"), name="known-facts")
    keys, last_id = target.select("id", "raw_id", "url"), target.agg(F.max("id")).first()[0] or 0

    def followed(policy):
        report = changes.ChangingReport(spark, shared_dir(spark, "report-changes"), BLOCK_WIDTH)
        report.begin_with(target)
        report.follow_merge(blocks.decide(batch, keys, policy, last_id), batch, policy)
        return report.cube().withColumn("policy", F.lit(policy))

    return followed("skip").unionByName(followed("upsert"))


@register
def merge_decisions(spark, sf_dir):
    return merge.upsert_decisions(bindings.merge_batch(spark, sf_dir), bindings.merge_target(spark, sf_dir))


@register
def merge_stats(spark, sf_dir):
    batch, target = bindings.merge_batch(spark, sf_dir), bindings.merge_target(spark, sf_dir)
    return merge.merge_counts(batch, target, "skip").withColumn("policy", F.lit("skip")).unionByName(
        merge.merge_counts(batch, target, "upsert").withColumn("policy", F.lit("upsert"))
    )


@register
def orphans(spark, sf_dir):
    raw = bindings.labels(spark, sf_dir).select(F.col("doc_id").alias("id"))
    return merge.orphans(_clean(spark, sf_dir, False), raw).select("id", "url")


def _toxic_marks(spark, sf_dir):
    return bindings.labels(spark, sf_dir).where(F.col("toxic") == 1).select(
        F.col("doc_id").alias("id"), F.lit("invalid").alias("status"), F.lit("toxic").alias("error_message")
    )


@register
def raw_status_update(spark, sf_dir):
    return merge.update_raw_status(bindings.raw_documents(spark, sf_dir), _toxic_marks(spark, sf_dir)).select("id", "status", "error_message")


@register
def raw_status_blocks(spark, sf_dir):
    table = blocks.store(bindings.raw_documents(spark, sf_dir), shared_dir(spark, "raw-blocks"), width=BLOCK_WIDTH)
    blocks.write_status(table, materialize(_toxic_marks(spark, sf_dir), name="marks"))
    return table.read().select("id", "status", "error_message")


def _new_summaries(spark, sf_dir):
    labelled = bindings.labels(spark, sf_dir).where(F.col("quality") == 0)
    docs = bindings.table(spark, sf_dir, "documents").join(labelled, "doc_id")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("summary"), F.lit("m2").alias("summary_model"),
        F.to_timestamp(F.lit("2024-03-01")).alias("summarized_at"), F.col("n_chars").alias("original_length"),
    )


def _summarized(rows):
    return rows.select("id", "summary", "summary_model", "summary_length", "original_length", to_iso("summarized_at").alias("summarized_at"))


@register
def summary_update(spark, sf_dir):
    return _summarized(merge.update_summaries(_clean(spark, sf_dir), _new_summaries(spark, sf_dir)))


@register
def summary_update_blocks(spark, sf_dir):
    table = blocks.store(_clean(spark, sf_dir), shared_dir(spark, "clean-blocks"), width=BLOCK_WIDTH)
    blocks.write_summaries(table, materialize(_new_summaries(spark, sf_dir), name="new-summaries"))
    return _summarized(table.read())


@register
def duplicate_content_groups(spark, sf_dir):
    rows = spread(bindings.table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"), "source", content_hash("lang", "text").alias("content_hash")
    )
    groups = merge.duplicate_content(rows)
    return groups.select("copies", "first_id", F.array_join("sources", ",").alias("sources"))


@register
def redacted_documents(spark, sf_dir):
    return bindings.table(spark, sf_dir, "documents").select("doc_id", redact("text", "the-known-secret").alias("text"))


# -- prompts and model calls -----------------------------------------------------------------------

BY_CATEGORY = ("category",)


@register
def analysis_blocks(spark, sf_dir):
    return analysis.analysis_blocks(_clean(spark, sf_dir), by=BY_CATEGORY)


@register
def analysis_prompts(spark, sf_dir):
    blocks = analysis.analysis_blocks(_clean(spark, sf_dir), by=BY_CATEGORY, max_chars=5000)
    return analysis.analysis_requests(blocks, by=BY_CATEGORY)


@register
def analysis_prompt_all(spark, sf_dir):
    blocks = analysis.analysis_blocks(_clean(spark, sf_dir), **REPORT_RANGE)
    return analysis.analysis_requests(blocks, **REPORT_RANGE)


def _answer(system: str, prompt: str) -> str:
    """A stand-in model: repeats the title, with nothing to say where there is no body."""
    if "(본문 없음" in prompt:
        raise completion.ModelError("no body")
    return "  " + prompt.split("제목: ", 1)[1].split("\n", 1)[0] + "\n"


def _client() -> completion.HandlerClient:
    return completion.HandlerClient(_answer)


@register
def summary_prompts(spark, sf_dir):
    targets = completion.select_targets(_clean(spark, sf_dir))
    return targets.select("id", summary_prompt().alias("prompt"))


@register
def summaries(spark, sf_dir):
    result = completion.summarize(_clean(spark, sf_dir), _client, mode="all", stage=False)
    return result.outcomes.select("id", "outcome", "reply", "error", "original_length")


@register
def summarize_stats(spark, sf_dir):
    return completion.summarize(_clean(spark, sf_dir), _client, stage=False).stats


@register
def summaries_journal(spark, sf_dir):
    """The English articles first, then all, by way of one journal: ``calls`` shows that no call was made twice."""
    path, clean = shared_dir(spark, "journal"), _clean(spark, sf_dir)
    completion.summarize(clean.where("category = 'en' AND title <> ''"), _client, mode="all", journal=path)
    result = completion.summarize(clean, _client, mode="all", journal=path)
    done = read_journal(spark, path).where(F.col("error").isNull()).agg(F.count("*")).scalar()
    return result.outcomes.select("id", "outcome", "reply", "error", "original_length").withColumn("calls", done)


@register
def summarize_by_id(spark, sf_dir):
    """One article that has a summary: skipped, or summarized again when forced."""
    clean = _clean(spark, sf_dir)
    row_id = clean.where("summary IS NOT NULL").agg(F.min("id")).first()[0]
    runs = []
    for force in (False, True):
        result = completion.summarize(clean, _client, mode="id", article_id=row_id, force=force)
        counts = [result.stats.select(name).scalar().alias(name) for name in ("attempted", "succeeded", "skipped")]
        runs.append(result.outcomes.select(F.lit(force).alias("forced"), "id", "outcome", *counts))
    return runs[0].unionByName(runs[1])


def _analyst(system: str, prompt: str) -> str:
    """A stand-in model: says what it was asked about; it has no answer for Spanish articles and none that holds for French ones."""
    asked = prompt.split("카테고리=", 1)[1].split(",", 1)[0]
    if asked == "es":
        raise completion.ModelError("no answer")
    first = prompt.split("제목: ", 1)[1].split("\n", 1)[0]
    trends = [] if asked == "fr" else [first]
    return "```json\n" + json.dumps({"trends": trends, "keywords": [asked, " "], "implications": str(len(prompt))}, ensure_ascii=False) + "\n```"


def _analyzed(spark, sf_dir, **options):
    runs = bindings.analysis_runs(spark, sf_dir)
    return analysis.analyze(_clean(spark, sf_dir), runs, lambda: completion.HandlerClient(_analyst), model="analyst", by=BY_CATEGORY, **options)


@register
def analyze(spark, sf_dir):
    """One call per category: valid replies become runs after the stored ones."""
    found = _analyzed(spark, sf_dir).runs
    lists = [F.array_join(name, "|").alias(name) for name in ("trends", "keywords", "commonalities_differences", "implications")]
    return found.select("id", "date_from", "category", "article_count", "model", *lists)


@register
def analyze_failures(spark, sf_dir):
    found = _analyzed(spark, sf_dir, journal=shared_dir(spark, "journal")).failures
    return found.select("category", "article_count", "error")


@register
def parsed_analysis(spark, sf_dir):
    replies = bindings.model_replies(spark, sf_dir).withColumn("_a", parse_analysis("reply"))
    return replies.select(
        "conv_id", "turn", F.array_join("_a.trends", "|").alias("trends"), F.array_join("_a.keywords", "|").alias("keywords"),
        F.array_join("_a.implications", "|").alias("implications"), F.col("_a.error").alias("error"),
    )


@register
def latest_analysis(spark, sf_dir):
    runs = bindings.analysis_runs(spark, sf_dir)
    latest = analysis.latest_analysis(runs, date_from="2024-01-07", date_to="2024-01-07", category="en")
    return latest.select("id", "date_from", "category", "article_count", "is_fallback")


@register
def latest_analysis_fallback(spark, sf_dir):
    latest = analysis.latest_analysis(bindings.analysis_runs(spark, sf_dir), category="none")
    return latest.select("id", "date_from", "category", "article_count", "is_fallback")


@register
def latest_analysis_by_category(spark, sf_dir):
    latest = analysis.latest_analysis_by(bindings.analysis_runs(spark, sf_dir), "category")
    return latest.select("category", "id", "date_from", "article_count")


@register
def run_lists_round_trip(spark, sf_dir):
    runs = bindings.analysis_runs(spark, sf_dir).withColumn("_json", encode_list("keywords"))
    return runs.select("id", F.col("_json").alias("keywords_json"), F.array_join(decode_list("_json"), ", ").alias("keywords"),
                       F.size(decode_list("date_from")).cast("long").alias("from_text"))


# -- exports and streams ---------------------------------------------------------------------------


@register
def export_rows(spark, sf_dir):
    return exports.export_view(query.query_articles(_clean(spark, sf_dir)))


@register
def export_csv(spark, sf_dir):
    path, _ = exports.export_articles(_clean(spark, sf_dir), "csv", shared_dir(spark, "csv"), status="summarized")
    return exports.read_csv_export(spark, path)


@register
def export_jsonl(spark, sf_dir):
    view = exports.export_view(_clean(spark, sf_dir))
    path, _ = exports.export_articles(_clean(spark, sf_dir), "jsonl", shared_dir(spark, "jsonl"), status="unsummarized")
    return exports.read_jsonl_export(spark, path, view.schema)


@register
def export_ordered(spark, sf_dir):
    """All articles as JSON lines in one order over several parts."""
    clean, path = _clean(spark, sf_dir), shared_dir(spark, "ordered")
    exports.write_ordered(clean, "jsonl", path)
    return exports.read_jsonl_export(spark, path, exports.export_view(clean).schema)


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = bindings.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


@register
def stream_daily_trend(spark, sf_dir):
    """The events as a stream, counted by day."""
    stream = _event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("collected_at"))
    out = shared_dir(spark, "stream-days")
    incremental.stream_daily_trend(stream, out, shared_dir(spark, "stream-log")).awaitTermination()
    return incremental.daily_trend(spark, out)


@register
def stream_distinct_urls(spark, sf_dir):
    rows = bindings.as_fetched(_event_stream(spark, sf_dir))
    keys = rows.select("source_name", F.col("url").alias("canonical_url"))
    out = shared_dir(spark, "stream-urls")
    incremental.stream_distinct_urls(keys, out, shared_dir(spark, "stream-log")).awaitTermination()
    return incremental.distinct_urls(spark, out)


@register
def stream_raw_inserts(spark, sf_dir):
    """The events as arriving items, stored in an empty raw table."""
    rows = ingest.to_raw_rows(bindings.as_fetched(_event_stream(spark, sf_dir)), "rss", F.col("collected_at"))
    out = shared_dir(spark, "stream-raw")
    incremental.stream_raw(rows, out, shared_dir(spark, "stream-log")).awaitTermination()
    return tables.read_parts(spark, out, RAW_ARTICLES).select("id", *ingest.RAW_KEY, "status", "external_id", "raw_payload")


@register
def stream_clean(spark, sf_dir):
    """Raw documents as they arrive, cleaned into an empty table."""
    inbox, out = shared_dir(spark, "raw-inbox"), shared_dir(spark, "stream-clean")
    bindings.raw_documents(spark, sf_dir).write.parquet(inbox)
    stream = spark.readStream.schema(RAW_ARTICLES).parquet(inbox)
    incremental.stream_clean(stream, out, shared_dir(spark, "stream-log")).awaitTermination()
    return tables.read_parts(spark, out, CLEAN_ARTICLES).select("id", "raw_id", "url", "title", "body", "category", "clean_status")


@register
def stream_upsert(spark, sf_dir):
    """Raw documents twice, under other ids the second time: every article is written anew in its block."""
    inbox, out, log = shared_dir(spark, "raw-inbox"), shared_dir(spark, "stream-clean"), shared_dir(spark, "stream-log")
    for more in (0, 10_000_000):
        raw = bindings.raw_documents(spark, sf_dir)
        raw.withColumn("id", F.col("id") + more).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(RAW_ARTICLES).parquet(inbox)
        incremental.stream_clean(stream, out, log, policy="upsert").awaitTermination()
    return incremental.upserted(spark, out).select("raw_id", "url", "title", "body", "category", "clean_status")

"""The sample tables seen as article tables. Every view is derived by Spark from the whole table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions.urls import url_host, url_origin
from articleflow.operators.ingest import first_per_key
from articleflow.session import materialize, prepare, spread
from articleflow.sources.pages import extract_article
from articleflow.sources.robots import robots_rules

AGENT = "articleflow"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _days_after(first: str, offset: Column) -> Column:
    return F.date_add(F.to_date(F.lit(first)), offset.cast("int")).cast("timestamp")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
    )


def clean_view(spark: SparkSession, sf_dir: str, *, summaries: bool = True) -> DataFrame:
    """``documents`` as clean articles. A document of good quality has a summary: its first 120 characters."""
    docs = table(spark, sf_dir, "documents")
    if summaries:
        docs = docs.join(labels(spark, sf_dir), "doc_id", "left")
        summary = F.when(F.col("quality") == 1, F.substring("text", 1, 120))
    else:
        summary = F.lit(None).cast("string")
    doc = F.col("doc_id")
    body = F.when(doc % 11 != 0, F.col("text"))
    return docs.select(
        doc.alias("id"),
        doc.alias("raw_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        body.alias("body"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), doc).alias("url"),
        F.col("source"),
        F.col("lang").alias("category"),
        F.when(doc % 5 != 0, _days_after("2024-01-01", doc % 30)).alias("published_at"),
        _days_after("2024-01-15", doc % 20).alias("collected_at"),
        F.lit(None).cast("string").alias("content_hash"),
        F.when(body.isNull(), "no_body").otherwise("ok").alias("clean_status"),
        summary.alias("summary"),
        F.when(summary.isNotNull(), "sample-model").alias("summary_model"),
        F.when(summary.isNotNull(), _days_after("2024-02-05", doc % 3)).alias("summarized_at"),
        F.coalesce(F.length(body), F.lit(0)).cast("long").alias("original_length"),
        F.length(summary).cast("long").alias("summary_length"),
    )


def shared_url() -> Column:
    """A URL that exact copies of a document share."""
    return F.concat(F.lit("https://example.com/"), "lang", F.lit("/"), F.md5("text"))


def merge_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a batch of cleaned rows."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.alias("raw_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        shared_url().alias("url"),
        "source",
        F.col("lang").alias("category"),
        _days_after("2024-01-01", doc % 30).alias("published_at"),
        _days_after("2024-01-15", doc % 20).alias("collected_at"),
        F.md5("text").alias("content_hash"),
        F.lit("ok").alias("clean_status"),
        F.length("text").cast("long").alias("original_length"),
    )


def merge_target(spark: SparkSession, sf_dir: str, *, stored: bool = True) -> DataFrame:
    """Labelled documents as the stored table, one per URL.

    The merges read their table several times, so it is stored, as it would be.
    """
    firsts = first_per_key(older_articles(spark, sf_dir), ("url",), "id")
    return materialize(firsts, name="merge-target") if stored else firsts


def older_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as older articles: an older text, and an older URL where the label says toxic."""
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").join(labels(spark, sf_dir), "doc_id")
    old_url = F.concat(F.lit("https://example.com/old/"), doc)
    return docs.select(
        doc.alias("id"),
        doc.alias("raw_id"),
        F.lit("stored").alias("title"),
        F.concat(F.lit("old "), "text").alias("body"),
        F.when(F.col("toxic") == 1, old_url).otherwise(shared_url()).alias("url"),
        F.lit("archive").alias("source"),
        F.col("lang").alias("category"),
        F.lit(None).cast("timestamp").alias("published_at"),
        _days_after("2023-12-01", doc % 20).alias("collected_at"),
        F.lit(None).cast("string").alias("content_hash"),
        F.lit("ok").alias("clean_status"),
        F.when(F.col("quality") == 1, "kept summary").alias("summary"),
        F.when(F.col("quality") == 1, "sample-model").alias("summary_model"),
        F.lit(None).cast("timestamp").alias("summarized_at"),
        (F.length("text") + 4).cast("long").alias("original_length"),
        F.when(F.col("quality") == 1, F.lit(12)).cast("long").alias("summary_length"),
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as raw rows, with payloads that exercise every fallback of cleaning.

    The body is under another name for some languages, the URL is missing for some, the title for others.
    """
    doc, lang = F.col("doc_id"), F.col("lang")
    link = F.concat(F.lit("HTTPS://"), "source", F.lit(".Example.com:443/"), lang, F.lit("/"), doc, F.lit("/?utm_source=x&id="), doc, F.lit("#top"))
    payload = F.to_json(
        F.struct(
            F.when(doc % 13 == 0, "  ").otherwise(F.substring_index("text", "\n", 1)).alias("title"),
            F.when(lang != "de", link).alias("url"),
            F.when(lang == "en", F.col("text")).when(doc % 7 == 0, "").alias("body"),
            F.when(lang == "fr", F.col("text")).alias("summary"),
            F.when(lang.isin("de", "es"), F.concat(F.lit("<p>"), "text", F.lit("</p>"))).alias("description"),
            F.when(doc % 3 != 0, lang).alias("category"),
            F.date_format(_days_after("2024-01-01", doc % 30), "yyyy/MM/dd").alias("published"),
        )
    )
    return table(spark, sf_dir, "documents").select(
        doc.alias("id"),
        F.lit(None).cast("string").alias("external_id"),
        F.col("source").alias("source_name"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit("rss").alias("collection_method"),
        _days_after("2024-01-15", doc % 20).alias("collected_at"),
        F.concat(F.lit("https://example.com/"), lang, F.lit("/"), doc).alias("canonical_url"),
        F.when(doc % 17 == 0, F.concat(payload, F.lit("]"))).when(doc % 19 == 0, F.concat(F.lit("["), payload, F.lit("]")))
        .otherwise(payload).alias("raw_payload"),
        F.when(doc % 23 == 0, "partial").otherwise("ok").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def collected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as collected items, in order of page id."""
    rows = spread(pages(spark, sf_dir), "page_id").withColumn("_a", extract_article("html", "article h1", "article p"))
    return rows.select(
        url_host("url").alias("source_name"), F.lit(1).alias("attempted"), F.lit(True).alias("ok"),
        F.col("page_id").alias("seq"), "url", "_a.title", "_a.body", "_a.published_raw",
        F.col("url").alias("external_id"), F.lit("web").alias("category"), url_origin("url").alias("source_url"),
        F.lit(None).cast("string").alias("error"),
    )


def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of ``pages`` as storable raw rows, texts left out."""
    from articleflow.functions.urls import normalize_url

    return pages(spark, sf_dir).select(
        F.col("page_id").alias("seq"), url_host("url").alias("source_name"), "url",
        normalize_url("url").alias("canonical_url"), F.lit(True).alias("storable"),
    )


def fetched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_fetched(table(spark, sf_dir, "events"))


def as_fetched(events: DataFrame) -> DataFrame:
    """Events as the outcome of fetching items: errors fail, signups lack a title."""
    source = F.concat(F.lit("s"), F.col("user_id") % 8)
    kind = F.col("event_type")
    return events.select(
        source.alias("source_name"), F.lit(1).alias("attempted"), (kind != "error").alias("ok"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("https://"), source, F.lit(".example.com/item/"), F.get_json_object("props", "$.k"), F.lit("/"), kind).alias("url"),
        F.when(kind != "signup", kind).otherwise("").alias("title"),
        F.col("props").alias("body"),
        F.date_format("ts", "yyyy-MM-dd").alias("published_raw"),
        F.col("event_id").cast("string").alias("external_id"),
        F.lit("events").alias("category"), F.lit(None).cast("string").alias("source_url"),
        F.when(kind == "error", "HTTP 503").alias("error"),
        F.col("ts").cast("timestamp").alias("collected_at"),
    )


TALK = "https://talk.example.com/"


def _escaped_text() -> Column:
    escaped = F.col("text")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(name))
    return escaped


def _item(title: Column | str = "role") -> Column:
    link = F.concat(F.lit(TALK), "conv_id", F.lit("/"), "turn", F.lit("?utm_source=feed"))
    return F.concat(
        F.lit("<item><title>"), title, F.lit("</title><link>"), F.when(F.col("turn") != 2, link).otherwise(""),
        F.lit("</link><pubDate>Mon, 01 Jan 2024 0"), "turn", F.lit(":00:00 +0900</pubDate><description>"), _escaped_text(),
        F.lit("</description></item>"),
    )


def _documents_of(turns: DataFrame, content) -> DataFrame:
    """One document per conversation out of its items, in order of turns. A conversation has a handful of turns, so a document stays small."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "item"))), lambda entry: entry["item"])
    return turns.groupBy("conv_id").agg(F.array_join(items, "").alias("_items")).select(
        F.col("conv_id").alias("doc_no"), F.concat(F.lit("talk-"), "conv_id").alias("source_name"), F.lit("talk").alias("category"),
        F.concat(F.lit(TALK + "feed/"), "conv_id").alias("source_url"), content.alias("content"),
    )


def _rss() -> Column:
    return F.concat(F.lit("<rss version='2.0'><channel><title>talk "), "conv_id", F.lit("</title>"), "_items", F.lit("</channel></rss>"))


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a feed document whose items are its turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", _item().alias("item"))
    return _documents_of(turns, _rss())


def odd_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as feeds that are written as they should not be: Atom under prefixes of its own, cut off in the last item, broken in the second."""
    kind = F.col("conv_id") % 3
    link = F.concat(F.lit("<a:link href='" + TALK), "conv_id", F.lit("/"), "turn", F.lit("?utm_source=feed'/>"))
    entry = F.concat(
        F.lit("<a:entry><a:title>"), "role", F.lit("</a:title>"), F.when(F.col("turn") != 2, link).otherwise(""), F.lit("<d:date>2024-01-0"), "turn",
        F.lit("</d:date><a:summary>"), _escaped_text(), F.lit("</a:summary></a:entry>"),
    )
    broken = F.when((kind == 2) & (F.col("turn") == 1), _item(F.concat("role", F.lit("</b>")))).otherwise(_item())
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(kind == 0, entry).otherwise(broken).alias("item"))
    names = "xmlns:a='http://www.w3.org/2005/Atom' xmlns:d=\"http://purl.org/dc/elements/1.1/\""
    atom = F.concat(F.lit(f"<a:feed {names}><a:title>talk "), "conv_id", F.lit("</a:title>"), "_items", F.lit("</a:feed>"))
    cut = F.left(_rss(), F.length(_rss()) - len("ription></item></channel></rss>"))
    return _documents_of(turns, F.when(kind == 0, atom).when(kind == 1, cut).otherwise(_rss()))


def large_feed(spark: SparkSession, sf_dir: str, path: str) -> str:
    """All turns as the items of one feed below ``path``, whose parts in the order of their names are the document."""
    turns = table(spark, sf_dir, "conversations").select(F.lit(1).alias("place"), "conv_id", "turn", _item().alias("value"))
    edges = spark.createDataFrame(
        [(0, None, None, "<rss version='2.0'><channel><title>all talks</title>"), (2, None, None, "</channel></rss>")], "place int, conv_id long, turn long, value string"
    )
    turns.unionByName(edges).orderBy("place", "conv_id", "turn").select("value").write.text(path)
    return path


INDEX_SIZE = 50


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages that link to ``pages``, fifty links each, as crawl sources with their markup."""
    href = F.replace("url", F.lit("&"), F.lit("&amp;"))
    chunk = F.floor(F.col("page_id") / INDEX_SIZE)
    anchors = pages(spark, sf_dir).select(
        chunk.alias("source_no"), "page_id", F.concat(F.lit('<li><a href="'), href, F.lit('">x</a></li>')).alias("item")
    )
    items = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "item"))), lambda entry: entry["item"])
    rows = anchors.groupBy("source_no").agg(items.alias("_items"))
    return rows.select(
        "source_no", F.concat(F.lit("index-"), "source_no").alias("source_name"),
        F.concat(F.lit("https://index.example.com/"), "source_no").alias("list_url"),
        F.lit(None).cast("string").alias("base_url"), F.lit("web").alias("category"),
        F.lit("ul.list a").alias("article_link_selector"), F.lit("h1").alias("title_selector"),
        F.lit("article p").alias("body_selector"), F.lit(None).cast("string").alias("date_selector"),
        F.concat(F.lit('<ul class="list">'), F.array_join("_items", ""), F.lit('<li><a href="#end">e</a></li></ul>')).alias("html"),
    )


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file for every origin of ``pages``; mobile hosts answer 404."""
    origin = url_origin("url")
    body = F.concat(
        F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/9\nDisallow: /en/\nDisallow: /es\nCrawl-delay: "),
        F.length("origin") % 4, F.lit("\n"),
    )
    status = F.when(F.col("origin").contains("://m."), 404).otherwise(200)
    return pages(spark, sf_dir).select(origin.alias("origin")).distinct().select("origin", status.alias("status"), body.alias("body"))


def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots_rules(robots_files(spark, sf_dir), AGENT)


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn wrapped as a model reply: plain, fenced, inside prose, or broken, by turn."""
    lists = {
        "trends": F.split("text", "\n"),
        "keywords": F.split("text", " "),
        "implications": F.when(F.col("turn") == 5, F.array().cast("array<string>")).otherwise(F.array("text")),
    }
    reply = F.to_json(F.struct(*[value.alias(name) for name, value in lists.items()]))
    turn = F.col("turn")
    wrapped = (
        F.when(turn == 1, F.concat(F.lit("```json\n"), reply, F.lit("\n```")))
        .when(turn == 2, F.concat(F.lit("결과는 다음과 같습니다: "), reply, F.lit(" 이상입니다.")))
        .when(turn == 3, F.col("text"))
        .when(turn == 4, F.concat(F.lit("["), reply, F.lit("]")))
        .otherwise(reply)
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", wrapped.alias("reply"))


def analysis_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored run per category and publication day of the articles."""
    rows = clean_view(spark, sf_dir, summaries=False).where(F.col("published_at").isNotNull())
    day = F.date_format("published_at", "yyyy-MM-dd")
    runs = rows.groupBy("category", day.alias("date_from")).agg(F.max("id").alias("id"), F.count("*").alias("article_count"))
    texts = {
        "trends": F.array(F.concat(F.lit("trend "), "category")),
        "keywords": F.array("category", "date_from"),
        "commonalities_differences": F.array().cast("array<string>"),
        "implications": F.array(F.lit("x")),
    }
    return runs.select(
        "id", "date_from", F.col("date_from").alias("date_to"), "category", "article_count",
        *[value.alias(name) for name, value in texts.items()],
        F.lit("sample-model").alias("model"), F.to_timestamp("date_from").alias("created_at"),
    )

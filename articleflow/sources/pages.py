"""HTML pages as tables: link lists, article fields and the two-level crawl that joins them."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from articleflow.functions import ColumnOrName, as_column
from articleflow.functions.text import filled
from articleflow.functions.urls import resolve_urls, url_origin
from articleflow.schemas import string_struct
from articleflow.session import materialize
from articleflow.sources.fetched import newest_fetch
from articleflow.sources.markup import PageFault, collect, parse_selector
from articleflow.sources.robots import fetch_slots, mark_allowed

# Link targets that lead to no page.
SKIPPED_LINKS = ("#", "javascript:", "mailto:")
# Where a title or a date is looked for when the source's own selector finds none.
FALLBACKS = {
    "heading": "h1",
    "page_title": "title",
    "meta_published": 'meta[property="article:published_time"]',
    "meta_date": 'meta[name="date"]',
}


@arrow_udf(T.ArrayType(string_struct("href", "fault")))
def _anchors(markups: pa.Array, selectors: pa.Array) -> pa.Array:
    out = []
    for markup, selector in zip(markups.to_pylist(), selectors.to_pylist()):
        if markup is None or not selector:
            out.append(None)
            continue
        try:
            out.append([{"href": attrs.get("href"), "fault": None} for attrs, _ in collect(markup, {"link": selector})["link"]])
        except PageFault as problem:
            out.append([{"href": None, "fault": str(problem)}])
    return pa.array(out, pa.list_(pa.struct({"href": pa.string(), "fault": pa.string()})))


def leads_to_page(href: ColumnOrName) -> Column:
    """The link has a target and the target is not an anchor, a script or a mail address."""
    href = as_column(href)
    keep = href.isNotNull() & (href != "")
    for prefix in SKIPPED_LINKS:
        keep = keep & ~href.startswith(prefix)
    return keep


def _selector(value: Column | str | None) -> Column:
    """A selector as a column; one that is written in the program is checked at once."""
    if isinstance(value, str) and value:
        parse_selector(value)
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def page_links(html: ColumnOrName, selector: Column | str, base: Column | str, limit: int | None = None) -> Column:
    """Absolute link targets of one page: first occurrences, in page order, at most ``limit``.

    All links of a page sit in that page's row, so de-duplication and the limit need no shuffle.
    """
    return _targets(_anchors(as_column(html), _selector(selector)), base if isinstance(base, Column) else F.lit(base), limit)


def _targets(found: Column, base: Column, limit: int | None) -> Column:
    hrefs = F.filter(F.transform(found, lambda link: link["href"]), leads_to_page)
    urls = F.array_distinct(F.filter(resolve_urls(base, hrefs), lambda url: url.isNotNull()))
    return urls if limit is None else F.slice(urls, 1, max(0, limit))


def extract_links(
    pages: DataFrame, selector: Column | str, base: Column | str, *, html: str = "html", limit: int | None = None
) -> DataFrame:
    """One row per link: the columns of ``pages`` but the markup, with ``pos`` (from 0) and ``link``."""
    return _one_per_link(pages.withColumn("_links", page_links(html, selector, base, limit)).drop(html))


def _one_per_link(listed: DataFrame) -> DataFrame:
    """Explode ``_links``. A plain explode makes Spark test for empty lists first, which would parse every page
    twice; the outer form does not, and the rows of empty lists are dropped afterwards."""
    kept = [name for name in listed.columns if name != "_links"]
    return listed.select(*kept, F.posexplode_outer("_links").alias("pos", "link")).where(F.col("pos").isNotNull())


_FIELDS = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("heading", T.StringType()),
        T.StructField("page_title", T.StringType()),
        T.StructField("bodies", T.ArrayType(T.StringType())),
        T.StructField("datetime", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("date_text", T.StringType()),
        T.StructField("has_meta_published", T.BooleanType()),
        T.StructField("meta_published", T.StringType()),
        T.StructField("meta_date", T.StringType()),
        T.StructField("fault", T.StringType()),
    ]
)


@arrow_udf(_FIELDS)
def _article_fields(
    markups: pa.Array, titles: pa.Array, bodies: pa.Array, dates: pa.Array, repeats: pa.Array
) -> pa.Array:
    out = []
    for markup, repeat, *own in zip(*[column.to_pylist() for column in (markups, repeats, titles, bodies, dates)]):
        if markup is None:
            out.append(None)
            continue
        chosen = {name: selector for name, selector in zip(("title", "body", "date"), own) if selector}
        try:
            found = collect(markup, FALLBACKS | chosen, repeat)
        except PageFault as problem:
            out.append({"fault": str(problem)})
            continue

        def first(name):
            return next(iter(found.get(name, ())), (None, None))

        def text(name):
            pieces = first(name)[1]
            return None if pieces is None else " ".join(pieces)

        date = first("date")[0] or {}
        published, dated = first("meta_published")[0], first("meta_date")[0]
        out.append(
            {
                "title": text("title"),
                "heading": text("heading"),
                "page_title": text("page_title"),
                "bodies": [" ".join(pieces) for _, pieces in found.get("body", ())],
                "datetime": date.get("datetime"),
                "content": date.get("content"),
                "date_text": text("date"),
                "has_meta_published": published is not None,
                "meta_published": (published or {}).get("content"),
                "meta_date": (dated or {}).get("content"),
            }
        )
    return pa.array(out, to_arrow_type(_FIELDS))


def extract_article(
    html: ColumnOrName,
    title_selector: Column | str | None,
    body_selector: Column | str | None,
    date_selector: Column | str | None = None,
    *,
    repeat_nested: bool = True,
) -> Column:
    """``struct<title, body, published_raw, error>`` of an article page; what is not found stays NULL.

    ``error`` says why a page (or a selector from a column) could not be read; the other fields are NULL then.

    Title: own selector, then the first ``h1``, then ``<title>``. Body: all matches, blank line between.
    Date: ``datetime``, ``content`` or text of the own selector, then the two usual ``<meta>`` tags.

    A match inside another match (after an unclosed paragraph, say) has its text in both; on pages with very
    many such paragraphs ``repeat_nested=False`` keeps the body as long as the page, each text once.
    """
    raw = _article_fields(
        as_column(html), *[_selector(s) for s in (title_selector, body_selector, date_selector)], F.lit(repeat_nested)
    )
    texts = F.filter(raw["bodies"], lambda chunk: chunk != "")
    meta = F.when(raw["has_meta_published"], raw["meta_published"]).otherwise(raw["meta_date"])
    return F.struct(
        F.coalesce(filled(raw["title"]), raw["heading"], raw["page_title"]).alias("title"),
        filled(F.array_join(texts, "\n\n")).alias("body"),
        F.coalesce(filled(raw["datetime"]), filled(raw["content"]), filled(raw["date_text"]), meta).alias("published_raw"),
        raw["fault"].alias("error"),
    )


# Fixed value: the message of a page that could not be had when no reason is given.
MISSING_PAGE = "HTTP 요청 실패"


# Fixed value: the message of a page that its origin does not allow to be read.
DENIED = "robots.txt가 수집을 허용하지 않습니다: %s"
_SELECTORS = ("title_selector", "body_selector", "date_selector")


def crawl_links(
    sources: DataFrame, pages: DataFrame, *, limit: int | None = None, detail_url: str = "url", rules: DataFrame | None = None
) -> DataFrame:
    """One row per link of every list page: the columns of ``sources`` with ``pos``, ``link`` and ``list_error``.

    A list page that is missing, denied by ``rules`` or can't be read stands as one row without a link. No markup is in the result; store it before it is read twice, or list pages are parsed twice.
    """
    fetched = newest_fetch(pages, "html", detail_url).select(F.col(detail_url).alias("_page"), "html", "error")
    asked = sources.withColumn("_allowed", F.lit(True))
    if rules is not None:
        asked = mark_allowed(sources, rules, url="list_url").drop("origin", "crawl_delay").withColumnRenamed("allowed", "_allowed")
    lists = asked.join(fetched, F.col("_allowed") & (F.col("list_url") == F.col("_page")), "left").drop("_page")
    base = F.coalesce(filled("base_url"), F.col("list_url"))
    lists = lists.withColumn("_found", _anchors(F.col("html"), F.col("article_link_selector"))).withColumn("_base", base)
    found = _targets(F.col("_found"), F.col("_base"), limit)
    fault = F.get(F.filter(F.transform("_found", lambda link: link["fault"]), lambda text: text.isNotNull()), F.lit(0))
    no_list = F.col("html").isNull() | fault.isNotNull()
    listed = lists.withColumns(
        {
            "_links": F.when(no_list, F.array(F.lit(None).cast("string"))).otherwise(found),
            "list_error": F.when(~F.col("_allowed"), F.format_string(DENIED, "list_url")).when(no_list, F.coalesce(fault, F.col("error"), F.lit(MISSING_PAGE))),
        }
    ).drop("html", "error", "_found", "_base", "_allowed")
    return _one_per_link(listed).withColumn("seq", F.shiftleft(F.col("source_no").cast("long"), 32) + F.col("pos"))


def crawl_frontier(links: DataFrame, rules: DataFrame | None = None, *, delay: float = 1.0) -> DataFrame:
    """The pages to fetch, each once: ``link``, ``seq`` (of its first mention), ``allowed`` and, for allowed ones, the start slot of its request.

    ``links`` is a stored ``crawl_links``, ``rules`` what ``robots_rules`` gives; without rules everything is allowed. However often a page is linked, robots and
    slots see it once.
    """
    distinct = links.where(F.col("link").isNotNull()).groupBy("link").agg(F.min("seq").alias("seq"))
    if rules is None:
        return distinct.withColumns({"origin": url_origin("link"), "allowed": F.lit(True)})
    marked = materialize(mark_allowed(distinct, rules, url="link"), name="frontier")
    slots = fetch_slots(marked.where("allowed"), seq="seq", delay=delay)
    return slots.unionByName(marked.where(~F.col("allowed")), allowMissingColumns=True)


def crawl(
    sources: DataFrame, pages: DataFrame, *, limit: int | None = None, detail_url: str = "url", repeat_nested: bool = True,
    rules: DataFrame | None = None, links: DataFrame | None = None, frontier: DataFrame | None = None,
) -> DataFrame:
    """List page -> links -> article pages for every web source, one row per attempted article.

    ``sources`` is the registry (``source_no, source_name, list_url, base_url, category`` and the selectors);
    ``pages`` holds what was fetched (``url, html, error``; ``html`` NULL for a failure; the newest by ``fetched_at`` where a URL was fetched more than once). A failing page
    gives a row with ``ok = false`` and does not touch its neighbours; a failing list page gives a single
    such row with ``attempted = 0``; a link that the robots ``rules`` of its origin deny is a failed row too, and its page is not read.

    The links of all lists become a frontier of distinct pages. Each is parsed once per set of selectors, and what came of it is joined back to the links.
    ``links`` and ``frontier`` take stored tables of ``crawl_links`` and ``crawl_frontier``.
    """
    if links is None:
        links = materialize(crawl_links(sources, pages, limit=limit, detail_url=detail_url, rules=rules), name="links")
    if frontier is None:
        frontier = crawl_frontier(links, rules)
    fetched = newest_fetch(pages, "html", detail_url).select(F.col(detail_url).alias("link"), "html", F.col("error").alias("_error"))
    how = F.struct(*_SELECTORS).alias("_how")
    wanted = links.where(F.col("link").isNotNull()).select("link", how).distinct().join(frontier.select("link", "allowed"), "link")
    read = wanted.where("allowed").drop("allowed").join(fetched, "link")
    article = extract_article("html", *[F.col(f"_how.{name}") for name in _SELECTORS], repeat_nested=repeat_nested)
    articles = read.select("link", "_how", "_error", F.col("html").isNotNull().alias("_there"), article.alias("_article")).unionByName(
        wanted.where(~F.col("allowed")).select("link", "_how", F.format_string(DENIED, "link").alias("_error"), F.lit(False).alias("_there")),
        allowMissingColumns=True,
    )
    detail = links.withColumn("_how", how).join(articles, ["link", "_how"], "left")
    failed_list = F.col("list_error").isNotNull()
    failed = ~F.coalesce(F.col("_there"), F.lit(False)) | F.col("_article.error").isNotNull()
    return detail.select(
        "source_name",
        F.when(failed_list, 0).otherwise(1).alias("attempted"),
        (~failed).alias("ok"),
        F.when(~failed_list, F.col("pos")).alias("pos"),
        "seq",
        F.coalesce("link", "list_url").alias("url"),
        F.when(~failed, F.col("_article.title")).alias("title"),
        F.when(~failed, F.col("_article.body")).alias("body"),
        F.when(~failed, F.col("_article.published_raw")).alias("published_raw"),
        F.when(~failed, F.col("link")).alias("external_id"),
        "category",
        F.col("list_url").alias("source_url"),
        F.when(failed, F.coalesce("list_error", "_article.error", "_error", F.lit(MISSING_PAGE))).alias("error"),
    )

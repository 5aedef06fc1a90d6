"""Feeds, pages, registry and robots rules on small documents."""

import json
import re
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from articleflow.functions import urls
from articleflow.session import materialize
from articleflow.sources import feeds, pages, registry, robots
from articleflow.sources.markup import collect, parse_selector

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0"><channel><title>소식</title><link>https://feed.test/</link>
<item><title>첫 소식</title><link>https://news.test/1?utm_source=rss&amp;id=3#top</link><guid isPermaLink="false">n-1</guid>
  <pubDate>Mon, 04 Aug 2026 09:30:00 +0000</pubDate><category>IT</category><description>&lt;p&gt;본문 &lt;b&gt;하나&lt;/b&gt;&lt;/p&gt;</description></item>
<item><title>둘째 &amp;quot;소식&amp;quot;</title><originallink>https://press.test/2</originallink><link>https://portal.test/2</link></item>
<item><title>no body</title><link>https://news.test/3</link></item>
<item><title>no link</title><description>lost</description></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>atom</title>
<entry><title>a</title><link rel="self" href="https://a.test/self"/><link href="https://a.test/1"/><id>urn:1</id>
  <updated>2026-08-01T00:00:00Z</updated><summary>short</summary><content type="html">long</content></entry>
<entry><title>b</title><id>https://a.test/only-id</id></entry></feed>"""


@pytest.fixture(scope="module")
def docs(spark):
    texts = [RSS, ATOM, "not a feed", "<rss><channel><title>empty</title></channel></rss>"]
    rows = [(i, f"s{i}", "AI", f"https://src.test/{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_no long, source_name string, category string, source_url string, content string")


def test_rss_items_and_error(docs):
    rows = feeds.parse_feeds(docs).where("source_name = 's0'").orderBy("pos").collect()
    assert [r.ok for r in rows] == [True, True, True, False]
    assert [r.attempted for r in rows] == [1, 1, 1, 1]
    first, second, third, last = rows
    assert first.url == "https://news.test/1?utm_source=rss&id=3#top"
    assert first.external_id == "n-1" and first.published_raw == "Mon, 04 Aug 2026 09:30:00 +0000"
    assert first.body == "<p>본문 <b>하나</b></p>" and first.category == "AI" and first.feed_title == "소식"
    assert second.url == "https://press.test/2" and second.external_id == second.url and second.title == "둘째 &quot;소식&quot;"
    assert third.body is None
    assert last.error == feeds.NO_LINK and last.url == "https://src.test/0" and last.title is None


def test_atom_entries(docs):
    a, b = feeds.parse_feeds(docs).where("source_name = 's1'").orderBy("pos").collect()
    assert (a.url, a.body, a.published_raw, a.external_id) == ("https://a.test/1", "long", "2026-08-01T00:00:00Z", "urn:1")
    assert b.url == "https://a.test/only-id"


def test_unreadable_and_empty_documents(docs):
    rows = feeds.parse_feeds(docs).where("source_name in ('s2', 's3')").collect()
    assert [(r.source_name, r.ok, r.attempted, r.error) for r in rows] == [("s2", False, 0, feeds.BROKEN_FEED)]


def test_limit_cuts_before_checking(docs):
    rows = feeds.parse_feeds(docs, limit=2).where("source_name = 's0'").collect()
    assert len(rows) == 2 and all(r.ok for r in rows)


def test_read_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS, encoding="utf-8")
    (tmp_path / "b.xml").write_text(ATOM, encoding="utf-8")
    files = feeds.read_feed_files(spark, str(tmp_path / "*.xml"))
    docs = files.withColumns(
        {"doc_no": F.when(F.col("path").endswith("a.xml"), 0).otherwise(1), "source_name": F.lit("x"), "category": F.lit("c"), "source_url": F.lit("u")}
    )
    assert feeds.parse_feeds(docs).count() == 6


def test_read_large_feed(spark, tmp_path):
    (tmp_path / "big.xml").write_text(RSS, encoding="utf-8")
    rows = feeds.read_large_feed(spark, str(tmp_path / "big.xml"), source_name="s", category="c", source_no=3, source_url="u")
    whole = {(r.ok, r.url, r.title, r.body, r.external_id, r.error) for r in rows.collect()}
    docs = spark.createDataFrame([(0, "s", "c", "u", RSS)], "doc_no long, source_name string, category string, source_url string, content string")
    assert whole == {(r.ok, r.url, r.title, r.body, r.external_id, r.error) for r in feeds.parse_feeds(docs).collect()}


def test_collect_feeds(spark):
    sources = spark.createDataFrame(
        [(0, "a", "https://h.test/f", "AI", {"display": "20"}), (1, "b", "https://h.test/g", "IT", None)],
        "source_no int, source_name string, url string, category string, params map<string,string>",
    )
    fetched = spark.createDataFrame(
        [("https://h.test/f?display=3", RSS, None), ("https://h.test/g", None, "HTTP 500")], "url string, content string, error string"
    )
    rows = feeds.collect_feeds(sources, fetched, limit=3).orderBy("source_name", "pos").collect()
    assert [(r.source_name, r.ok, r.attempted) for r in rows] == [("a", True, 1)] * 3 + [("b", False, 0)]
    assert rows[-1].error == "HTTP 500" and rows[-1].url == "https://h.test/g"


PAGE = """<html><head><title>page title</title><meta property="article:published_time" content="2026-08-07T10:20:30+00:00"></head>
<body><h1 id="head">Main &amp; <i>title</i></h1><div class="text main"><p><span class="when">August 6, 2026</span></p>
<p>one&nbsp;<b>two</b> three<script>var x = "<p>no</p>";</script></p><p> </p><!-- <p>comment</p> --><p>four<br>five</p></div>
<p>outside</p></body></html>"""


def article(spark, html, *selectors):
    row = spark.createDataFrame([(html,)], "html string").select(pages.extract_article("html", *selectors).alias("a")).first()
    assert row.a.error is None
    return tuple(row.a)[:3]


def test_article_fields(spark):
    got = article(spark, PAGE, "h1#head", ".text.main p", "span.when")
    assert got == ("Main & title", "August 6, 2026\n\none two three\n\nfour five", "August 6, 2026")


def test_article_fallbacks(spark):
    assert article(spark, PAGE, "h9.none", "p.none", ".none") == ("Main & title", None, "2026-08-07T10:20:30+00:00")
    assert article(spark, "<title>only</title><time datetime='2026-01-01'>x</time>", None, None, "time") == ("only", None, "2026-01-01")
    assert article(spark, '<meta name="date" content="2026-02-02">', None, "p", None) == (None, None, "2026-02-02")


def test_entities():
    found = collect("<h1>a &amp b &amp;amp; &lt;i&gt; &#65;&#x42; &copy &nosuch; &amp</h1>", {"h": "h1"})["h"]
    assert found[0][1] == ["a & b &amp; <i> AB © &nosuch &"]


def test_unclosed_paragraphs_hold_what_follows():
    found = collect("<div><p>a<p>b</p>c</div><p>d", {"p": "p"})["p"]
    assert [" ".join(pieces) for _, pieces in found] == ["a b c", "b", "d"]
    once = collect("<div><p>a<p>b</p>c</div><p>d", {"p": "p", "d": "div"}, repeat=False)
    assert [" ".join(pieces) for _, pieces in once["p"]] == ["a c", "b", "d"]
    assert [" ".join(pieces) for _, pieces in once["d"]] == ["a b c"]


def test_nested_text_once_stays_as_long_as_the_page(spark):
    many = "<p>" + "<p>".join(str(i) for i in range(300))
    row = spark.createDataFrame([(many,)], "html string")
    whole, once = row.select(
        pages.extract_article("html", None, "p").alias("a"), pages.extract_article("html", None, "p", repeat_nested=False).alias("b")
    ).select("a.body", "b.body").first()
    assert once == "\n\n".join(str(i) for i in range(300))
    assert whole.split("\n\n")[298] == "298 299" and whole.startswith("0 1 2 ")


LIST = """<div id="box"><ul class="g x"><li><a href="/a/1">1</a><a href="/a/2">2</a><a href="/a/2">again</a>
<a href="#x">anchor</a><a>none</a><a href="">empty</a><a href="javascript:x()">js</a><a href="mailto:m@x">m</a>
<a href="b/3?q=1&amp;r=2">3</a><a href="http://other.test/4">4</a></li></ul></div><div><a href="/side">s</a></div>"""


def test_links(spark):
    row = spark.createDataFrame([(LIST, 7)], "html string, k int")
    links = pages.extract_links(row, "#box .g li a", "https://h.test/l/").orderBy("pos").collect()
    assert [r.link for r in links] == ["https://h.test/a/1", "https://h.test/a/2", "https://h.test/l/b/3?q=1&r=2", "http://other.test/4"]
    assert [r.pos for r in links] == [0, 1, 2, 3]
    assert [r.link for r in pages.extract_links(row, "#box a", "https://h.test", limit=2).collect()] == ["https://h.test/a/1", "https://h.test/a/2"]
    assert pages.extract_links(row, "#box a", "https://h.test", limit=0).count() == 0


@pytest.mark.parametrize(
    "selector, count",
    [("a", 11), ('a[href*="/a/"]', 3), ("a[href^=http]", 1), ('a[href$="3?q=1&r=2"]', 1), ("ul[class~=x] a[href]", 9), ("#box, .g", 2), ("div div", 0), ("*[href='/side']", 1)],
)
def test_selectors(selector, count):
    assert len(collect(LIST, {"s": selector})["s"]) == count


@pytest.mark.parametrize("selector", ["a:hover", "", "a[b"])
def test_unknown_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        parse_selector(selector)


def test_crawl(spark):
    sources = spark.createDataFrame(
        [(0, "web", "https://h.test/list", "https://h.test", "IT", "#box a", "h1", ".main p", None), (1, "down", "https://d.test/list", None, "IT", "a", "h1", "p", None)],
        "source_no int, source_name string, list_url string, base_url string, category string, article_link_selector string, title_selector string, body_selector string, date_selector string",
    )
    stored = spark.createDataFrame(
        [("https://h.test/list", LIST, None), ("https://h.test/a/1", PAGE, None), ("https://h.test/a/2", None, "HTTP 503"), ("https://d.test/list", None, "timeout")],
        "url string, html string, error string",
    )
    rows = pages.crawl(sources, stored, limit=3).orderBy("source_name", "pos").collect()
    assert [(r.source_name, r.attempted, r.ok, r.error) for r in rows] == [
        ("down", 0, False, "timeout"), ("web", 1, True, None), ("web", 1, False, "HTTP 503"), ("web", 1, False, pages.MISSING_PAGE),
    ]
    assert rows[1].title == "Main & title" and rows[1].source_url == "https://h.test/list"


CONFIG = {
    "sources": {
        "ok_rss": {"type": "rss", "url": "https://h.test/f", "params": {"q": "x"}, "category": "AI", "auth_header_env": {"H": "NAME"}},
        "ok_web": {"type": "web", "list_url": "l", "article_link_selector": "a", "title_selector": "t", "body_selector": "b"},
        "no_type": {"url": "x"},
        "bad_type": {"type": "ftp"},
        "no_url": {"type": "rss"},
        "example": {"type": "rss", "url": "REPLACE_WITH_YOUR_URL"},
        "bad_env": {"type": "rss", "url": "u", "auth_header_env": {"H": " "}},
        "half_web": {"type": "web", "list_url": "l", "title_selector": "t", "body_selector": "b"},
    }
}


def test_registry(spark):
    found = registry.source_registry(spark.createDataFrame([(json.dumps(CONFIG),)], "text string"))
    good = {r.source_name: r for r in registry.valid_sources(found).collect()}
    assert set(good) == {"ok_rss", "ok_web"}
    assert good["ok_rss"].params == {"q": "x"} and good["ok_rss"].category == "AI" and good["ok_web"].category == "unknown"
    assert {r.source_name for r in registry.rejected_sources(found).collect()} == set(CONFIG["sources"]) - set(good)


def test_match_sources(spark):
    found = registry.source_registry(spark.createDataFrame([(json.dumps(CONFIG),)], "text string"))
    asked = spark.createDataFrame([("ok_rss", "rss"), ("ok_rss", "crawl"), ("gone", "rss"), ("ok_web", "x")], "source_name string, collection_method string")
    got = {(r.source_name, r.collection_method): r.problem for r in registry.match_sources(asked, found).collect()}
    assert got[("ok_rss", "rss")] is None
    assert all(got[key] for key in got if key != ("ok_rss", "rss"))


ROBOTS = "User-agent: special\nDisallow: /only\n\nUser-agent: *\nAllow: /a/open\nDisallow: /a/\nDisallow: /q%3Fx\nDisallow: \nCrawl-delay: 3\n"


def test_robots(spark):
    files = spark.createDataFrame(
        [("https://h.test", 200, ROBOTS), ("https://gone.test", 404, "User-agent: *\nDisallow: /"), ("https://none.test", None, None)],
        "origin string, status int, body string",
    )
    asked = [
        ("https://h.test/a/open/1", True), ("https://h.test/a/x", False), ("https://h.test/%61/x", False), ("https://h.test/b", True),
        ("https://h.test/q?x=1", False), ("https://h.test", True), ("https://h.test/only", True), ("https://gone.test/a/", True),
        ("https://none.test/a/", True), ("https://unlisted.test/", True),
    ]
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(asked)], "i int, url string")
    marked = robots.mark_allowed(rows, robots.robots_rules(files, "someone/1.0"))
    assert [r.allowed for r in marked.orderBy("i").collect()] == [want for _, want in asked]
    special = robots.mark_allowed(rows, robots.robots_rules(files, "Special/2"))
    assert [r.allowed for r in special.where("url like 'https://h.test%'").orderBy("i").collect()] == [True] * 6 + [False]


def test_fetch_slots(spark):
    rows = spark.createDataFrame([(i, "https://a" if i % 3 else "https://b", 2.5 if i % 3 else None) for i in range(9)], "i long, origin string, crawl_delay double")
    got = {r.i: r.slot_seconds for r in robots.fetch_slots(rows, seq="i", delay=1.0).collect()}
    assert got == {0: 0.0, 3: 1.0, 6: 2.0, 1: 0.0, 2: 2.5, 4: 5.0, 5: 7.5, 7: 10.0, 8: 12.5}


STEPS = (
    "<ul><li><a href='/1'>a</a></li><li class='x'><a href='/2'>b</a><p><a href='/3'>c</a></p></li><li><a href='/4'>d</a></li></ul>"
    "<h2>t</h2><p>after</p><div><p>inner</p></div><p>last</p>"
)


@pytest.mark.parametrize(
    "selector, want",
    [
        ("li > a", ["a", "b", "d"]),
        ("ul a", ["a", "b", "c", "d"]),
        ("li:nth-child(2) a", ["b", "c"]),
        ("li:nth-child(odd) > a", ["a", "d"]),
        ("li:not(.x) > a", ["a", "d"]),
        ("li:first-child a, li.x > p > a", ["a", "c"]),
        ("h2 + p", ["after"]),
        ("h2 ~ p", ["after", "last"]),
        ("li.x + li > a", ["d"]),
        ("* > ul", []),
    ],
)
def test_selector_steps(selector, want):
    assert [" ".join(pieces) for _, pieces in collect(STEPS, {"it": selector})["it"]] == want


@pytest.mark.parametrize("selector", ["> a", "a >", "a > > b", "a:hover", "a:nth-child(x)", "a::before", "[x", ""])
def test_unreadable_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        parse_selector(selector)


def test_a_bad_page_or_selector_is_one_failed_row(spark):
    fields = "source_no int, source_name string, list_url string, base_url string, category string, article_link_selector string, title_selector string, body_selector string, date_selector string"
    web = spark.createDataFrame([(0, "ok", "l1", "http://h/", "c", "a", "h1", "p", None), (1, "bad", "l1", "http://h/", "c", "a:hover", "h1", "p", None), (2, "torn", "l2", "http://h/", "c", "a", "h1", "p", None)], fields)
    fetched = spark.createDataFrame([("l1", "<a href='/good'></a><a href='/torn'></a>", None), ("l2", "<![ ", None), ("http://h/good", "<h1>T</h1><p>B", None), ("http://h/torn", "<h1>T</h1><![foo[x]]>", None)], "url string, html string, error string")
    rows = {(r.source_name, r.url): r for r in pages.crawl(web, fetched).collect()}
    assert {k: (r.ok, r.attempted) for k, r in rows.items()} == {("ok", "http://h/good"): (True, 1), ("ok", "http://h/torn"): (False, 1), ("bad", "l1"): (False, 0), ("torn", "l2"): (False, 0)}
    assert all((r.error is None) == r.ok for r in rows.values()) and rows["ok", "http://h/good"].body == "B"


def test_request_url_of_a_broken_url(spark):
    row = spark.createDataFrame([("http://[broken", {"a": "1"})], "url string, params map<string,string>").select(urls.request_url("url", "params", 5).alias("u")).first()
    assert row.u is None


def test_source_numbers_do_not_repeat(spark):
    config = spark.createDataFrame([('{"sources":{"a":{"type":"rss"},"b":{"type":"web"}}}',), ('{"sources":{"c":{"type":"rss"}}}',)], "text string")
    assert sorted(r.source_no for r in registry.source_registry(config).collect()) == [0, 1, 2]


@pytest.mark.parametrize(
    "content, want",
    [
        ("<rss><channel><item><title>a&nbsp;b & c</title><link>https://h/1?x=1&y=2</link></item></channel></rss>", [(True, "https://h/1?x=1&y=2", "a&nbsp;b & c")]),
        ("<rss><channel><item><title>a</title><link>https://h/1</link></item><item><title>cut o", [(True, "https://h/1", "a"), (False, "u", None)]),
        ("<feed><entry><title>a</title><link href='https://h/1'/></entry><entry><title>b & </title><link href='https://h/2'/></entry><ent", [(True, "https://h/1", "a"), (True, "https://h/2", "b &")]),
        ("no feed & nothing", [(False, "u", None)]),
    ],
)
def test_feeds_as_found_in_the_wild(spark, content, want):
    docs = spark.createDataFrame([(0, "s", "c", "u", content)], "doc_no int, source_name string, category string, source_url string, content string")
    assert [(r.ok, r.url, r.title and r.title.strip()) for r in feeds.parse_feeds(docs).orderBy("pos").collect()] == want


DOC = "doc_no int, source_name string, category string, source_url string, content string"


def test_prefixes_are_resolved_by_their_namespaces(spark):
    atom = """<?xml version="1.0"?><a:feed xmlns:a="http://www.w3.org/2005/Atom" xmlns:d='http://purl.org/dc/elements/1.1/' xmlns:media="http://search.yahoo.com/mrss/">
      <a:title>news</a:title><a:entry><a:title>one &amp; two</a:title><a:link href="https://h/1"/><d:date>2026-08-01</d:date><media:title>no</media:title>
      <a:summary><![CDATA[<b>5 < 6</b> <a:x>]]></a:summary></a:entry></a:feed>"""
    rss1 = """<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="http://purl.org/rss/1.0/" xmlns:c="http://purl.org/rss/1.0/modules/content/">
      <o:channel><o:title>old</o:title></o:channel><o:item><o:title>x</o:title><o:link>https://h/2</o:link><c:encoded>whole</c:encoded></o:item></r:RDF>"""
    docs = spark.createDataFrame([(0, "s", "c", "u", atom), (1, "t", "c", "u", rss1)], DOC)
    rows = feeds.parse_feeds(docs).orderBy("seq").collect()
    assert [(r.ok, r.url, r.title, r.body, r.published_raw, r.feed_title) for r in rows] == [
        (True, "https://h/1", "one & two", "<b>5 < 6</b> <a:x>", "2026-08-01", "news"), (True, "https://h/2", "x", "whole", None, "old"),
    ]


def test_cut_and_broken_entries_are_rows_in_their_place(spark):
    item = lambda n: f"<item><title>t{n}</title><link>https://h/{n}</link></item>"
    cut = f"<rss><channel><title>all &amp; sundry</title>{item(1)}<item><title>odd</b></title></item>{item(2)}<item><title>c</title><link>https://h/3</li"
    cdata = f"<rss><channel><title>t</title>{item(1)}<item><title>x</title><link>https://h/9</link><description><![CDATA[<item> </item> a & b]]></description></item>{item(2)}<item><![CDATA[never ends <item>"
    docs = spark.createDataFrame([(0, "s", "c", "u", cut), (1, "t", "c", "u", cdata)], DOC)
    rows = feeds.parse_feeds(docs).orderBy("seq").collect()
    bad = feeds.CUT_ENTRY
    assert [(r.source_name, r.pos, r.attempted, r.ok, r.url, r.feed_title, r.error) for r in rows] == [
        ("s", 0, 1, True, "https://h/1", "all & sundry", None), ("s", 1, 1, False, "u", None, bad), ("s", 2, 1, True, "https://h/2", "all & sundry", None),
        ("s", 3, 1, False, "u", None, bad), ("t", 0, 1, True, "https://h/1", "t", None), ("t", 1, 1, True, "https://h/9", "t", None),
        ("t", 2, 1, True, "https://h/2", "t", None), ("t", 3, 1, False, "u", None, bad),
    ]
    assert rows[5].body == "<item> </item> a & b"
    assert [r.pos for r in feeds.parse_feeds(docs.where("doc_no = 0"), limit=2).collect()] == [0, 1]


def test_large_feed_over_many_splits_equals_the_whole(spark, tmp_path):
    items = "".join(f"<item><title>t {n} &amp; {n}</title><link>{'' if n % 9 == 4 else f'https://h/{n}'}</link><description>{'word ' * (n % 40)}</description></item>\n" for n in range(600))
    text = f"<rss><channel><title>big &amp; <![CDATA[<old>]]></title><description>{'d' * 70000}</description>\n{items}</channel></rss>"
    (tmp_path / "big.xml").write_text(text, encoding="utf-8")
    docs = spark.createDataFrame([(3, "s", "c", "u", text)], DOC)
    small = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "0"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        large = feeds.read_large_feed(spark, str(tmp_path / "big.xml"), source_name="s", category="c", source_no=3, source_url="u")
        got = sorted(map(tuple, large.collect()), key=lambda r: r[4])
    finally:
        for key in small:
            spark.conf.unset(key)
    whole = feeds.parse_feeds(docs)
    assert large.columns == whole.columns
    assert got == sorted(map(tuple, whole.collect()), key=lambda r: r[4]) and len(got) == 600


def test_documents_fetched_twice_count_once(spark):
    sources = spark.createDataFrame([(0, "a", "https://h.test/f", "AI", None), (1, "b", "https://h.test/f", "AI", None)], "source_no int, source_name string, url string, category string, params map<string,string>")
    old = RSS.replace("https://press.test/2", "https://press.test/old")
    fetched = spark.createDataFrame(
        [("https://h.test/f", old, None, 1), ("https://h.test/f", RSS, None, 2), ("https://h.test/f", None, "HTTP 500", 3), ("https://h.test/f", RSS, None, 2)],
        "url string, content string, error string, fetched_at int",
    ).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    rows = feeds.collect_feeds(sources, fetched, limit=9).collect()
    assert sorted(r.seq for r in rows) == [0, 1, 2, 3, 1 << 32, (1 << 32) + 1, (1 << 32) + 2, (1 << 32) + 3]
    assert "https://press.test/old" not in {r.url for r in rows}


def test_a_page_linked_from_many_lists_is_parsed_once(spark, plan_of, tmp_path):
    names = "source_no int, source_name string, list_url string, base_url string, category string, article_link_selector string, title_selector string, body_selector string, date_selector string"
    sources = spark.createDataFrame([(n, f"s{n}", f"https://h.test/l{n}", None, "IT", "a", "h1", "p", None) for n in range(200)], names)
    lists = [(f"https://h.test/l{n}", '<a href="/hot">x</a><a href="/secret/1">y</a>', None, 1) for n in range(200)]
    details = [("https://h.test/hot", "<h1>old</h1>", None, 1), ("https://h.test/hot", "<h1>hot</h1>", None, 2), ("https://h.test/secret/1", "<h1>no</h1>", None, 1)]
    fetched = spark.createDataFrame(lists + details, "url string, html string, error string, fetched_at int")
    rules = robots.robots_rules(spark.createDataFrame([("https://h.test", 200, "User-agent: *\nDisallow: /secret\nDisallow: /l7\nCrawl-delay: 3")], "origin string, status int, body string"), "agent")
    links = materialize(pages.crawl_links(sources, fetched, rules=rules))
    frontier = materialize(pages.crawl_frontier(links, rules))
    assert [(r.link, r.allowed, r.slot_seconds) for r in frontier.orderBy("link").collect()] == [("https://h.test/hot", True, 0.0), ("https://h.test/secret/1", False, None)]
    found = pages.crawl(sources, fetched, rules=rules, links=links, frontier=frontier)
    rows = found.collect()
    denied_lists = {r.source_name for r in rows if r.attempted == 0}
    assert denied_lists == {"s7"} | {f"s7{n}" for n in range(10)}
    assert len(rows) == 189 * 2 + 11 and len({r.seq for r in rows}) == len(rows)
    assert {(r.ok, r.title, r.error) for r in rows if r.url.endswith("/hot")} == {(True, "hot", None)}
    assert {(r.ok, r.title, r.error) for r in rows if "secret" in r.url} == {(False, None, pages.DENIED % "https://h.test/secret/1")}
    # Markup is parsed in one place, where a page is one row, below the join with the links; that one reads no markup.
    parsed = re.findall(r"ArrowEvalPython.*", plan_of(found))
    assert len({re.sub(r"#\d+", "", line) for line in parsed}) == 1 and "_article_fields" in parsed[0]
    once = F.col("link").isNotNull()
    assert links.where(once).select("link", "title_selector", "body_selector", "date_selector").distinct().count() == 2


def test_robots_groups_as_the_standard_library_reads_them(spark):
    texts = [
        "User-agent: a\nUser-agent: *\nDisallow: /x\n\nUser-agent: bot\nDisallow: /y\nAllow: /y/z",
        "Disallow: /lost\nUser-agent: bot\n\nDisallow: /too\nUser-agent: bot\n# note\nCrawl-delay: 7\nDisallow:",
        "User-agent: BOT # me\nAllow: /a%20b\nDisallow: /a\r\nUser-agent: other\nDisallow: /",
        "User-agent: *\nCrawl-delay: x\nDisallow: /p\nUser-agent: *\nDisallow: /q",
        "User-agent: nobody\nDisallow: /", "", "User-agent: bo\nSitemap: https://h/s\nDisallow: /c+d\nCrawl-delay: 2\nCrawl-delay: 3",
    ]
    paths = ["/", "/x", "/y", "/y/z", "/lost", "/too", "/a%20b", "/a", "/p/1", "/q", "/c+d", "/s"]
    files = spark.createDataFrame([(f"https://h{i}", 200, t) for i, t in enumerate(texts)], "origin string, status int, body string")
    asked = spark.createDataFrame([(f"https://h{i}{p}",) for i in range(len(texts)) for p in paths], "url string")
    got = {r.url: (r.allowed, r.crawl_delay) for r in robots.mark_allowed(asked, robots.robots_rules(files, "My-Bot/1.0")).collect()}
    for i, text in enumerate(texts):
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        for path in paths:
            assert got[f"https://h{i}{path}"][0] == parser.can_fetch("My-Bot/1.0", f"https://h{i}{path}"), (i, path)
    assert [got[f"https://h{i}/"][1] for i in (0, 1, 3, 6)] == [None, 7.0, None, 3.0]

"""Golden values of the scalar functions."""

from urllib.parse import parse_qsl, urlencode, urljoin

import pytest
from pyspark.sql import functions as F

from articleflow.functions import dates, prompts, replies, text, urls
from articleflow.operators.aggregates import format_percent, safe_ratio


def column(spark, values, function, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [row.r for row in rows.select("i", function("v").alias("r")).orderBy("i").collect()]


TEXTS = [
    ("<div>Rain&nbsp;in <i>Lima</i> &lt; 5&nbsp;mm</div><script>track(1)</script>", "Rain in Lima < 5 mm"),
    ("  above\r\n \t\r\n\r\nbelow  it ", "above\n\nbelow it"),
    ("Ｚ９　ﾊﾟ", "Z9 パ"),
    (None, ""),
    ("", ""),
    (" \n ", ""),
    ("&lt;em&gt;hot&lt;/em&gt; &amp;copy;", "hot ©"),
    ("zero​width﻿ and­soft", "zerowidth andsoft"),
    ("a<br/>b</li>c<h2>d</H2>e", "a\nb\nc d\ne"),
    ("x <STYLE type='a'>p{}</style> y", "x y"),
    ("ﬁne①", "fine1"),
]


def test_normalize_text(spark):
    assert column(spark, [t for t, _ in TEXTS], text.normalize_text) == [want for _, want in TEXTS]


def test_normalize_text_is_stable(spark):
    once = column(spark, [t for t, _ in TEXTS], text.normalize_text)
    assert column(spark, once, text.normalize_text) == once


def test_strip_html_native(spark):
    got = column(spark, ["a<br>b<i>c</i><script>x</script>", None, "<p>q</p>"], text.strip_html)
    assert got == ["a\nb c  ", "", " q\n"]


def test_content_hash(spark):
    rows = spark.createDataFrame([("Title", "some  body"), ("TITLE", "some\nbody"), ("Title", "other"), ("Straße", None), ("STRASSE", "")], "t string, b string")
    hashes = [r.h for r in rows.select(text.content_hash("t", "b").alias("h")).collect()]
    assert all(len(h) == 64 for h in hashes)
    assert hashes[0] == hashes[1] != hashes[2]
    assert hashes[3] == hashes[4]


def test_article_hash_agrees_with_single_hash(spark):
    rows = spark.createDataFrame([("<b>T</b>", "a &amp;amp;lt; b")], "t string, b string")
    whole = rows.select(text.normalize_article("t", "b").alias("a")).select("a.*").first()
    assert whole.title == "T"
    again = spark.createDataFrame([(whole.title, whole.body)], "t string, b string")
    assert again.select(text.content_hash("t", "b")).first()[0] == whole.content_hash


@pytest.mark.parametrize(
    "given, want",
    [
        ("authorization: Basic sk-0011223344aa", "authorization: [REDACTED] [REDACTED_API_KEY]"),
        ("use bearer abc.def-1 now", "use Bearer [REDACTED] now"),
        ("spare sk-0011223344aa end", "spare [REDACTED_API_KEY] end"),
        ("Secret=xyz token : q", "Secret=[REDACTED] token=[REDACTED]"),
        ("my hunter22 here", "my [REDACTED_API_KEY] here"),
        ("nothing to hide", "nothing to hide"),
    ],
)
def test_redact(spark, given, want):
    assert column(spark, [given], lambda c: text.redact(c, "hunter22", "abc")) == [want]


def test_blank_and_strip(spark):
    assert column(spark, [None, "", " 　\x1c\n", " x\x85"], text.is_blank) == [True, True, True, False]
    assert column(spark, [" x y\x85"], text.strip) == ["x y"]


def test_shorten_counts_code_points(spark):
    assert column(spark, ["가나다라", "가나", None, "🇰🇷가"], lambda c: text.shorten(c, 2, "…")) == ["가나…", "가나", None, "🇰🇷…"]


def test_http_error(spark):
    rows = spark.createDataFrame([(503, "u", " a\n\n b "), (404, "u", None), (500, "u", "x" * 300)], "s int, u string, b string")
    got = [r[0] for r in rows.select(text.http_error("s", "u", "b")).collect()]
    assert got[0] == "HTTP 503 응답: u | 응답: a b"
    assert got[1] == "HTTP 404 응답: u"
    assert got[2].endswith("x" * 200) and "x" * 201 not in got[2]


URLS = [
    ("http://h/a b", None),
    ("HTTP://News.Example.org:80/Path/?UTM_Campaign=z#top", "http://news.example.org/Path"),
    ("https://h.example/x?gclid=1&z=3&c=2", "https://h.example/x?c=2&z=3"),
    ("http://h.example:443/a", "http://h.example:443/a"),
    ("https://h.example/?flag", "https://h.example/?flag="),
    ("https://h.example/?x=1&&x=1&y=~*", "https://h.example/?x=1&x=1&y=~%2A"),
    ("https://h.example/", "https://h.example/"),
    ("https://h.example", "https://h.example"),
    ("/relative/", "/relative"),
    (None, ""),
    ("   ", ""),
    ("http://[broken", None),
    ("https://h.example/?q=a+b%20c", "https://h.example/?q=a+b+c"),
][1:]


def test_normalize_url(spark):
    assert column(spark, [u for u, _ in URLS], urls.normalize_url) == [want for _, want in URLS]


def test_normalize_url_is_stable(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    twice = pages.select(urls.normalize_url("url").alias("a")).select("a", urls.normalize_url("a").alias("b"))
    assert twice.where(F.col("a") != F.col("b")).count() == 0


def test_tracking_names(spark):
    got = column(spark, ["UTM_x", "Ref", "reference", "id", "_ga"], urls.is_tracking_param)
    assert got == [True, True, False, False, True]


def test_query_params(spark):
    got = column(spark, ["http://h/p?a=1&b&c==x#f=1", "http://h/p"], urls.query_params)
    assert [[tuple(p) for p in params] for params in got] == [[("a", "1"), ("b", ""), ("c", "=x")], []]


def test_origin_and_host(spark):
    assert column(spark, ["HTTPS://A.b:8/c?d"], urls.url_origin) == ["https://A.b:8"]
    assert column(spark, ["https://A.b:8/c?d"], urls.url_host) == ["A.b:8"]


def test_resolve_url(spark):
    rows = spark.createDataFrame([("https://h/a/b", "c"), ("https://h/a/", "/x"), ("https://h", "https://o/y"), ("https://h", None)], "b string, h string")
    assert [r[0] for r in rows.select(urls.resolve_url("b", "h")).collect()] == ["https://h/a/c", "https://h/x", "https://o/y", None]


def test_links_resolve_as_the_standard_library_does(spark):
    bases = ["https://h/a/b", "https://h/a/", "https://h", "http://H.x:80/a/b/c?q=1#f", "https://h/a/../b/./c/", "https://h//x//y", "", "mailto:x", "ftp://h/d/e"]
    hrefs = ["c", "/x", "https://o/y", "../up", "../../../far", "./here", ".", "..", "?only=1", "#frag", "//other/p?q#f", "a//b", "x/./y/../z", "http:same", "tel:1", "", "a b", "é/ü", "?", "x/", " pad", "https://[bad", "/a/./b/../c/.."]
    pairs = [(b, h) for b in bases for h in hrefs]

    def want(base, href):
        try:
            return urljoin(base, href) if href else None
        except ValueError:
            return None

    rows = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(pairs)], "i int, b string, h string").select("i", urls.resolve_url("b", "h").alias("u")).collect()
    got = {r.i: r.u for r in rows}
    wrong = [(b, h, got[i], want(b, h)) for i, (b, h) in enumerate(pairs) if got[i] != want(b, h)]
    assert wrong == []


def test_queries_are_read_and_written_as_the_standard_library_does(spark):
    queries = ["a=1&b=%41%zz+x", "%E2%82%AC=%e2%82%ac&=v&n", "q=a%2Bb&q=%", "a=~*-._!&b=\u4e2d", "x=1=2&&y", "utm_a=1&z=%26&Ref=2&ref_x=3", "b=2&a=1&a=0&B=1"]
    got = column(spark, [f"https://h/p?{q}" for q in queries], urls.normalize_url)
    kept = lambda q: sorted(p for p in parse_qsl(q, keep_blank_values=True) if p[0].lower() not in urls.TRACKING_NAMES and not p[0].lower().startswith("utm_"))
    assert got == [f"https://h/p?{urlencode(kept(q))}" for q in queries]
    asked = column(spark, [f"https://h/p?{q}#f" for q in queries], lambda c: urls.request_url(c, {"a": "new é", "zz": "1"}))
    assert asked == [f"https://h/p?{urlencode(dict(parse_qsl(q, keep_blank_values=True)) | {'a': 'new é', 'zz': '1'})}#f" for q in queries]


@pytest.mark.parametrize(
    "url, params, limit, want",
    [
        ("https://h/s?q=old&k=1", {"q": "새 글", "display": "20"}, 5, "https://h/s?q=%EC%83%88+%EA%B8%80&k=1&display=5"),
        ("https://h/s", {"display": "20"}, 500, "https://h/s?display=100"),
        ("https://h/s", {"display": "20"}, 0, "https://h/s?display=1"),
        ("https://h/s", {"q": "a"}, 5, "https://h/s?q=a"),
        ("https://h/s", {"display": "20"}, None, "https://h/s?display=20"),
    ],
)
def test_request_url(spark, url, params, limit, want):
    assert column(spark, [url], lambda c: urls.request_url(c, params, limit)) == [want]


DATES = [
    ("1999-12-31T23:59:59-01:00", "2000-01-01T00:59:59"),
    ("2024-02-29T00:00:01Z", "2024-02-29T00:00:01"),
    ("Sun, 01 Jan 2023 12:00:00 GMT", "2023-01-01T12:00:00"),
    ("Sat, 02 Mar 2024 01:30:00 -0500", "2024-03-02T06:30:00"),
    ("2021-07-04", "2021-07-04T00:00:00"),
    ("20210704", "2021-07-04T00:00:00"),
    ("2021/07/04", "2021-07-04T00:00:00"),
    ("4 July 2021", "2021-07-04T00:00:00"),
    ("Sunday, July 4, 2021", "2021-07-04T00:00:00"),
    ("Jul 4, 2021", "2021-07-04T00:00:00"),
    ("posted on July 4, 2021 by staff", "2021-07-04T00:00:00"),
    ("posted on Juli 4, 2021 by staff", None),
    ("2021-07-04T10:00:00.125+02:00", "2021-07-04T08:00:00.125000"),
    ("[2021, 7, 4, 10, 5, 6]", "2021-07-04T10:05:06"),
    ("[2021, 0, 4, 10, 5, 6]", None),
    ("[" * 100_000, None),
    ("edition 7: 2021.07.04 8:05 / 2021.07.05 9:00", "2021-07-04T08:05:00"),
    ("seen 2021-7-4T23:10 twice", "2021-07-04T23:10:00"),
    ("seen 2021.7.4", "2021-07-04T00:00:00"),
    ("seen 2021.7.4 25:10", "2021-07-04T00:00:00"),
    ("seen 2021/02/30", None),
    ("whenever", None),
    ("", None),
    (None, None),
]


def test_normalize_date(spark):
    got = column(spark, [d for d, _ in DATES], lambda c: dates.to_iso(dates.normalize_date(c)))
    assert got == [want and want + "+00:00" for _, want in DATES]


def test_day_bounds():
    first, last = dates.day_bounds("2026-08-01", "2026-08-10")
    assert first.isoformat() == "2026-08-01T00:00:00+00:00"
    assert last.isoformat() == "2026-08-11T00:00:00+00:00"
    assert dates.day_bounds(None, None) == (None, None)
    with pytest.raises(ValueError):
        dates.day_bounds("2026-8-x", None)


def test_ratios(spark):
    rows = spark.createDataFrame([(0, 0), (5, 0), (1, 4), (1, 16)], "a long, b long")
    got = rows.select(safe_ratio("a", "b").alias("r")).withColumn("p", format_percent("r")).collect()
    assert [r.r for r in got] == [0.0, 0.0, 0.25, 0.0625]
    assert [r.p for r in got] == ["0.0%", "0.0%", "25.0%", "6.2%"]


GOOD = '{"trends":["t1","t2"],"keywords":"k","implications":[" i ",""],"commonalities_differences":["c"]}'
REPLIES = [
    (GOOD, None),
    (f"```json\n{GOOD}\n```", None),
    (f"```\n{GOOD}```", None),
    (f"Sure {{ here }} is nothing: no. {GOOD}"[30:], None),
    (f"As asked: {GOOD} Bye.", None),
    ("words only", replies.NO_OBJECT),
    ("} turned round {", replies.NO_OBJECT),
    ('{"trends": ["open"', replies.NO_OBJECT),
    ('{"trends": [1} y}', replies.BAD_JSON),
    ('{"a":' * 5000 + "}", replies.BAD_JSON),
    ('[{"trends": 1}, 2]', replies.NOT_AN_OBJECT),
    ("17", replies.NOT_AN_OBJECT),
    ("{}", replies.MISSING_KEYS.format("trends, keywords, implications")),
    ('{"implications":[],"trends":{}}', replies.MISSING_KEYS.format("keywords")),
    ('{"trends":["t"],"keywords":["", " "],"implications":["i"]}', replies.EMPTY_LIST.format("keywords")),
    ('{"trends":["t"],"keywords":["k"],"implications":null}', replies.EMPTY_LIST.format("implications")),
    ('{"trends":5,"keywords":[],"implications":["i"]}', replies.NOT_A_LIST.format("trends")),
    ('{"trends":["t"],"keywords":["k"],"implications":["i"],"commonalities_differences":{"a":1}}', replies.NOT_A_LIST.format("commonalities_differences")),
]


def test_parse_analysis(spark):
    got = column(spark, [r for r, _ in REPLIES] + [None], replies.parse_analysis)
    assert got.pop() is None
    for (_, error), result in zip(REPLIES, got):
        if error is None:
            assert result.error is None
            assert result.trends == ["t1", "t2"] and result.keywords == ["k"] and result.implications == ["i"]
            assert result.commonalities_differences == ["c"]
        else:
            assert result.error == error and result.trends is None and result.commonalities_differences is None


def test_parse_analysis_item_texts(spark):
    reply = '{"trends":[1, 2.5, true, null, "x", [3]],"keywords":["a"],"implications":[false]}'
    result = column(spark, [reply], replies.parse_analysis)[0]
    assert result.trends == ["1", "2.5", "True", "None", "x", "[3]"] and result.implications == ["False"]
    assert result.commonalities_differences == []


def test_parse_analysis_uses_no_python(spark, plan_of):
    plan = plan_of(spark.createDataFrame([("{}",)], "v string").select(replies.parse_analysis("v")))
    assert "Python" not in plan and "Arrow" not in plan


def test_list_codec(spark):
    got = column(spark, ['["가","b"]', "oops", '{"a":1}', None, "", "[]"], replies.decode_list)
    assert got == [["가", "b"], [], [], [], [], []]
    rows = spark.createDataFrame([(["가", 'q"'],)], "v array<string>")
    assert rows.select(replies.encode_list("v")).first()[0] == '["가","q\\""]'


def test_summary_prompt(spark):
    rows = spark.createDataFrame(
        [(1, "t", "s", "c", " body "), (2, None, "", None, "  "), (3, "t", "s", "c", "x" * 4001)],
        "id int, title string, source string, category string, body string",
    )
    got = [r[0] for r in rows.orderBy("id").select(prompts.summary_prompt()).collect()]
    assert got[0].endswith("제목: t\n출처: s\n카테고리: c\n본문:\nbody\n")
    assert "제목: (제목 없음)\n출처: unknown\n카테고리: unknown\n본문:\n(본문 없음" in got[1]
    assert got[2].endswith("x" * 4000 + "\n...(이하 생략)\n")

"""The registered queries once more in plain SQL, on the sample tables, to compare results with."""

# Fixed values, written out once more so that a wrong text in the package is a difference.
ANALYSIS_NO_TEXT = '(요약/본문 없음)'
ANALYSIS_USER = (
    '다음은 분석 대상 뉴스 목록입니다.\n'
    '조건: 기간=%s~%s, 카테고리=%s, 기사 수=%d건\n'
    '\n'
    '%s\n'
    '\n'
    '위 기사들을 종합해 다음을 JSON으로 작성하세요.\n'
    '- trends: 주요 트렌드 3~5개\n'
    '- keywords: 핵심 키워드 5~10개\n'
    '- commonalities_differences: 기사들 간 공통점과 차이점 2~5개\n'
    '- implications: 시사점 3~5개\n'
)
SUMMARY_BODY_CUT = '\n...(이하 생략)'
SUMMARY_NO_BODY = '(본문 없음 - 제목만으로 요약하지 말고 정보 부족을 명시하세요)'
SUMMARY_USER = (
    '다음 뉴스 기사를 한국어 3~5문장으로 요약하세요.\n'
    '기사에 없는 내용은 추가하지 마세요.\n'
    '\n'
    '제목: %s\n'
    '출처: %s\n'
    '카테고리: %s\n'
    '본문:\n'
    '%s\n'
)
EMPTY_LIST = "AI 응답의 '{}'가 비어 있습니다."
NO_OBJECT = 'AI 응답에서 JSON 객체를 찾지 못했습니다.'
NOT_AN_OBJECT = 'AI 응답 JSON의 최상위가 객체가 아닙니다.'
BLANKS = '\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000'
BAD_JSON = 'raw payload가 올바른 JSON이 아닙니다 (raw_id=%d)'
NO_TITLE = "필수 필드 'title'이 비어 있습니다 (raw_id=%d)"
EMPTY_REPLY = '빈 요약'
ITEM_NO_TITLE = '제목을 찾지 못했습니다'
MISSING_FEED = 'HTTP 요청 실패'
DENIED = 'robots.txt가 수집을 허용하지 않습니다: '
CUT_ENTRY = 'RSS 항목 처리 실패: 항목이 온전하지 않습니다'
NO_LINK = 'RSS 항목 처리 실패: 항목에 link가 없습니다'

ISO = "'%Y-%m-%dT%H:%M:%S+00:00'"

LABELS = "lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)"
CLEAN = f"""{LABELS}, clean AS (
  SELECT d.doc_id AS id, d.doc_id AS raw_id, split_part(text, chr(10), 1) AS title,
         CASE WHEN d.doc_id % 11 <> 0 THEN text END AS body,
         'https://' || source || '.example.com/' || lang || '/' || d.doc_id AS url,
         source, lang AS category,
         CASE WHEN d.doc_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((d.doc_id % 30)::INT) END AS published_at,
         TIMESTAMP '2024-01-15' + to_days((d.doc_id % 20)::INT) AS collected_at,
         CASE WHEN quality = 1 THEN substr(text, 1, 120) END AS summary,
         CASE WHEN quality = 1 THEN 'sample-model' END AS summary_model,
         CASE WHEN quality = 1 THEN TIMESTAMP '2024-02-05' + to_days((d.doc_id % 3)::INT) END AS summarized_at,
         CASE WHEN d.doc_id % 11 <> 0 THEN length(text) ELSE 0 END AS original_length,
         CASE WHEN quality = 1 THEN length(substr(text, 1, 120)) END AS summary_length,
         CASE WHEN d.doc_id % 11 <> 0 THEN 'ok' ELSE 'no_body' END AS clean_status
  FROM documents d LEFT JOIN lab USING (doc_id)), art AS (
  SELECT *, coalesce(published_at, collected_at) AS eff FROM clean)"""
IN_RANGE = "eff >= TIMESTAMP '2024-01-05' AND eff < TIMESTAMP '2024-01-26'"


def present(column: str) -> str:
    return f"(coalesce(trim({column}, '{BLANKS}'), '') <> '')"


def some(column: str) -> str:
    return f"({column} IS NOT NULL AND trim({column}, ' ') <> '')"


LIST = f"""id, CASE WHEN {present('summary')} THEN '요약O' ELSE '요약X' END AS marker,
  strftime(eff, '%Y-%m-%d') AS day, category, source, title"""
QUALITY = f"""count(*) AS clean_count, count(*) FILTER ({present('body')}) AS body_count,
  count(*) FILTER ({present('summary')}) AS summarized_count"""
RATES = """clean_count::DOUBLE / raw_count AS clean_rate,
  CASE WHEN clean_count = 0 THEN 0.0 ELSE body_count::DOUBLE / clean_count END AS body_rate,
  CASE WHEN clean_count = 0 THEN 0.0 ELSE summarized_count::DOUBLE / clean_count END AS summary_rate"""


def folded(column: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"translate(coalesce({column}, ''), '{upper}', '{upper.lower()}')"


def listing(where: str = "true", tail: str = "") -> str:
    return f"WITH {CLEAN} SELECT {LIST} FROM art WHERE {where} {tail}"


def squeezed(text: str) -> str:
    """Collapsed blanks, trimmed lines, at most one blank line in a row (for text without entities and tags)."""
    one = rf"regexp_replace({text}, '[ \t]+', ' ', 'g')"
    lines = rf"regexp_replace({one}, ' *\n *', chr(10), 'g')"
    return rf"trim(regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


def without_tags(html: str) -> str:
    blocks = rf"regexp_replace({html}, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g')"
    breaks = rf"regexp_replace({blocks}, '(?i)<(br\s*/?|/p|/div|/li|/h[1-6])>', chr(10), 'g')"
    return rf"regexp_replace({breaks}, '(?s)<[^>]+>', ' ', 'g')"


def unescaped(html: str) -> str:
    """The entities of the sample pages; HTML reads these names without their semicolon too (cut-off titles end so)."""
    for name, mark in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        html = f"regexp_replace({html}, '&{name};?', '{mark}', 'g')"
    return html


HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"
_KEPT = f"""list_sort(list_filter(string_split({_QUERY}, '&'),
  lambda p: p <> '' AND split_part(p, '=', 1) <> 'ref' AND NOT starts_with(p, 'utm_')))"""
CANONICAL = f"""(rtrim(regexp_extract(url, '^[^?#]*'), '/') ||
  CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END)"""
H1 = unescaped("trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1))")

# Fetched events as raw rows.
EVENTS = f"""rows AS (
  SELECT event_id AS seq, 's' || (user_id % 8) AS source_name, event_type AS kind,
         'https://s' || (user_id % 8) || '.example.com/item/' || (props::JSON ->> '$.k') || '/' || event_type AS canonical_url,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'partial' ELSE 'ok' END AS status,
         event_id + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END * (1::BIGINT << 61) AS place,
         CASE WHEN event_type = 'error' THEN json_object('url', canonical_url, 'error', 'HTTP 503') ELSE
           json_object('source', source_name, 'url', canonical_url, 'title', CASE WHEN event_type = 'signup' THEN '' ELSE event_type END, 'body', props::VARCHAR,
             'published_at', strftime(ts, '%Y-%m-%d'), 'category', 'events', 'external_id', event_id::VARCHAR) END::VARCHAR AS raw_payload
  FROM events), incoming AS (
  SELECT *, row_number() OVER (PARTITION BY source_name, canonical_url ORDER BY place) AS nth FROM rows
  WHERE kind <> 'purchase'), fresh AS (
  SELECT * FROM incoming i WHERE nth = 1 AND NOT EXISTS (
    SELECT 1 FROM rows e WHERE e.kind = 'purchase' AND e.source_name = i.source_name AND e.canonical_url = i.canonical_url))"""
FETCH_STATS = f"""{EVENTS}, seen AS (
  SELECT source_name, count(*) AS attempted_count, count(*) FILTER (status = 'error') AS failure_count,
         count(*) FILTER (status <> 'error') AS items FROM incoming GROUP BY source_name), stored AS (
  SELECT source_name, count(*) AS n FROM fresh WHERE status <> 'error' GROUP BY source_name), stats AS (
  SELECT source_name, 'rss' AS collection_method, attempted_count, coalesce(n, 0) AS success_count, failure_count,
         items - coalesce(n, 0) AS duplicate_count FROM seen LEFT JOIN stored USING (source_name))"""

# The merge of all documents into the labelled ones.
SHARED = "'https://example.com/' || lang || '/' || md5(text)"
MERGE = f"""{LABELS}, batch AS (
  SELECT doc_id AS raw_id, split_part(text, chr(10), 1) AS title, text AS body, {SHARED} AS url, source, lang AS category,
         TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INT) AS published_at, TIMESTAMP '2024-01-15' + to_days((doc_id % 20)::INT) AS collected_at,
         md5(text) AS content_hash, 'ok' AS clean_status, length(text) AS original_length FROM documents), old AS (
  SELECT doc_id AS id, doc_id AS raw_id, 'stored' AS title, 'old ' || text AS body,
         CASE WHEN toxic = 1 THEN 'https://example.com/old/' || doc_id ELSE {SHARED} END AS url, 'archive' AS source,
         lang AS category, NULL::TIMESTAMP AS published_at, TIMESTAMP '2023-12-01' + to_days((doc_id % 20)::INT) AS collected_at,
         NULL::VARCHAR AS content_hash, 'ok' AS clean_status, length(text) + 4 AS original_length, CASE WHEN quality = 1 THEN 'kept summary' END AS summary,
         CASE WHEN quality = 1 THEN 'sample-model' END AS summary_model, CASE WHEN quality = 1 THEN 12 END AS summary_length
  FROM documents JOIN lab USING (doc_id)), target AS (
  SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1)"""
SKIPPED = f"""{MERGE}, unseen AS (
  SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.raw_id = b.raw_id)), firsts AS (
  SELECT * FROM unseen QUALIFY row_number() OVER (PARTITION BY url ORDER BY raw_id) = 1), fresh AS (
  SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.url = f.url))"""
UPSERT = f"""{MERGE}, hits AS (
  SELECT b.raw_id, b.url, r.id AS m1, u.id AS m2 FROM batch b
  LEFT JOIN target r ON r.raw_id = b.raw_id LEFT JOIN target u ON u.url = b.url), groups AS (
  SELECT url, count(*) AS n, min(raw_id) AS first_raw, max(raw_id) AS last_raw, max(m2) AS m2,
         least(min(m1), min(m2)) AS low, greatest(max(m1), max(m2)) AS high,
         min(raw_id) FILTER (m1 IS NOT NULL OR m2 IS NOT NULL) AS first_match FROM hits GROUP BY url), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY CASE WHEN low = high THEN low ELSE -1 - last_raw END ORDER BY first_match) AS nth
  FROM groups), decided AS (
  SELECT url, n, first_raw, last_raw,
         CASE WHEN low <> high OR (low IS NOT NULL AND nth = 1 AND m2 IS NULL AND first_match > first_raw) THEN 'conflict'
              WHEN low IS NOT NULL AND nth = 1 THEN 'update' ELSE 'insert' END AS action, low FROM ranked)"""
CONTENT = ("raw_id", "title", "body", "url", "source", "category", "published_at", "collected_at", "content_hash", "clean_status", "original_length")


def merged(alias: str, summaries: str, pick: str = "{0}.{1}") -> str:
    """The fifteen columns beside the id, moments as text."""
    picked = [(c, pick.format(alias, c)) for c in CONTENT]
    shown = [f"strftime({v}, {ISO}) AS {c}" if c.endswith("_at") else f"{v} AS {c}" for c, v in picked]
    return ", ".join(shown) + f", {summaries}"


KEPT_SUMMARY = "t.summary, t.summary_model, NULL::VARCHAR AS summarized_at, t.summary_length"
NO_SUMMARY = "NULL, NULL, NULL, NULL"

# Analysis requests.
BLOCKS = """numbered AS (
  SELECT *, row_number() OVER ({part} ORDER BY eff DESC, id DESC) AS number FROM art WHERE {where}), blocks AS (
  SELECT category, number, id, '[' || number || '] 제목: ' || coalesce(nullif(title, ''), '(제목 없음)') || chr(10) ||
    '    출처: ' || source || ' | 카테고리: ' || category || ' | 일자: ' || strftime(eff, '%Y-%m-%d') || chr(10) || '    내용: ' ||
    coalesce(nullif(trim(summary, '{blanks}'), ''),
      CASE WHEN length(trim(body, '{blanks}')) > 800 THEN substr(trim(body, '{blanks}'), 1, 800) || '…'
           ELSE nullif(trim(body, '{blanks}'), '') END, '{none}') AS block
  FROM numbered WHERE number <= 50), summed AS (
  SELECT *, sum(length(block)) OVER ({part} ORDER BY number)::BIGINT AS running_length FROM blocks)"""


def blocks(part: str, where: str = "true") -> str:
    return BLOCKS.format(part=part, where=where, blanks=BLANKS, none=ANALYSIS_NO_TEXT)


def filled_in(template: str, *values: str) -> str:
    """A prompt template as a SQL concatenation."""
    pieces = template.replace("%d", "%s").split("%s")
    parts = ["'" + pieces[0].replace("'", "''") + "'"]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value, "'" + piece.replace("'", "''") + "'"]
    return "(" + " || ".join(parts) + ")"


PROMPT_BODY = f"""CASE WHEN NOT {present('body')} THEN '{SUMMARY_NO_BODY}'
  WHEN length(trim(body, '{BLANKS}')) > 4000 THEN substr(trim(body, '{BLANKS}'), 1, 4000) || '{SUMMARY_BODY_CUT}'
  ELSE trim(body, '{BLANKS}') END"""
RUNS = f"""{CLEAN}, runs AS (
  SELECT max(id) AS id, strftime(published_at, '%Y-%m-%d') AS date_from, category, count(*) AS article_count
  FROM art WHERE published_at IS NOT NULL GROUP BY 2, 3)"""
EXPORT = f"""id, title, url, source, category, strftime(published_at, {ISO}) AS published_at,
  strftime(collected_at, {ISO}) AS collected_at, clean_status, summary, summary_model,
  strftime(summarized_at, {ISO}) AS summarized_at, original_length, summary_length, NULL::VARCHAR AS content_hash, body"""
OUTCOMES = f"""answered AS (
  SELECT id, CASE WHEN NOT {present('body')} THEN 'no body'
                  WHEN title <> '' AND NOT {present('title')} THEN '{EMPTY_REPLY}' END AS error,
         trim(coalesce(nullif(title, ''), '(제목 없음)'), '{BLANKS}') AS answer, coalesce(length(body), 0) AS original_length
  FROM art WHERE NOT {some('summary')})"""
NAV_LINKS = f"""found AS (
  SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS place FROM (
    SELECT page_id, url, regexp_extract_all({unescaped("regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)")}, '<a href="([^"]*)"', 1) AS hrefs
    FROM pages)), links AS (
  SELECT page_id, {ORIGIN} || href AS link, row_number() OVER (PARTITION BY page_id ORDER BY min(place)) - 1 AS pos
  FROM found WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:)') GROUP BY page_id, url, href)"""
ROBOTS = f"""marked AS (
  SELECT page_id, {ORIGIN} AS origin, url LIKE '%://m.%' AS free, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS path FROM pages), allowed AS (
  SELECT page_id, origin, free OR starts_with(path, '/en/9') OR NOT (starts_with(path, '/en/') OR starts_with(path, '/es')) AS allowed,
         CASE WHEN NOT free THEN (length(origin) % 4)::DOUBLE END AS crawl_delay FROM marked)"""
TURNS = """turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
         'https://talk.example.com/' || conv_id || '/' || turn || '?utm_source=feed' AS link,
         trim(text, E' \\n\\t') AS body FROM conversations)"""
TRIMMED = f"list_filter(list_transform({{}}, lambda w: trim(w, '{BLANKS}')), lambda w: w <> '')"

SQL: dict[str, str] = {
    "report_metrics": f"""WITH {CLEAN}, m AS (SELECT {QUALITY}, (SELECT count(*) FROM documents) AS raw_count FROM art WHERE {IN_RANGE})
        SELECT *, {RATES} FROM m""",
    "report_metrics_by_category": f"""WITH {CLEAN}, m AS (
        SELECT category, {QUALITY}, (SELECT count(*) FROM documents) AS raw_count FROM art GROUP BY category) SELECT *, {RATES} FROM m""",
    "report_cube": f"""WITH {CLEAN} SELECT category, source, collected_at::DATE AS day, {QUALITY} FROM art GROUP BY 1, 2, 3""",
    "report_with_analysis": f"""WITH {RUNS} SELECT (SELECT count(*) FROM art WHERE category = 'fr') AS clean_count,
        (SELECT count(*) FROM documents) AS raw_count, id AS run_id, category || ', ' || date_from AS keywords
        FROM runs WHERE category = 'fr' ORDER BY id DESC LIMIT 1""",
    "category_counts": "SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, category",
    "source_counts": f"WITH {CLEAN} SELECT source, count(*) AS n FROM art WHERE {IN_RANGE} GROUP BY 1 ORDER BY n DESC, source",
    "top_sources": """SELECT row_number() OVER (ORDER BY n DESC, source) AS place, * FROM (
        SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5)""",
    "top_categories": """SELECT row_number() OVER (ORDER BY n DESC, category) AS place, * FROM (
        SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, category LIMIT 3)""",
    "daily_counts": f"WITH {CLEAN} SELECT collected_at::DATE AS day, count(*) AS n FROM art GROUP BY 1",
    "daily_event_counts": "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1",
    "raw_count": "SELECT count(*) AS raw_count FROM documents",
    "clean_count": f"WITH {CLEAN} SELECT count(*) AS n FROM art WHERE {some('summary')} AND {IN_RANGE}",
    "analysis_run_count": f"WITH {RUNS} SELECT count(*) AS runs FROM runs",
    "filter_dates": listing(IN_RANGE),
    "filter_instants": listing("eff >= TIMESTAMP '2024-01-05' AND eff <= TIMESTAMP '2024-01-25'"),
    "filter_category_source": listing("category = 'en' AND source = 'src1'"),
    "filter_summarized": listing(some("summary")),
    "filter_unsummarized": listing(f"NOT {some('summary')}"),
    "filter_require_body": listing(some("body")),
    "filter_keyword": listing(f"{folded('title')} LIKE '%the%' OR {folded('body')} LIKE '%the%'"),
    "filter_keyword_wildcard": listing(f"{folded('title')} LIKE '%e_e%ti%' OR {folded('body')} LIKE '%e_e%ti%'"),
    "filter_combined": listing(
        f"category = 'en' AND NOT {some('summary')} AND {some('body')} AND {IN_RANGE}"
        f" AND ({folded('title')} LIKE '%the%' OR {folded('body')} LIKE '%the%')"
    ),
    "list_page": listing("category = 'en'", "ORDER BY eff DESC, id DESC LIMIT 20 OFFSET 40"),
    "list_page_after": listing("(eff, id) < (TIMESTAMP '2024-01-20', 500)", "ORDER BY eff DESC, id DESC LIMIT 20"),
    "page_count": "SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM documents WHERE lang = 'en'",
    "article_details": "",
    "article_by_id": "",
    "raw_scan": """SELECT doc_id AS id, source AS source_name, 'https://example.com/' || lang || '/' || doc_id AS canonical_url,
        'ok' AS status FROM documents WHERE doc_id % 23 <> 0""",
    "dedup_raw_first_wins": f"""SELECT min(page_id) AS seq, {HOST} AS source_name, {CANONICAL} AS canonical_url FROM pages GROUP BY 2, 3""",
    "raw_new_only": f"""WITH p AS (SELECT page_id, url, {HOST} AS source_name, {CANONICAL} AS canonical_url FROM pages)
        SELECT min(page_id) AS seq, source_name, canonical_url FROM p WHERE url LIKE 'https:%' AND NOT EXISTS (
          SELECT 1 FROM p e WHERE e.url NOT LIKE 'https:%' AND e.source_name = p.source_name AND e.canonical_url = p.canonical_url)
        GROUP BY 2, 3""",
    "raw_inserts": f"""WITH {EVENTS} SELECT (SELECT max(seq) + 1 FROM rows WHERE kind = 'purchase') + row_number() OVER (ORDER BY place) AS id,
        source_name, canonical_url, status,
        CASE status WHEN 'error' THEN 'HTTP 503' WHEN 'partial' THEN '{ITEM_NO_TITLE}' END AS error_message,
        CASE WHEN status <> 'error' THEN seq::VARCHAR END AS external_id, raw_payload FROM fresh""",
    "fetch_run_stats": f"WITH {FETCH_STATS} SELECT * FROM stats",
    "recent_runs": f"""WITH {FETCH_STATS} SELECT row_number() OVER (ORDER BY source_name) AS id, source_name, attempted_count,
        success_count, failure_count, duplicate_count FROM stats ORDER BY id DESC LIMIT 3""",
    "feed_items": f"""WITH {TURNS} SELECT 'talk-' || conv_id AS source_name, pos::INT AS pos, conv_id * 4294967296 + pos AS seq, turn <> 2 AS ok,
        CASE WHEN turn <> 2 THEN link ELSE 'https://talk.example.com/feed/' || conv_id END AS url,
        CASE WHEN turn <> 2 THEN role END AS title, CASE WHEN turn <> 2 THEN nullif(body, '') END AS body,
        CASE WHEN turn <> 2 THEN 'Mon, 01 Jan 2024 0' || turn || ':00:00 +0900' END AS published_raw,
        CASE WHEN turn <> 2 THEN link END AS external_id, CASE WHEN turn <> 2 THEN 'talk ' || conv_id END AS feed_title,
        CASE WHEN turn = 2 THEN '{NO_LINK}' END AS error FROM turns""",
    "feed_items_limited": f"""WITH {TURNS} SELECT turn <> 2 AS ok, count(*) AS attempted, count(*) FILTER (turn = 2) AS errors
        FROM turns WHERE pos < 2 GROUP BY 1""",
    "feed_collect": f"""WITH {TURNS}, docs AS (
          SELECT conv_id, max(turn) >= 5 AS gone, 'https://talk.example.com/feed/' || conv_id AS feed FROM conversations GROUP BY conv_id)
        SELECT 'talk-' || conv_id AS source_name, 1 AS attempted, turn <> 2 AS ok, CASE WHEN turn <> 2 THEN link ELSE feed END AS url,
               CASE WHEN turn = 2 THEN '{NO_LINK}' END AS error FROM turns JOIN docs USING (conv_id) WHERE NOT gone
        UNION ALL SELECT 'talk-' || conv_id, 0, false, feed || '?display=30&q=talk', '{MISSING_FEED}' FROM docs WHERE gone""",
    "registry_match": f"""SELECT page_id, {HOST} AS source_name, CASE WHEN {HOST} NOT LIKE 'blog.%' THEN 'news' END AS category,
        CASE WHEN {HOST} LIKE 'blog.%' THEN 'unknown source' WHEN {HOST} LIKE 'www.%' THEN 'source is of type rss' END AS problem FROM pages""",
    "source_registry": """WITH c AS (SELECT *, 'c' || c_custkey AS name, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'rss'
          WHEN c_mktsegment = 'MACHINERY' THEN 'ftp' ELSE 'web' END AS type FROM customer)
        SELECT name AS source_name, type, CASE WHEN c_nationkey > 12 THEN c_mktsegment ELSE 'unknown' END AS category,
          CASE WHEN c_acctbal < 0 THEN 'REPLACE_WITH_URL' ELSE 'https://example.com/' || name END AS url,
          CASE WHEN type = 'ftp' THEN 'unknown type ftp' WHEN type = 'rss' AND c_acctbal < 0 THEN 'url is empty or a placeholder'
               WHEN type = 'web' AND c_acctbal > 9000 THEN 'body_selector is empty or a placeholder' END AS problem FROM c""",
    "article_titles": f"""SELECT page_id, {H1} AS title, {unescaped("trim(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1))")} AS body FROM pages""",
    "extract_links_all": f"WITH {NAV_LINKS} SELECT page_id, pos::INT AS pos, link FROM links",
    "extract_links_limited": f"WITH {NAV_LINKS} SELECT page_id, pos::INT AS pos, link FROM links WHERE pos < 3",
    "strip_html_pages": f"SELECT page_id, {without_tags('html')} AS text FROM pages",
    "normalized_pages": f"SELECT page_id, {squeezed(without_tags(unescaped('html')))} AS text FROM pages",
    "normalized_documents": f"SELECT doc_id, {squeezed('text')} AS text FROM documents",
    "normalized_urls": f"SELECT page_id, url, {CANONICAL} AS canonical_url FROM pages",
    "tracking_params": f"""SELECT name, count(*) AS n, name = 'ref' OR starts_with(name, 'utm_') AS tracking FROM (
        SELECT split_part(unnest(string_split({_QUERY}, '&')), '=', 1) AS name FROM pages) WHERE name <> '' GROUP BY name""",
    "request_urls": f"""SELECT page_id, regexp_extract(url, '^[^?#]*') || '?' ||
        CASE WHEN {_QUERY} = '' THEN 'display=100&page=a+b'
             WHEN regexp_matches({_QUERY}, '(^|&)page=') THEN regexp_replace({_QUERY}, '(^|&)page=[^&]*', '\\1page=a+b') || '&display=100'
             ELSE {_QUERY} || '&display=100&page=a+b' END || regexp_extract(url, '#.*$') AS request FROM pages""",
    "robots_allowed": f"WITH {ROBOTS} SELECT * FROM allowed",
    "fetch_slots": f"""WITH {ROBOTS} SELECT page_id, origin, (row_number() OVER (PARTITION BY origin ORDER BY page_id) - 1)
        * greatest(1.0, coalesce(crawl_delay, 0.0)) AS slot_seconds FROM allowed WHERE allowed""",
    "fetch_errors": r"""SELECT page_id, 'HTTP 503 응답: ' || url || ' | 응답: ' || substr(trim(regexp_replace(html, '\s+', ' ', 'g')), 1, 200) AS message
        FROM pages""",
    "normalized_dates": f"""SELECT o_orderkey, strftime(CASE o_orderpriority WHEN '2-HIGH' THEN o_orderdate - INTERVAL 9 HOUR
          WHEN '3-MEDIUM' THEN date_trunc('minute', o_orderdate) WHEN '4-NOT SPECIFIED' THEN o_orderdate + INTERVAL 150 MINUTE
          ELSE date_trunc('day', o_orderdate) END, {ISO}) AS moment FROM orders""",
    "merge_skip": f"""WITH {SKIPPED} SELECT t.id, {merged('t', KEPT_SUMMARY)} FROM target t UNION ALL
        SELECT (SELECT max(id) FROM target) + row_number() OVER (ORDER BY raw_id), {merged('f', NO_SUMMARY)} FROM fresh f""",
    "merge_decisions": f"""WITH {UPSERT} SELECT url, n, first_raw, last_raw, action, CASE WHEN action = 'update' THEN low END AS target_id FROM decided""",
    "merge_upsert": f"""WITH {UPSERT}, changed AS (
          SELECT d.low AS id, b.* FROM decided d JOIN batch b ON b.raw_id = d.last_raw WHERE d.action = 'update')
        SELECT t.id, {merged('c', KEPT_SUMMARY, 'CASE WHEN c.id IS NULL THEN t.{1} ELSE {0}.{1} END')} FROM target t LEFT JOIN changed c ON c.id = t.id
        UNION ALL SELECT (SELECT max(id) FROM target) + row_number() OVER (ORDER BY first_raw), {merged('b', NO_SUMMARY)}
        FROM decided d JOIN batch b ON b.raw_id = d.last_raw WHERE d.action = 'insert'""",
    "merge_stats": f"""SELECT *, 0::BIGINT AS updated, total - inserted AS skipped, 0::BIGINT AS conflicts, 'skip' AS policy FROM (
        WITH {SKIPPED} SELECT (SELECT count(*) FROM fresh) AS inserted, (SELECT count(*) FROM batch) AS total)""",
    "orphans": """SELECT doc_id AS id, 'https://' || source || '.example.com/' || lang || '/' || doc_id AS url FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "raw_status_update": f"""WITH {LABELS} SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'invalid' WHEN doc_id % 23 = 0 THEN 'partial' ELSE 'ok' END AS status,
        CASE WHEN toxic = 1 THEN 'toxic' END AS error_message FROM documents LEFT JOIN lab USING (doc_id)""",
    "summary_update": f"""WITH {CLEAN}, new AS (SELECT doc_id AS id, text AS s, n_chars FROM documents JOIN lab USING (doc_id) WHERE quality = 0)
        SELECT id, coalesce(s, summary) AS summary, CASE WHEN s IS NOT NULL THEN 'm2' ELSE summary_model END AS summary_model,
          CASE WHEN s IS NOT NULL THEN length(s) ELSE summary_length END AS summary_length,
          CASE WHEN s IS NOT NULL THEN n_chars ELSE original_length END AS original_length,
          strftime(CASE WHEN s IS NOT NULL THEN TIMESTAMP '2024-03-01' ELSE summarized_at END, {ISO}) AS summarized_at
        FROM art LEFT JOIN new USING (id)""",
    "duplicate_content_groups": f"""SELECT count(*) AS copies, min(doc_id) AS first_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
        FROM documents GROUP BY lang, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) HAVING count(*) > 1""",
    "redacted_documents": r"""SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
          '\b(authorization)\s*[:=]\s*\S+', '\1: [REDACTED]', 'gi'), '\bbearer\s+[A-Za-z0-9._\-]+', 'Bearer [REDACTED]', 'gi'),
          '\bsk-[A-Za-z0-9._\-]{8,}', '[REDACTED_API_KEY]', 'g'), '\b(api[_-]?key|ai_api_key|token|secret)\s*[:=]\s*\S+', '\1=[REDACTED]', 'gi'),
          'the-known-secret', '[REDACTED_API_KEY]') AS text FROM documents""",
    "analysis_blocks": f"""WITH {CLEAN}, {blocks('PARTITION BY category')} SELECT category, number::INT AS number, id, block, running_length
        FROM summed WHERE running_length <= 20000 OR number = 1""",
    "analysis_prompts": f"""WITH {CLEAN}, {blocks('PARTITION BY category')} SELECT category, count(*) AS article_count,
        {filled_in(ANALYSIS_USER, "'전체'", "'전체'", "category", "count(*)", "string_agg(block, chr(10) || chr(10) ORDER BY number)")} AS prompt
        FROM summed WHERE running_length <= 5000 OR number = 1 GROUP BY category""",
    "analysis_prompt_all": f"""WITH {CLEAN}, {blocks('', IN_RANGE)} SELECT count(*) AS article_count,
        {filled_in(ANALYSIS_USER, "'2024-01-05'", "'2024-01-25'", "'전체'", "count(*)", "string_agg(block, chr(10) || chr(10) ORDER BY number)")} AS prompt
        FROM summed WHERE running_length <= 20000 OR number = 1""",
    "summary_prompts": f"""WITH {CLEAN} SELECT id, {filled_in(SUMMARY_USER, "coalesce(nullif(title, ''), '(제목 없음)')", "source", "category", f"({PROMPT_BODY})")} AS prompt
        FROM art WHERE NOT {some('summary')}""",
    "summaries": f"""WITH {CLEAN}, {OUTCOMES} SELECT id, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'failed' END AS outcome,
        CASE WHEN error IS NULL THEN answer END AS reply, error, original_length FROM answered""",
    "summarize_stats": f"""WITH {CLEAN}, {OUTCOMES} SELECT count(*) AS attempted, count(*) FILTER (error IS NULL) AS succeeded,
        count(error) AS failed, 0::BIGINT AS skipped FROM answered""",
    "parsed_analysis": f"""WITH l AS (
          SELECT conv_id, turn, {TRIMMED.format('string_split(text, chr(10))')} AS t, {TRIMMED.format("string_split(text, ' ')")} AS k,
                 CASE WHEN turn = 5 THEN [] ELSE {TRIMMED.format('[text]')} END AS i FROM conversations), checked AS (
          SELECT *, CASE WHEN turn = 3 THEN '{NO_OBJECT}' WHEN turn = 4 THEN '{NOT_AN_OBJECT}'
            WHEN len(t) = 0 THEN '{EMPTY_LIST.format("trends").replace("'", "''")}' WHEN len(k) = 0 THEN '{EMPTY_LIST.format("keywords").replace("'", "''")}'
            WHEN len(i) = 0 THEN '{EMPTY_LIST.format("implications").replace("'", "''")}' END AS error FROM l)
        SELECT conv_id, turn, CASE WHEN error IS NULL THEN array_to_string(t, '|') END AS trends,
          CASE WHEN error IS NULL THEN array_to_string(k, '|') END AS keywords,
          CASE WHEN error IS NULL THEN array_to_string(i, '|') END AS implications, error FROM checked""",
    "latest_analysis": f"""WITH {RUNS} SELECT *, NOT (date_from = '2024-01-07' AND category = 'en') AS is_fallback FROM runs
        ORDER BY is_fallback, id DESC LIMIT 1""",
    "latest_analysis_fallback": f"WITH {RUNS} SELECT *, true AS is_fallback FROM runs ORDER BY id DESC LIMIT 1",
    "latest_analysis_by_category": f"""WITH {RUNS} SELECT category, id, date_from, article_count FROM runs
        QUALIFY row_number() OVER (PARTITION BY category ORDER BY id DESC) = 1""",
    "run_lists_round_trip": f"""WITH {RUNS} SELECT id, '["' || category || '","' || date_from || '"]' AS keywords_json,
        category || ', ' || date_from AS keywords, 0::BIGINT AS from_text FROM runs""",
    "export_rows": f"WITH {CLEAN} SELECT {EXPORT} FROM art",
    "export_csv": f"""WITH {CLEAN}, e AS (SELECT {EXPORT} FROM art WHERE {some('summary')}) SELECT id::VARCHAR AS id, nullif(title, '') AS title, url, source,
        category, published_at, collected_at, clean_status, summary, summary_model, summarized_at, original_length::VARCHAR AS original_length,
        summary_length::VARCHAR AS summary_length, content_hash, body FROM e""",
    "export_jsonl": f"WITH {CLEAN} SELECT {EXPORT} FROM art WHERE NOT {some('summary')}",
    "stream_daily_trend": "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1",
}

# Article paragraphs: "<p><b>" is left open and so holds all text up to the end of the article.
_TEXT = f"""array_to_string(list_filter(list_transform(regexp_split_to_array({{}}, '<[^>]+>'),
  lambda t: {unescaped("trim(t, ' ' || chr(10))")}), lambda t: t <> ''), ' ')"""
_PARAGRAPH = "CASE WHEN starts_with(segs[i], '<b>') THEN array_to_string(segs[i:], '<p>') ELSE split_part(segs[i], '</p>', 1) END"
ARTICLES = f"""split AS (
  SELECT page_id, url, html, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>') AS segs FROM pages), articles AS (
  SELECT page_id, url, {H1} AS title, nullif(array_to_string(list_filter(list_transform(range(2, len(segs) + 1),
    lambda i: {_TEXT.format(_PARAGRAPH)}), lambda t: t <> ''), chr(10) || chr(10)), '') AS body FROM split)"""
SQL["extract_articles"] = f"WITH {ARTICLES} SELECT page_id, title, body, NULL::VARCHAR AS published_raw FROM articles"
SQL["raw_from_pages"] = f"""WITH {ARTICLES}, keyed AS (
    SELECT page_id AS seq, {HOST} AS source_name, {CANONICAL} AS canonical_url, url, title, body FROM articles)
  SELECT seq, source_name, canonical_url, json_object('source', source_name, 'url', url, 'title', title, 'body', body,
      'published_at', NULL, 'category', 'web', 'external_id', url)::VARCHAR AS raw_payload,
    CASE WHEN title = '' THEN 'partial' ELSE 'ok' END AS status, CASE WHEN title = '' THEN '{ITEM_NO_TITLE}' END AS error_message
  FROM keyed QUALIFY row_number() OVER (PARTITION BY source_name, canonical_url ORDER BY seq) = 1"""

_DETAIL = f"""id, title, url, source, category, coalesce(strftime(published_at, {ISO}), '-') AS published,
  strftime(collected_at, {ISO}) AS collected, clean_status, coalesce(summary_model, '-') AS summary_model,
  coalesce(summary_length, 0) AS summary_length, coalesce(nullif(summary, ''), '(요약 없음)') AS summary,
  CASE WHEN body IS NULL OR body = '' THEN '(본문 없음)' WHEN length(body) > 2000 THEN substr(body, 1, 2000) || chr(10) || '...(생략)'
       ELSE body END AS body_preview"""
SQL["article_details"] = f"WITH {CLEAN} SELECT {_DETAIL} FROM art"
SQL["article_by_id"] = f"WITH {CLEAN} SELECT {_DETAIL} FROM art WHERE id = 42"

SQL["merge_stats"] = f"""WITH {SKIPPED}, s AS (SELECT (SELECT count(*) FROM fresh) AS inserted, (SELECT count(*) FROM batch) AS total)
  SELECT inserted, 0::BIGINT AS updated, total - inserted AS skipped, 0::BIGINT AS conflicts, 'skip' AS policy FROM s
  UNION ALL SELECT * FROM (WITH {UPSERT.replace('WITH ', '')} SELECT count(*) FILTER (action = 'insert'),
    coalesce(sum(CASE action WHEN 'update' THEN n WHEN 'insert' THEN n - 1 END), 0)::BIGINT, 0::BIGINT,
    coalesce(sum(n) FILTER (action = 'conflict'), 0)::BIGINT, 'upsert' FROM decided)"""

_RAW_TITLE = f"CASE WHEN doc_id % 13 = 0 THEN '' ELSE {squeezed('split_part(text, chr(10), 1)')} END"
_RAW_BODY = squeezed("CASE WHEN lang IN ('de', 'es') THEN ' ' || text || chr(10) ELSE text END")
_FOLDED = "trim(regexp_replace(replace(lower(title || chr(10) || coalesce(body, '')), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_BUILT = f"""r AS (
    SELECT doc_id AS raw_id, CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 THEN replace('{BAD_JSON}', '%d', doc_id::VARCHAR)
        WHEN {_RAW_TITLE} = '' THEN replace('{NO_TITLE.replace("'", "''")}', '%d', doc_id::VARCHAR) END AS reject_reason,
      {_RAW_TITLE} AS title, nullif({_RAW_BODY}, '') AS body,
      CASE WHEN lang = 'de' THEN 'https://example.com/de/' || doc_id
           ELSE 'https://' || source || '.example.com/' || lang || '/' || doc_id || '?id=' || doc_id END AS url,
      source, CASE WHEN doc_id % 3 <> 0 THEN lang ELSE 'unknown' END AS category, doc_id FROM documents WHERE doc_id % 23 <> 0)"""
SQL["clean_rows"] = f"""WITH {_BUILT}
  SELECT raw_id, reject_reason, CASE WHEN reject_reason IS NULL THEN title END AS title, CASE WHEN reject_reason IS NULL THEN body END AS body,
    CASE WHEN reject_reason IS NULL THEN url END AS url, CASE WHEN reject_reason IS NULL THEN source END AS source,
    CASE WHEN reject_reason IS NULL THEN category END AS category,
    CASE WHEN reject_reason IS NULL THEN CASE WHEN body IS NULL THEN 'no_body' ELSE 'ok' END END AS clean_status,
    CASE WHEN reject_reason IS NULL THEN coalesce(length(body), 0) END AS original_length,
    CASE WHEN reject_reason IS NULL THEN sha256({_FOLDED}) END AS content_hash,
    CASE WHEN reject_reason IS NULL THEN strftime(TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INT), {ISO}) END AS published_at FROM r"""
SQL["clean_outcomes"] = f"""WITH {_BUILT} SELECT CASE WHEN reject_reason IS NOT NULL THEN 'invalid' WHEN body IS NULL THEN 'no_body'
    ELSE 'ok' END AS outcome, count(*) AS n FROM r GROUP BY 1"""
SQL["clean_run"] = f"""WITH {_BUILT} SELECT count(*) AS processed, count(*) FILTER (reject_reason IS NULL) AS inserted, 0::BIGINT AS updated,
    0::BIGINT AS skipped, count(*) FILTER (reject_reason IS NOT NULL) AS invalid, 0::BIGINT AS conflicts FROM r"""
SQL["stream_distinct_urls"] = f"WITH {EVENTS} SELECT DISTINCT source_name, canonical_url FROM rows"
SQL["stream_raw_inserts"] = f"""WITH {EVENTS}, firsts AS (
    SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY source_name, canonical_url ORDER BY place) = 1)
  SELECT row_number() OVER (ORDER BY place) AS id, source_name, canonical_url, status,
    CASE WHEN status <> 'error' THEN seq::VARCHAR END AS external_id, raw_payload FROM firsts"""
SQL["stream_clean"] = f"""WITH {_BUILT} SELECT row_number() OVER (ORDER BY raw_id) AS id, raw_id, url, title, body, category,
    CASE WHEN body IS NULL THEN 'no_body' ELSE 'ok' END AS clean_status FROM r WHERE reject_reason IS NULL"""

SQL["merge_upsert_blocks"], SQL["merge_skip_blocks"] = SQL["merge_upsert"], SQL["merge_skip"]
SQL["summary_update_blocks"], SQL["raw_status_blocks"] = SQL["summary_update"], SQL["raw_status_update"]
SQL["stream_upsert"] = f"""WITH {_BUILT} SELECT raw_id + 10000000 AS raw_id, url, title, body, category,
    CASE WHEN body IS NULL THEN 'no_body' ELSE 'ok' END AS clean_status FROM r WHERE reject_reason IS NULL"""
SQL["clean_rerun"] = f"""WITH {_BUILT}, c AS (SELECT count(*) AS processed, count(*) FILTER (reject_reason IS NULL) AS known FROM r)
  SELECT processed, 0::BIGINT AS inserted, CASE policy WHEN 'upsert' THEN known ELSE 0 END AS updated, CASE policy WHEN 'skip' THEN known ELSE 0 END AS skipped,
    processed - known AS invalid, 0::BIGINT AS conflicts, policy FROM c, (VALUES ('skip'), ('upsert')) p(policy)"""
SQL["clean_limited"] = f"""WITH {_BUILT} SELECT raw_id, reject_reason, CASE WHEN reject_reason IS NULL THEN title END AS title FROM r ORDER BY raw_id LIMIT 100"""

_CRAWL = f"""{ARTICLES}, {ROBOTS}, firsts AS (
    SELECT a.page_id, a.url, title, body, allowed, origin, crawl_delay FROM articles a JOIN allowed USING (page_id)
    QUALIFY row_number() OVER (PARTITION BY a.url ORDER BY page_id) = 1), listed AS (
    SELECT page_id // 50 AS chunk, url, row_number() OVER (PARTITION BY page_id // 50 ORDER BY min(page_id)) - 1 AS pos FROM pages GROUP BY 1, 2)"""


def crawled(fault: str) -> str:
    return f"""WITH {_CRAWL}, found AS (SELECT *, {fault} AS error FROM listed JOIN firsts USING (url))
  SELECT 'index-' || chunk AS source_name, pos::INT AS pos, error IS NULL AS ok, url, CASE WHEN error IS NULL THEN title END AS title,
    CASE WHEN error IS NULL THEN body END AS body, NULL::VARCHAR AS published_raw, CASE WHEN error IS NULL THEN url END AS external_id,
    'https://index.example.com/' || chunk AS source_url, error FROM found"""


SQL["crawl_pages"] = crawled("CASE WHEN url NOT LIKE 'https%' THEN 'HTTP 503' END")
SQL["crawl_allowed"] = crawled(f"CASE WHEN NOT allowed THEN '{DENIED}' || url WHEN url NOT LIKE 'https%' THEN 'HTTP 503' END")
SQL["crawl_slots"] = f"""WITH {_CRAWL}, frontier AS (SELECT url, min(chunk * 4294967296 + pos) AS seq FROM listed GROUP BY url)
  SELECT url AS link, origin, allowed, CASE WHEN allowed THEN (row_number() OVER (PARTITION BY origin, allowed ORDER BY seq) - 1)
    * greatest(1.0, coalesce(crawl_delay, 0.0)) END AS slot_seconds FROM frontier JOIN firsts USING (url)"""

_TALK_ROW = f"""CASE WHEN {{bad}} OR turn = 2 THEN 'https://talk.example.com/feed/' || conv_id ELSE link END AS url,
    CASE WHEN NOT ({{bad}}) AND turn <> 2 THEN role END AS title, CASE WHEN NOT ({{bad}}) AND turn <> 2 THEN nullif(body, '') END AS body"""
_BAD = "(conv_id % 3 = 1 AND pos = last) OR (conv_id % 3 = 2 AND turn = 1)"
SQL["feed_items_mended"] = f"""WITH {TURNS}, t AS (SELECT *, max(pos) OVER (PARTITION BY conv_id) AS last FROM turns)
  SELECT 'talk-' || conv_id AS source_name, pos::INT AS pos, 1 AS attempted, NOT ({_BAD}) AND turn <> 2 AS ok, {_TALK_ROW.format(bad=_BAD)},
    CASE WHEN NOT ({_BAD}) AND turn <> 2 THEN CASE WHEN conv_id % 3 = 0 THEN '2024-01-0' || turn ELSE 'Mon, 01 Jan 2024 0' || turn || ':00:00 +0900' END END AS published_raw,
    CASE WHEN NOT ({_BAD}) AND turn <> 2 THEN 'talk ' || conv_id END AS feed_title,
    CASE WHEN {_BAD} THEN '{CUT_ENTRY}' WHEN turn = 2 THEN '{NO_LINK}' END AS error FROM t"""
SQL["feed_large"] = f"""WITH {TURNS}, t AS (SELECT * EXCLUDE (pos), row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM turns)
  SELECT pos::INT AS pos, 5 * 4294967296 + pos AS seq, turn <> 2 AS ok, CASE WHEN turn = 2 THEN 'https://talk.example.com/feed' ELSE link END AS url,
    CASE WHEN turn <> 2 THEN role END AS title, CASE WHEN turn <> 2 THEN nullif(body, '') END AS body,
    CASE WHEN turn <> 2 THEN 'Mon, 01 Jan 2024 0' || turn || ':00:00 +0900' END AS published_raw, CASE WHEN turn <> 2 THEN 'all talks' END AS feed_title,
    CASE WHEN turn = 2 THEN '{NO_LINK}' END AS error FROM t"""
SQL["raw_inserts_refetched"] = f"""WITH {TURNS}, r AS (
    SELECT 'talk-' || conv_id AS source_name, conv_id * 4294967296 + pos + CASE WHEN turn = 2 THEN 1 ELSE 0 END * (1::BIGINT << 61) AS place,
      CASE WHEN turn = 2 THEN 'https://talk.example.com/feed/' || conv_id ELSE 'https://talk.example.com/' || conv_id || '/' || turn END AS canonical_url,
      turn = 2 AS failed, CASE WHEN turn = 2 THEN json_object('url', 'https://talk.example.com/feed/' || conv_id, 'error', '{NO_LINK}') ELSE
        json_object('source', 'talk-' || conv_id, 'url', link, 'title', role, 'body', nullif(body, ''),
          'published_at', 'Mon, 01 Jan 2024 0' || turn || ':00:00 +0900', 'category', 'talk', 'external_id', link, 'feed_title', 'talk ' || conv_id) END::VARCHAR AS raw_payload FROM turns)
  SELECT row_number() OVER (ORDER BY place) AS id, source_name, canonical_url, CASE WHEN failed THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN failed THEN '{NO_LINK}' END AS error_message, raw_payload FROM r"""

SQL["summaries_journal"] = f"""WITH {CLEAN}, {OUTCOMES} SELECT id, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'failed' END AS outcome,
    CASE WHEN error IS NULL THEN answer END AS reply, error, original_length, (SELECT count(*) FROM answered WHERE error IS NULL) AS calls FROM answered"""
SQL["summarize_by_id"] = f"""WITH {CLEAN}, one AS (SELECT min(id) AS id FROM art WHERE summary IS NOT NULL), o AS (
    SELECT id, {present('body')} AND (title = '' OR {present('title')}) AS good FROM art JOIN one USING (id))
  SELECT false AS forced, id, 'skipped' AS outcome, 0::BIGINT AS attempted, 0::BIGINT AS succeeded, 1::BIGINT AS skipped FROM o
  UNION ALL SELECT true, id, CASE WHEN good THEN 'succeeded' ELSE 'failed' END, 1, good::BIGINT, 0 FROM o"""
_ASKED = f"""{CLEAN}, {blocks('PARTITION BY category')}, asked AS (
    SELECT category, count(*) AS article_count, min(id) FILTER (number = 1) AS first,
      {filled_in(ANALYSIS_USER, "'전체'", "'전체'", "category", "count(*)", "string_agg(block, chr(10) || chr(10) ORDER BY number)")} AS prompt
    FROM summed WHERE running_length <= 20000 OR number = 1 GROUP BY category)"""
SQL["analyze"] = f"""WITH {_ASKED} SELECT (SELECT max(id) FROM art WHERE published_at IS NOT NULL) + row_number() OVER (ORDER BY a.category) AS id,
    NULL::VARCHAR AS date_from, a.category, article_count, 'analyst' AS model, trim(coalesce(nullif(title, ''), '(제목 없음)'), '{BLANKS}') AS trends, a.category AS keywords,
    '' AS commonalities_differences, length(prompt)::VARCHAR AS implications
  FROM asked a JOIN art ON art.id = first WHERE a.category NOT IN ('es', 'fr')"""
SQL["analyze_failures"] = f"""WITH {_ASKED} SELECT category, article_count,
    CASE category WHEN 'es' THEN 'no answer' ELSE '{EMPTY_LIST.format("trends").replace("'", "''")}' END AS error FROM asked WHERE category IN ('es', 'fr')"""
SQL["report_build"] = f"""WITH {RUNS}, m AS (SELECT {QUALITY}, (SELECT count(*) FROM documents) AS raw_count FROM art WHERE {IN_RANGE}), r AS (SELECT *, {RATES} FROM m)
  SELECT 'count' AS part, NULL::BIGINT AS place, name, n, NULL::VARCHAR AS share FROM (UNPIVOT m ON clean_count, body_count, summarized_count, raw_count INTO NAME name VALUE n)
  UNION ALL SELECT 'rate', NULL, name, NULL, printf('%.1f%%', rate * 100) FROM (UNPIVOT (SELECT clean_rate, body_rate, summary_rate FROM r) ON clean_rate, body_rate, summary_rate INTO NAME name VALUE rate)
  UNION ALL SELECT * FROM (SELECT 'source', row_number() OVER (ORDER BY count(*) DESC, source) AS place, source, count(*), NULL FROM art WHERE {IN_RANGE} GROUP BY source ORDER BY place LIMIT 3)
  UNION ALL SELECT * FROM (SELECT 'category', row_number() OVER (ORDER BY count(*) DESC, category) AS place, category, count(*), NULL FROM art WHERE {IN_RANGE} GROUP BY category ORDER BY place LIMIT 3)
  UNION ALL SELECT 'day', NULL, strftime(collected_at, '%Y-%m-%d'), count(*), NULL FROM art WHERE {IN_RANGE} GROUP BY collected_at
  UNION ALL SELECT * FROM (SELECT 'analysis', NULL, category, id, NULL FROM runs ORDER BY id DESC LIMIT 1)"""
SQL["export_ordered"] = SQL["export_rows"]

SQL["list_page_deep"] = f"""WITH {CLEAN}, placed AS (SELECT *, row_number() OVER (ORDER BY eff DESC, id DESC) - 1 AS place FROM art)
  SELECT {LIST} FROM placed WHERE place // 20 = (SELECT count(*) // 2 // 20 FROM documents)"""
SQL["report_changes"] = " UNION ALL ".join(
    f"""SELECT category, source, substr(collected_at, 1, 10)::DATE AS day, count(*) AS clean_count, count(*) FILTER (trim(body) <> '') AS body_count,
  count(*) FILTER (trim(summary) <> '') AS summarized_count, '{policy}' AS policy FROM ({SQL["merge_" + policy]}) GROUP BY 1, 2, 3"""
    for policy in ("skip", "upsert")
)

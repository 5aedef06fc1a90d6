"""Prompt texts as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow.functions import ColumnOrName, as_column
from articleflow.functions.dates import day_text
from articleflow.functions.text import filled, shorten, strip
from articleflow.schemas import UNKNOWN

# The wording a model is given. Replies depend on it, so it must not vary.
SUMMARY_SYSTEM = (
    "당신은 뉴스 요약 전문가입니다. 주어진 기사 내용만을 근거로 요약하세요. "
    "기사에 없는 사실, 추측, 배경지식을 절대 추가하지 마세요. "
    "요약은 반드시 한국어로 작성하고, 핵심을 3~5개의 문장으로 정리하세요. "
    "머리말, 맺음말, 목록 기호, 마크다운 없이 문장만 출력하세요."
)
SUMMARY_USER = (
    "다음 뉴스 기사를 한국어 3~5문장으로 요약하세요.\n기사에 없는 내용은 추가하지 마세요.\n\n"
    "제목: %s\n출처: %s\n카테고리: %s\n본문:\n%s\n"
)
SUMMARY_BODY_LIMIT, SUMMARY_BODY_CUT = 4000, "\n...(이하 생략)"
SUMMARY_NO_BODY = "(본문 없음 - 제목만으로 요약하지 말고 정보 부족을 명시하세요)"

ANALYSIS_SYSTEM = (
    "당신은 뉴스 트렌드 분석가입니다. 제공된 기사 목록만을 근거로 분석하세요. "
    "기사에 없는 사실을 만들어내지 마세요. "
    "반드시 아래 스키마를 만족하는 JSON 객체 하나만 출력하세요. "
    "설명 문장, 마크다운 코드펜스, 주석을 붙이지 마세요.\n"
    '{"trends": [문자열...], "keywords": [문자열...], '
    '"commonalities_differences": [문자열...], "implications": [문자열...]}\n'
    "모든 값은 한국어 문자열이어야 하고, 각 배열은 최소 1개 이상의 항목을 포함해야 합니다."
)
ANALYSIS_USER = (
    "다음은 분석 대상 뉴스 목록입니다.\n조건: 기간=%s~%s, 카테고리=%s, 기사 수=%d건\n\n%s\n\n"
    "위 기사들을 종합해 다음을 JSON으로 작성하세요.\n"
    "- trends: 주요 트렌드 3~5개\n- keywords: 핵심 키워드 5~10개\n"
    "- commonalities_differences: 기사들 간 공통점과 차이점 2~5개\n- implications: 시사점 3~5개\n"
)
ANALYSIS_BLOCK = "[%d] 제목: %s\n    출처: %s | 카테고리: %s | 일자: %s\n    내용: %s"
ANALYSIS_BODY_LIMIT, ANALYSIS_BODY_CUT = 800, "…"
ANALYSIS_NO_TEXT = "(요약/본문 없음)"
NO_TITLE, WHOLE_RANGE = "(제목 없음)", "전체"


def _or(name: str, stand_in: str) -> Column:
    return F.coalesce(filled(name), F.lit(stand_in))


def summary_prompt(body_limit: int = SUMMARY_BODY_LIMIT) -> Column:
    """The request to summarize one article."""
    body = filled(strip("body"))
    text = F.coalesce(shorten(body, body_limit, SUMMARY_BODY_CUT), F.lit(SUMMARY_NO_BODY))
    return F.format_string(SUMMARY_USER, _or("title", NO_TITLE), _or("source", UNKNOWN), _or("category", UNKNOWN), text)


def analysis_block(number: ColumnOrName, body_limit: int = ANALYSIS_BODY_LIMIT) -> Column:
    """The paragraph that stands for one article in an analysis request: its summary, else its cut body."""
    text = F.coalesce(
        filled(strip("summary")),
        shorten(filled(strip("body")), body_limit, ANALYSIS_BODY_CUT),
        F.lit(ANALYSIS_NO_TEXT),
    )
    return F.format_string(
        ANALYSIS_BLOCK, as_column(number), _or("title", NO_TITLE), _or("source", UNKNOWN), _or("category", UNKNOWN),
        F.coalesce(day_text(F.coalesce("published_at", "collected_at")), F.lit("")), text,
    )


def analysis_prompt(articles: ColumnOrName, count: ColumnOrName, category: Column, date_from: str | None, date_to: str | None) -> Column:
    """The request to analyse a list of articles."""
    return F.format_string(
        ANALYSIS_USER, F.lit(date_from or WHOLE_RANGE), F.lit(date_to or WHOLE_RANGE),
        F.coalesce(category, F.lit(WHOLE_RANGE)), as_column(count), as_column(articles),
    )

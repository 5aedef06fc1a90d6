"""Table schemas, column orders and the fixed status words of the article model."""

from pyspark.sql import types as T

# Status, method and policy words stored in the tables.
RAW_OK, RAW_PARTIAL, RAW_ERROR, RAW_INVALID = "ok", "partial", "error", "invalid"
CLEAN_OK, CLEAN_NO_BODY = "ok", "no_body"
METHOD_SOURCE_TYPE = {"rss": "rss", "crawl": "web"}
DUPLICATE_POLICIES = ("skip", "upsert")
SUMMARY_STATES = ("all", "summarized", "unsummarized")
UNKNOWN = "unknown"


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


def string_struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


_L, _S, _TS, _LIST = T.LongType(), T.StringType(), T.TimestampType(), T.ArrayType(T.StringType())

RAW_ARTICLES = _struct(
    ("id", _L, True),
    ("external_id", _S, True),
    ("source_name", _S, False),
    ("source_url", _S, True),
    ("collection_method", _S, False),
    ("collected_at", _TS, False),
    ("canonical_url", _S, False),
    ("raw_payload", _S, False),
    ("status", _S, False),
    ("error_message", _S, True),
)

CLEAN_ARTICLES = _struct(
    ("id", _L, True),
    ("raw_id", _L, False),
    ("title", _S, False),
    ("body", _S, True),
    ("url", _S, False),
    ("source", _S, False),
    ("category", _S, False),
    ("published_at", _TS, True),
    ("collected_at", _TS, False),
    ("content_hash", _S, True),
    ("clean_status", _S, False),
    ("summary", _S, True),
    ("summary_model", _S, True),
    ("summarized_at", _TS, True),
    ("original_length", _L, True),
    ("summary_length", _L, True),
)

ANALYSIS_RUNS = _struct(
    ("id", _L, True),
    ("date_from", _S, True),
    ("date_to", _S, True),
    ("category", _S, True),
    ("article_count", _L, False),
    ("trends", _LIST, False),
    ("keywords", _LIST, False),
    ("commonalities_differences", _LIST, True),
    ("implications", _LIST, False),
    ("model", _S, True),
    ("created_at", _TS, False),
)

FETCH_RUNS = _struct(
    ("id", _L, True),
    ("source_name", _S, True),
    ("collection_method", _S, True),
    ("attempted_count", _L, True),
    ("success_count", _L, True),
    ("failure_count", _L, True),
    ("duplicate_count", _L, True),
    ("started_at", _TS, True),
    ("finished_at", _TS, True),
)

# The columns an upsert replaces; summary columns are left as they are.
CONTENT_COLUMNS = (
    "raw_id", "title", "body", "url", "source", "category", "published_at",
    "collected_at", "content_hash", "clean_status", "original_length",
)
SUMMARY_COLUMNS = ("summary", "summary_model", "summarized_at", "summary_length")

# Fixed order of the export files.
EXPORT_COLUMNS = (
    "id", "title", "url", "source", "category", "published_at", "collected_at", "clean_status",
    "summary", "summary_model", "summarized_at", "original_length", "summary_length",
    "content_hash", "body",
)

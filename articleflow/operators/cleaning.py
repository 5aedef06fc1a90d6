"""Raw rows to clean rows: payload fields with their fallbacks, normalization, rejection."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions.dates import normalize_date
from articleflow.functions.text import filled, normalize_article, normalize_text
from articleflow.functions.urls import normalize_url
from articleflow.schemas import CLEAN_NO_BODY, CLEAN_OK, RAW_OK, UNKNOWN

_FIELDS = ("title", "url", "body", "summary", "description", "category", "published_at", "published", "source")
# The payload is read as the value of a wrapping object: a scalar or an array then has no fields, and what
# follows the payload's own end is an error instead of being passed over.
PAYLOAD_SCHEMA = "struct<p struct<" + ", ".join(f"{name} variant" for name in _FIELDS) + ">, _broken string>"
PAYLOAD_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false", "maxStringLen": str(2**31 - 1)}

#: A VARIANT holds 128 MiB; payloads of more bytes than this are read field by field as text instead, with the same outcome.
LARGE = 1 << 26
_AS = {"text": "string", "number": "double", "flag": "boolean", "list": "array<string>", "object": "map<string,string>"}

# What a rejected row is marked with.
BAD_JSON = "raw payload가 올바른 JSON이 아닙니다 (raw_id=%d)"
BAD_TYPE = "텍스트가 아닌 필드가 있습니다 (raw_id=%d)"
NO_TITLE = "필수 필드 'title'이 비어 있습니다 (raw_id=%d)"
NO_URL = "필수 필드 'url'이 비어 있습니다 (raw_id=%d)"


def _describe(value: Column) -> Column:
    """One JSON value of unknown type: its text, how it is written, whether it holds anything, whether that is no text."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    written = F.coalesce(text, F.to_json(value))
    empty = written.isin("", "[]", "{}", "false", "null") | (F.coalesce(F.try_variant_get(value, "$", "double"), F.lit(1.0)) == 0)
    present = (kind != "VOID") & F.when(kind == "STRING", text != "").otherwise(~empty)
    return F.struct(
        text.alias("text"), written.alias("written"), present.alias("present"), (present & (kind != "STRING")).alias("misfit")
    )


def _read_as(wrapped: Column, kind: str) -> Column:
    schema = "struct<p struct<" + ", ".join(f"{name} {_AS[kind]}" for name in _FIELDS) + ">, _broken string>"
    return F.from_json(wrapped, schema, PAYLOAD_OPTIONS)


def _describe_large(name: str) -> Column:
    """The same of a field of a large payload: what it can be read as tells its type."""
    text, number, flag, items, fields = (F.col(f"_{kind}.p.{name}") for kind in _AS)
    other = number.isNotNull() | flag.isNotNull() | items.isNotNull() | fields.isNotNull()
    empty = (F.coalesce(number, F.lit(1.0)) == 0) | ~F.coalesce(flag, F.lit(True)) | (F.size(items) == 0) | (F.size(fields) == 0)
    present = text.isNotNull() & F.when(other, ~F.coalesce(empty, F.lit(False))).otherwise(text != "")
    return F.struct(F.when(~other, text).alias("text"), text.alias("written"), present.alias("present"), (present & other).alias("misfit"))


def _first_present(fields: Column, *names: str) -> Column:
    """The first of the named fields that holds something, or NULL.

    A white-space-only text counts as holding something and so keeps later fields from being used.
    """
    return F.get(F.filter(F.array(*[fields[_FIELDS.index(name)] for name in names]), lambda field: field["present"]), F.lit(0))


def build_clean_rows(raw: DataFrame) -> DataFrame:
    """One row per raw row: the clean columns (without id) and ``reject_reason``, NULL for a usable row.

    JSON is parsed in the JVM; all normalizers run in one Python stage, which a body enters and leaves once.
    """
    wrapped = F.concat(F.lit('{"p":'), "raw_payload", F.lit("}"))
    large = F.octet_length("raw_payload") > LARGE
    payload = F.when(~large, F.from_json(wrapped, PAYLOAD_SCHEMA, PAYLOAD_OPTIONS))
    parsed = raw.select(
        "id", "canonical_url", "source_name", "collected_at", large.alias("_large"), payload.alias("_w"),
        *[F.when(large, _read_as(wrapped, kind)).alias(f"_{kind}") for kind in _AS],
    )
    small = F.transform(F.array(*[F.col(f"_w.p.{name}") for name in _FIELDS]), _describe)
    described = parsed.withColumn("_f", F.when(F.col("_large"), F.array(*[_describe_large(name) for name in _FIELDS])).otherwise(small))
    bad_json = F.when(F.col("_large"), F.col("_text.p").isNull() | F.col("_text._broken").isNotNull()).otherwise(F.col("_w.p").isNull() | F.col("_w._broken").isNotNull())
    roles = {
        "_title": ("title",), "_url": ("url",), "_body": ("body", "summary", "description"), "_category": ("category",),
        "_published": ("published_at", "published"), "_source": ("source",),
    }
    picked = described.select(
        "id", "canonical_url", "source_name", "collected_at",
        bad_json.alias("_bad_json"),
        *[_first_present(F.col("_f"), *names).alias(role) for role, names in roles.items()],
    )
    misfits = [F.coalesce(F.col(f"{role}.misfit"), F.lit(False)) for role in ("_title", "_url", "_body", "_category")]
    chosen = picked.select(
        F.col("id").alias("raw_id"), "collected_at", "_bad_json", reduce(lambda a, b: a | b, misfits).alias("_misfit"),
        F.coalesce(filled("source_name"), F.col("_source.written"), F.lit(UNKNOWN)).alias("source"),
        F.col("_title.text").alias("_title"), F.col("_body.text").alias("_body"), F.col("_category.text").alias("_category"),
        F.when(F.col("_url").isNull(), F.col("canonical_url")).otherwise(F.col("_url.text")).alias("_url"),
        F.col("_published.written").alias("_published"),
    )
    normalized = chosen.select(
        "raw_id", "source", "collected_at", "_bad_json", "_misfit",
        normalize_article("_title", "_body").alias("_a"),
        normalize_url("_url").alias("url"),
        normalize_text("_category").alias("_category"),
        normalize_date("_published").alias("published_at"),
    )
    text_body = filled("_a.body")
    reason = (
        F.when(F.col("_bad_json"), F.format_string(BAD_JSON, "raw_id"))
        .when(F.col("_misfit"), F.format_string(BAD_TYPE, "raw_id"))
        .when(F.col("_a.title") == "", F.format_string(NO_TITLE, "raw_id"))
        .when(filled("url").isNull(), F.format_string(NO_URL, "raw_id"))
    )
    return normalized.select(
        "raw_id",
        F.col("_a.title").alias("title"),
        text_body.alias("body"),
        "url",
        "source",
        F.coalesce(filled("_category"), F.lit(UNKNOWN)).alias("category"),
        "published_at",
        "collected_at",
        F.col("_a.content_hash").alias("content_hash"),
        F.when(text_body.isNull(), CLEAN_NO_BODY).otherwise(CLEAN_OK).alias("clean_status"),
        F.coalesce(F.length(text_body), F.lit(0)).cast("long").alias("original_length"),
        reason.alias("reject_reason"),
    )


def cleanable(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Raw rows that cleaning reads: status ``ok`` only, lowest ids first when limited."""
    rows = raw.where(F.col("status") == RAW_OK)
    return rows if limit is None else rows.orderBy("id").limit(limit)

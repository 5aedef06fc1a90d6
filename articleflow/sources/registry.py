"""The source registry: one row per configured source, with the rules a source must meet."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions.text import filled, is_blank
from articleflow.operators.numbering import number_rows
from articleflow.schemas import METHOD_SOURCE_TYPE, UNKNOWN

# Source types, what each must have, and the marker of an unfilled example.
REQUIRED_KEYS = {
    "rss": ("url",),
    "web": ("list_url", "article_link_selector", "title_selector", "body_selector"),
}
PLACEHOLDER = "REPLACE_WITH"

_TEXT_KEYS = (
    "type", "category", "url", "list_url", "base_url", "article_link_selector",
    "title_selector", "body_selector", "date_selector",
)
_SOURCE = "struct<" + ", ".join(f"{key} string" for key in _TEXT_KEYS) + (
    ", params map<string,string>, auth_header_env map<string,string>>"
)


def _problem() -> Column:
    """The first rule a source breaks, or NULL."""
    checks = F.when(F.col("_s").isNull(), "not an object").when(filled("type").isNull(), "missing type")
    checks = checks.when(~F.col("type").isin(*REQUIRED_KEYS), F.concat(F.lit("unknown type "), F.col("type")))
    for source_type, keys in REQUIRED_KEYS.items():
        for key in keys:
            unset = filled(key).isNull() | F.col(key).startswith(PLACEHOLDER)
            checks = checks.when((F.col("type") == source_type) & unset, f"{key} is empty or a placeholder")
    unnamed = F.exists(F.coalesce(F.map_values("auth_header_env"), F.array().cast("array<string>")), is_blank)
    return checks.when(unnamed, "auth_header_env needs names of environment variables")


def source_registry(config: DataFrame, *, text: str = "text") -> DataFrame:
    """Explode JSON configurations (``{"sources": {name: {...}}}``) into rows with a ``problem`` column.

    ``source_no`` counts the sources of all different configurations from 0.
    """
    sources = F.from_json(F.col(text), f"struct<sources map<string,{_SOURCE}>>")["sources"]
    # Places of one configuration stay together and in order; configurations are ordered by a hash of their text.
    order = F.shiftleft(F.xxhash64(text).bitwiseAND((1 << 43) - 1), 20)
    rows = config.select(order.alias("_config"), F.posexplode(sources).alias("_place", "source_name", "_s"))
    rows = rows.withColumn("_order", F.col("_config") + F.col("_place"))
    rows = number_rows(rows, "_order", "_number").withColumn("source_no", F.col("_number") - 1)
    fields = rows.select("source_no", "source_name", "_s", "_s.*").withColumn("problem", _problem())
    return fields.withColumn("category", F.coalesce(filled("category"), F.lit(UNKNOWN))).drop("_s")


def valid_sources(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("problem").isNull()).drop("problem")


def rejected_sources(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("problem").isNotNull()).select("source_no", "source_name", "problem")


def match_sources(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Look up the source of each request (``source_name, collection_method``) and check method against type.

    Adds ``category`` and ``problem``. The registry is small beside the requests, but its size is left for
    Spark to judge: it broadcasts below its threshold and shuffles above it.
    """
    known = valid_sources(registry).select("source_name", F.col("type").alias("_type"), "category")
    wanted = F.create_map(*[F.lit(word) for pair in METHOD_SOURCE_TYPE.items() for word in pair])
    needed = F.try_element_at(wanted, F.col("collection_method"))
    problem = (
        F.when(needed.isNull(), "unknown collection method")
        .when(F.col("_type").isNull(), "unknown source")
        .when(F.col("_type") != needed, F.concat(F.lit("source is of type "), F.col("_type")))
    )
    return requests.join(known, "source_name", "left").withColumn("problem", problem).drop("_type")

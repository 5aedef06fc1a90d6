"""What a fetcher brought back, a document per URL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.operators.ingest import first_per_key


def newest_fetch(fetched: DataFrame, content: str, url: str = "url") -> DataFrame:
    """One row per URL: a document rather than a failure, the newest by ``fetched_at`` (where there is that column), equal ones by their content's hash.

    Spark prunes to one row per URL and task before the shuffle, so a URL that was fetched very often is no hot key.
    """
    late = F.col("fetched_at").cast("double") if "fetched_at" in fetched.columns else F.lit(0.0)
    ranked = fetched.withColumns(
        {"_failed": F.col(content).isNull(), "_age": -F.coalesce(late, F.lit(0.0)), "_hash": F.xxhash64(*[c for c in fetched.columns if c != "fetched_at"])}
    )
    return first_per_key(ranked, (url,), "_failed", "_age", "_hash").drop("_failed", "_age", "_hash")

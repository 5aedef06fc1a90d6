"""File exports with a fixed set of columns."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.functions.dates import to_iso
from articleflow.operators.query import effective_at, query_articles
from articleflow.schemas import EXPORT_COLUMNS, SUMMARY_STATES

FORMATS = ("csv", "jsonl")
BOM = "\ufeff"


def _exported(rows: DataFrame, name: str) -> Column:
    is_time = isinstance(rows.schema[name].dataType, T.TimestampType)
    return (to_iso(name) if is_time else F.col(name)).alias(name)


def export_view(rows: DataFrame) -> DataFrame:
    """The fifteen columns in their order; times as UTC ISO text, counts as whole numbers."""
    return rows.select(*[_exported(rows, name) for name in EXPORT_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files that begin with a byte order mark and a header, also when there is no row."""
    first, *rest = rows.columns
    marked = rows.select(F.col(first).alias(BOM + first), *rest)
    marked.write.mode("overwrite").options(
        header=True, escape='"', nullValue="", emptyValue="", encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


CSV_LINES = {"escape": '"', "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_ordered(articles: DataFrame, fmt: str, path: str) -> None:
    """The export of articles as one document in parts: joined in the order of their names they are the file that one task would write.

    Rows are ranged by effective date and id, so parts are written side by side and no task sorts all. A CSV has its mark and header in the first part only, also when there is no row.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt!r}")
    fields = F.struct(*[_exported(articles, name) for name in EXPORT_COLUMNS])
    line = F.to_csv(fields, CSV_LINES) if fmt == "csv" else F.to_json(fields, {"ignoreNullFields": "false"})
    lines = articles.select(F.lit(1).alias("_place"), effective_at().alias("_at"), F.col("id").alias("_id"), line.alias("value"))
    if fmt == "csv":
        head = articles.sparkSession.createDataFrame([(0, BOM + ",".join(EXPORT_COLUMNS))], "_place int, value string")
        lines = lines.unionByName(head, allowMissingColumns=True)
    lines.orderBy("_place", "_at", "_id").select("value").write.mode("overwrite").text(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per line; missing values are written as null and text is not escaped to ASCII."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_rows(rows: DataFrame, fmt: str, path: str) -> tuple[str, int]:
    """Write rows as ``fmt`` below ``path``; the count is observed while writing, not by a second scan."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt!r}")
    observed = Observation()
    counted = export_view(rows).observe(observed, F.count(F.lit(1)).alias("rows"))
    (write_csv if fmt == "csv" else write_jsonl)(counted, path)
    return path, observed.get["rows"]


def export_articles(
    clean: DataFrame, fmt: str, path: str, *, status: str = "all", date_from: str | None = None,
    date_to: str | None = None, category: str | None = None, limit: int | None = None,
) -> tuple[str, int]:
    """Write the articles that match, in order of date and id."""
    if status not in SUMMARY_STATES:
        raise ValueError(f"unsupported status: {status!r}")
    rows = query_articles(clean, status=status, date_from=date_from, date_to=date_to, category=category, limit=limit)
    return export_rows(rows, fmt, path)


def read_csv_export(spark, path: str) -> DataFrame:
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def read_jsonl_export(spark, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)

"""Session settings: what Python gets at a time does not grow with the table."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from articleflow.session import prepare


@arrow_udf(T.LongType())
def _batch_bytes(texts: pa.Array) -> pa.Array:
    return pa.array([texts.nbytes] * len(texts), pa.int64())


def test_texts_reach_python_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    prepare(spark)
    texts = spark.range(0, 2000, 1, 1).select(F.rpad(F.col("id").cast("string"), 20_000, "x").alias("text"))
    row = texts.select(_batch_bytes("text").alias("n")).agg(F.count("*").alias("rows"), F.max("n").alias("most")).first()
    assert row["rows"] == 2000
    assert row["most"] < 9 << 20

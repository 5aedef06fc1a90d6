"""Lines that many documents share: one document keeps them, a run-length keep bitmap per document says which lines stay.

Fingerprints of lines are range-partitioned with documents and positions as secondary order. The range bounds include the
document, so a line that is in a third of all documents is spread over many tasks; its first occurrence in each document
is streamed off the sorted rows, counts are summed map-side, and only lines over the limit meet the fingerprints again, in
a join that Spark can split where one line is very frequent. Texts take part at the two ends only.

Defined results: a null or empty text is one empty line; rows that repeat an id with other texts are judged row by row,
but count as one document; a null id counts as one document, smaller than all others; any other columns pass unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.llm.common import stored

#: Fixed: what is stripped from both ends of a line.
STRIPPED = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(id, version, pos, h1, h2) of each line whose key has ``min_chars`` code points or more; h1 and h2 are 128 bits of the key."""
    lines = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.posexplode(text_lines(text_col)).alias("pos", "line")
    ).select("id", "version", "pos", F.btrim("line", F.lit(STRIPPED)).alias("line"))
    key = F.translate("line", UPPER, LOWER)
    return (
        lines.filter(F.length("line") >= min_chars)
        .select("id", "version", "pos", key.alias("key"))
        .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )


def shared_lines(prints: DataFrame, min_docs: int = 5) -> DataFrame:
    """(h1, h2, keeper) of the lines that at least ``min_docs`` documents hold; keeper is the largest id among them."""
    dealt = prints.select("h1", "h2", "id", "pos").repartitionByRange("h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "pos")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("pos"))
    return (
        dealt.withColumn("nth", first)
        .filter("nth = 1")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """(id, version, dropped) for each text that loses lines: the places of those lines, ascending.

    ``with_bitmap`` turns them into the run-length bitmap once the number of lines is at hand.
    """
    prints = stored(fingerprints(docs, id_col, text_col, min_chars), "line-prints")
    shared = stored(shared_lines(prints, min_docs), "shared-lines")
    gone = prints.join(shared, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def with_bitmap(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the document), ``n_lines``, ``n_dropped``, ``keep_runs`` and ``kept``, the text of the lines that stay.

    ``keep_runs`` is the compressed keep bitmap: lengths of runs, positive for lines that stay, negative for lines that go.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_version"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    )
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_version") == F.col("version"))
    flags = F.expr(
        "concat(array_join(transform(dropped, (p, i) -> concat(repeat('1', p - if(i = 0, -1, dropped[greatest(i - 1, 0)]) - 1), '0')), ''),"
        " repeat('1', n_lines - 1 - element_at(dropped, -1)))"
    )
    runs = F.expr("transform(regexp_extract_all(flags, '(1+|0+)', 1), r -> if(startswith(r, '1'), length(r), -length(r)))")
    kept = F.expr("array_join(filter(split(body, '\n'), (line, i) -> substring(cast(flags as binary), i + 1, 1) = X'31'), '\n')")
    return (
        rows.join(dropped, same, "left")
        .withColumn("n_lines", F.size(F.split("body", "\n")))
        .withColumn("flags", F.when(F.col("dropped").isNotNull(), flags))
        .select(
            "row",
            F.col("n_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("flags").isNull(), F.array("n_lines")).otherwise(runs).alias("keep_runs"),
            F.when(F.col("flags").isNull(), F.col("body")).otherwise(kept).alias("kept"),
        )
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """``with_bitmap`` of all documents: every row of ``docs`` once, whatever it loses."""
    return with_bitmap(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)

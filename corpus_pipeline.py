"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm import quality
from articleflow.llm.common import documents, fold, ready, stored, table
from articleflow.llm.contamination import flagged
from articleflow.llm.jaccard import one_of_each
from articleflow.llm.lines import dedup_lines
from articleflow.llm.packing import pack_documents

METADATA = ("n_chars",)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it learns from the labels outside fold 1 of 3."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1, metadata=METADATA)
    return docs.filter(quality.score(model, metadata=METADATA) >= 0.5)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another document keeps; a null text stays null."""
    ready(spark)
    kept = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    text = {"text": kept, "n_chars": F.length(kept).cast(docs.schema["n_chars"].dataType)}
    return dedup_lines(docs).select(*(text[c].alias(c) if c in text else F.col(f"row.`{c}`") for c in docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ready(spark)
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return flagged(docs, table(spark, sf_dir, "benchmark")).filter(~F.col("is_leak")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequences."""
    ready(spark)
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: A trained classifier and a tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""The registered queries of the operators: whole tables in, the digest columns of each contract out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm import quality
from articleflow.llm.common import documents, fold, table
from articleflow.llm.contamination import flagged
from articleflow.llm.jaccard import near_duplicates
from articleflow.llm.language import language_scores
from articleflow.llm.lattice import near_vectors
from articleflow.llm.lines import dedup_lines
from articleflow.llm.negatives import hard_negatives
from articleflow.llm.packing import pack_documents
from articleflow.llm.privacy import BASE_KINDS, find_personal_data
from articleflow.llm.secrets import find_secrets
from articleflow.llm.substrings import drop_repeats
from articleflow.llm.suffixes import remove_repeats
from articleflow.llm.turns import damaged, repair_digests


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _joined(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern and by entropy in every text."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return find_secrets(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        *(_count("spans", kind) for kind in ("assign", "access", "hex")),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all texts by a model of the labels outside fold 1 of 3."""
    docs = documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1, metadata=("n_chars",))
    return docs.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), quality.score(model, metadata=("n_chars",)).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts without the bytes that are in a string of 400 bytes that starts elsewhere too."""
    found = remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, packed into sequences."""
    import public_tokenizers

    packed = pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 or more code points in 5 or more documents stay in the largest doc_id only."""
    return dedup_lines(documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), "keep_runs"
    )


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with a cosine of at least 0.95."""
    found = near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and which benchmark items it holds, verbatim or with other numbers, names and units."""
    found = flagged(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "is_leak", F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"), "longest")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that link at a Jaccard similarity of 0.75 of their 5-word shingles."""
    return near_duplicates(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op9_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by pattern, and the terms that reveal it, in every text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return find_personal_data(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), *(_count("spans", kind) for kind in BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all texts by counts and by a model of the texts outside fold 0 of 10."""
    held_out = fold("doc_id", 10) == 0
    found = language_scores(documents(spark, sf_dir), ~held_out)
    return found.withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts without the words of 20-word windows that also start earlier."""
    found = drop_repeats(documents(spark, sf_dir), threshold=20)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"])
    return found.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired at least cost."""
    found = repair_digests(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh vector counts under the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label=label)


QUERIES = {"op1_secrets": op1_secrets, "op2_quality": op2_quality, "op3_suffixes": op3_suffixes, "op4_packing": op4_packing, "op5_line_dedup": op5_line_dedup, "op6_lattice": op6_lattice, "op7_contamination": op7_contamination, "op8_jaccard": op8_jaccard, "op9_privacy": op9_privacy, "op10_language": op10_language, "op11_substrings": op11_substrings, "op12_turns": op12_turns, "op13_negatives": op13_negatives}

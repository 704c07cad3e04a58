"""From raw documents to packed training sequences: five stages, each written and read again as the next one's input.

Every stage takes all rows that the one before kept and is judged on those. Repeated rows, nulls, empty and very long
texts and empty tables have the results that the operators' docstrings state; columns beyond those of ``documents`` are
carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litscreen.functions.scale import stage
from litscreen.llm import decontaminate, lines, minhash, packing, quality
from litscreen.llm.common import rows_apart, rows_together, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more go on."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = rows_apart(docs).select("row", "text", F.col("text").alias("scored"))
    scored = quality.score_quality(rows, model, text_col="scored")
    return scored.filter("score >= 0.5").select(*rows_together(docs, F.col("text")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut out; a document of which only blank lines are left goes.

    ``n_chars``, if there, is counted anew where something was cut out. Older ``n_lines`` and ``n_removed`` go.
    """
    others = docs.drop("n_lines", "n_removed")
    left = lines.dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n", "")) != ""))
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", counted)
    return left.select(*others.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, and of repeated rows one."""
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("id"), F.col("version").alias("v")).distinct()
    rows = rows_apart(docs)
    match = rows["doc_id"].eqNullSafe(kept["id"]) & (rows["version"] == kept["v"])
    one = rows.join(kept, match, "left_semi").dropDuplicates(["doc_id", "version"])
    return one.select(*rows_together(docs, F.col("text")))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, laid into sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate_documents),
    ("packing", pack),
]

# A trained classifier and a tokenizer are part of it, which SQL can't express: tests/llm compares it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""The registered queries: every dealt operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litscreen.llm import (
    decontaminate, extract, language_model, licences, lines, minhash, negatives, neighbours, packing, phrases, quality, repeats, toxicity,
)
from litscreen.llm.common import table


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup_report(table(spark, sf, "documents"))


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeats_report(table(spark, sf, "documents"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licences.licence_report(table(spark, sf, "documents"))


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return decontaminate.contamination_report(found)


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op8_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return extract.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op12_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf, "documents"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_repeats": op3_repeats,
    "op4_toxicity": op4_toxicity,
    "op5_licences": op5_licences,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_neighbours": op8_neighbours,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_extraction": op10_extraction,
    "op11_phrases": op11_phrases,
    "op12_language_model": op12_language_model,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE: dict[str, str] = {"op1_line_dedup": lines.ORACLE, "op11_phrases": phrases.ORACLE, "op13_hard_negatives": negatives.ORACLE}

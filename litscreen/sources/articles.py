"""Landed articles: one row per article with its abstract paragraphs and its (title, text) sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litscreen.functions import fixed
from litscreen.functions.text import blank

SECTION = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
ARTICLES = T.StructType([
    T.StructField("article_id", T.LongType()),
    T.StructField("doi", T.StringType()),
    T.StructField("abstract", T.ArrayType(T.StringType())),
    T.StructField("sections", T.ArrayType(SECTION)),
])


def articles_from_lines(df: DataFrame, id_col: str, text_col: str, doi_col: str | None = None) -> DataFrame:
    """One article per text: the first non-empty line is its abstract, every later line a section."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda line: ~blank(line))
    doi = F.col(doi_col) if doi_col else F.lit(None)
    untitled = F.transform(
        F.slice(F.col("lines"), 2, F.greatest(F.size("lines"), F.lit(1))),
        lambda t: F.struct(F.lit("").alias("title"), t.alias("text")),
    )
    parts = df.select(
        F.col(id_col).alias("article_id"), doi.cast("string").alias("doi"), F.coalesce(lines, F.array()).alias("lines")
    )
    return parts.select("article_id", "doi", F.slice("lines", 1, 1).alias("abstract"), untitled.alias("sections"))


def read_articles(
    spark: SparkSession, path: str, id_col: str = "article_id", text_col: str | None = None, doi_col: str | None = None
) -> DataFrame:
    """Load articles from Parquet; with ``text_col`` they are cut from plain texts, else the columns are read as is."""
    if text_col is None:
        return spark.read.schema(ARTICLES).parquet(path)
    return articles_from_lines(spark.read.parquet(path), id_col, text_col, doi_col)


def full_text_gate(articles: DataFrame, min_sections: int = fixed.MIN_FULL_TEXT_SECTIONS) -> DataFrame:
    """Keep full texts that have an abstract and enough sections.

    Where the source counts its sections (``n_sec``, as journals do), that count decides; else every paragraph is a section.
    """
    enough = F.col("n_sec") if "n_sec" in articles.columns else F.size("sections")
    return articles.filter((F.size("abstract") > 0) & (F.size("sections") > 0) & (enough >= min_sections))


def drop_empty_articles(articles: DataFrame) -> DataFrame:
    """Drop articles with neither an abstract nor a section."""
    return articles.filter((F.size("abstract") > 0) | (F.size("sections") > 0))

"""Which text each article gets: full text, else abstract with PDF sections, else the abstract alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.functions import fixed
from litscreen.functions.scale import broadcast_if_small
from litscreen.sources.articles import full_text_gate


def best_text(joined: DataFrame) -> DataFrame:
    """Choose per row among ``full_*``, ``brief_*`` and ``pdf_sections``, and tag the row with the choice."""
    is_full = F.col("full_sections").isNotNull()
    is_pdf = F.col("brief_doi").isNotNull() & F.col("pdf_sections").isNotNull()
    return joined.select(
        "article_id",
        F.when(is_full, fixed.FORMAT_FULL_TEXT)
        .when(is_pdf, fixed.FORMAT_ABSTRACT_AND_PDF)
        .otherwise(fixed.FORMAT_ABSTRACT)
        .alias("format"),
        F.when(is_full, F.col("full_abstract")).otherwise(F.col("brief_abstract")).alias("abstract"),
        F.when(is_full, F.col("full_sections"))
        .when(is_pdf, F.col("pdf_sections"))
        .otherwise(F.col("brief_sections"))
        .alias("sections"),
    )


def resolve_articles(
    ids: DataFrame,
    full_text: DataFrame,
    abstracts: DataFrame,
    pdf_text: DataFrame,
    min_sections: int = fixed.MIN_FULL_TEXT_SECTIONS,
) -> DataFrame:
    """Best available text per requested id, tagged with where it came from; ids with no text are dropped.

    Every input has at most one row per article. The wanted ids are few beside the landed tables, so each table is first
    cut down to them and only what is left is joined.
    """
    wanted = broadcast_if_small(ids.select("article_id").distinct())

    def landed(table: DataFrame, prefix: str, *extra: str) -> DataFrame:
        cut = table.join(wanted, "article_id", "left_semi")
        return cut.select("article_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("abstract", "sections", *extra)])

    full = landed(full_text_gate(full_text, min_sections), "full")
    brief = landed(abstracts.filter(F.size("abstract") > 0), "brief", "doi")
    pdf = landed(pdf_text.filter((F.size("abstract") > 0) & (F.size("sections") > 0)), "pdf")

    return best_text(full.join(brief, "article_id", "full_outer").join(pdf, "article_id", "left"))

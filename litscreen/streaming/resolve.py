"""The best text of each article while abstracts and full texts arrive apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.functions import fixed
from litscreen.operators.resolve import best_text
from litscreen.sources.articles import full_text_gate


def stream_resolved(
    abstracts: DataFrame,
    full_text: DataFrame,
    pdf_text: DataFrame | None = None,
    wait: str = "7 days",
    lateness: str = "1 day",
    min_sections: int = fixed.MIN_FULL_TEXT_SECTIONS,
) -> DataFrame:
    """``(article_id, format, abstract, sections)`` as ``resolve_articles``, from two streams with a time ``landed_at``.

    An abstract waits until its full text lands, or until the watermark says that none landed within ``wait`` before or
    after it; then it goes out as it is, with its PDF text where the stored table ``pdf_text`` has one and its DOI is known.
    A full text without an abstract goes out after the same time. One that lands later than ``wait`` still comes out, as a
    second row of its article, so a reader that wants it replaces the first. ``lateness`` is how far files may be out of
    order: rows older than that are dropped by the watermark, which is the lower of the two streams' own. Rows without an id
    or a time are dropped, as nothing can be waited for. An article lands at most once in each stream.

    Kept state is the texts of one ``wait``, dealt out by article, one row each; at scale set the RocksDB state store.
    """

    def landed(rows: DataFrame, prefix: str, *extra: str) -> DataFrame:
        known = rows.filter(F.col("article_id").isNotNull() & F.col("landed_at").isNotNull())
        columns = ("article_id", "abstract", "sections", "landed_at", *extra)
        return known.withWatermark("landed_at", lateness).select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])

    full = landed(full_text_gate(full_text, min_sections), "full")
    brief = landed(abstracts.filter(F.size("abstract") > 0), "brief", "doi")
    apart = F.expr(f"INTERVAL {wait}")
    met = (
        (F.col("full_article_id") == F.col("brief_article_id"))
        & (F.col("full_landed_at") >= F.col("brief_landed_at") - apart)
        & (F.col("full_landed_at") <= F.col("brief_landed_at") + apart)
    )
    joined = full.join(brief, met, "full_outer").withColumn("article_id", F.coalesce("full_article_id", "brief_article_id"))
    if pdf_text is None:
        return best_text(joined.withColumn("pdf_sections", F.lit(None).cast(full_text.schema["sections"].dataType)))
    pdf = pdf_text.filter((F.size("abstract") > 0) & (F.size("sections") > 0))
    return best_text(joined.join(pdf.select("article_id", F.col("sections").alias("pdf_sections")), "article_id", "left"))

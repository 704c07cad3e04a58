"""Articles as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from litscreen.functions import fixed
from litscreen.functions.scale import stage, stages_dropped
from litscreen.operators.extraction import Extractor
from litscreen.operators.results import create_result_table
from litscreen.operators.search import search_corpus
from litscreen.plans.screening import prompt_head, screen
from litscreen.sources.articles import ARTICLES, drop_empty_articles
from litscreen.spec import ReviewSpec


def stream_articles(
    spark: SparkSession, path: str, schema: T.StructType = ARTICLES, max_files_per_trigger: int | None = None
) -> DataFrame:
    """New Parquet files under ``path`` as a stream of articles, empty ones dropped."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return drop_empty_articles(reader.parquet(path))


def stream_screen(
    spark: SparkSession,
    articles: DataFrame,
    spec: ReviewSpec,
    plan: DataFrame,
    hits: DataFrame | None,
    table: str,
    extractor: Extractor,
    checkpoint: str,
    concurrency: int = fixed.EXTRACTOR_CONCURRENCY,
    stem: bool = True,
    terms: DataFrame | None = None,
    store: str | None = None,
) -> StreamingQuery:
    """Screen each micro-batch of the articles that ``hits`` names and upsert the answers.

    With ``terms`` instead (``hits`` is None then), each micro-batch is searched as it lands, so new articles are found.
    The best N of a question are those of each micro-batch: what landed earlier was screened by then.

    A batch that is run again finds its rows in the table and adds nothing, so the table ends up the same. What a batch
    stages is deleted once it is written. With ``store``, answers outlive a batch that fails, and a replay makes no call for
    what is kept there.
    """
    if (hits is None) == (terms is None):
        raise ValueError("give either hits or terms")
    create_result_table(spark, table, spec)
    head = prompt_head(spark, spec)

    def handle(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        with stages_dropped(session):
            found = hits if terms is None else stage(search_corpus(batch, terms, spec.top_articles), "hits")
            screen(session, spec, plan, found, batch, table, extractor, concurrency, stem, head, store)

    return (
        articles.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

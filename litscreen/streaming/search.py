"""Searches whose best articles are kept while the corpus arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from litscreen.functions import fixed
from litscreen.functions.scale import delete_folder, folder_exists, folders_in, stages_dropped
from litscreen.operators.search import search_corpus

KEPT = 2  # finished states that stay: the newest, and the one that readers may still hold


def _states(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished states, oldest first. An unfinished one has no success mark."""
    if not folder_exists(spark, path):
        return []
    numbers = sorted(int(f.removeprefix("batch=")) for f in folders_in(spark, path) if f.startswith("batch="))
    return [n for n in numbers if folder_exists(spark, f"{path}/batch={n}/_SUCCESS")]


def best_of(hits: DataFrame, top_n: int) -> DataFrame:
    """The best ``top_n`` of each question, ranked: more matching terms first, then the lower article id."""
    best = Window.partitionBy("question_id").orderBy(F.desc("n_terms"), "article_id")
    ranked = hits.select("question_id", "article_id", "n_terms", F.row_number().over(best).alias("rank"))
    return ranked.filter(F.col("rank") <= top_n)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """``(question_id, article_id, n_terms, rank)`` over everything that has been searched so far."""
    done = _states(spark, path)
    if not done:
        raise ValueError(f"no finished search at {path}")
    return spark.read.parquet(f"{path}/batch={done[-1]}")


def stream_search(
    articles: DataFrame, terms: DataFrame, path: str, checkpoint: str, top_n: int = fixed.TOP_ARTICLES_PER_SEARCH
) -> StreamingQuery:
    """Search articles as they land, and keep at ``path`` the best ``top_n`` per question of all that have landed.

    How many terms an article matches doesn't depend on the others, so the best of the kept rows and of a micro-batch's
    best are the best of both: whatever the files are split into, the rows end up those of ``search_corpus`` over all of
    them. The state is ``top_n`` rows per question, however much has landed. Each micro-batch writes the next state from
    the one before its own number, so one that is run again writes the same. An article must land once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with stages_dropped(spark):
            found = search_corpus(batch, terms, top_n)
            before = [n for n in _states(spark, path) if n < number]
            if before:
                kept = spark.read.schema(found.schema).parquet(f"{path}/batch={before[-1]}")
                found = best_of(found.drop("rank").unionByName(kept.drop("rank")), top_n)
            found.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for old in before[: max(0, len(before) + 1 - KEPT)]:
            delete_folder(spark, f"{path}/batch={old}")

    return (
        articles.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

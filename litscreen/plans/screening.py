"""A whole review as one flow of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litscreen.functions import fixed
from litscreen.functions.scale import broadcast_if_small, stage
from litscreen.operators import extraction, planning, prompts, ranking, results, summary
from litscreen.operators.resolve import resolve_articles
from litscreen.operators.search import search_corpus
from litscreen.sources.articles import drop_empty_articles
from litscreen.spec import ReviewSpec


def review_plan(spark: SparkSession, spec: ReviewSpec) -> DataFrame:
    """One row per question: its number, its text and the input values it stands for."""
    grid = planning.input_grid(spec.input_rows(spark), spec.params)
    return planning.format_question(grid, spec.question, spec.params).select(
        "question_id", "question", *[F.col(f"{p}.name").alias(p) for p in spec.params]
    )


def review_hits(spark: SparkSession, spec: ReviewSpec, articles: DataFrame) -> DataFrame:
    """The articles each question's search finds, stored."""
    grid = planning.input_grid(spec.input_rows(spark), spec.params)
    terms = planning.search_terms(grid, spec.params, spec.search_groups)
    return stage(search_corpus(articles, terms, spec.top_articles), "hits")


def cut_to_pairs(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """The articles of the work list, stored with their number of sections: the one pass over the corpus texts that
    ranking needs."""
    wanted = broadcast_if_small(pairs.select("article_id"))
    needed = articles.join(wanted, "article_id", "left_semi")
    return stage(needed.withColumn("n_sections", ranking.section_count(articles)), "articles")


def ranked_evidence(pairs: DataFrame, articles: DataFrame, k: int, stem: bool = True) -> DataFrame:
    """``(question_id, article_id, sections)`` for pairs that carry their ``question``; articles as stored by
    ``cut_to_pairs``."""
    questions = pairs.select("question_id", "question").distinct()
    ranked = ranking.rank_sections(pairs, articles, questions, k, stem)
    return ranking.label_sections(ranking.with_section_text(ranked, articles))


def prompt_head(spark: SparkSession, spec: ReviewSpec) -> tuple[str, str]:
    """The examples and the opening text, which all prompts of a review share."""
    block = prompts.few_shot_block(prompts.example_rows(spark, spec)) if spec.examples else ""
    return block, prompts.prompt_opening(spec)


def screen(
    spark: SparkSession,
    spec: ReviewSpec,
    plan: DataFrame,
    hits: DataFrame,
    articles: DataFrame,
    table: str,
    extractor: extraction.Extractor,
    concurrency: int = fixed.EXTRACTOR_CONCURRENCY,
    stem: bool = True,
    head: tuple[str, str] | None = None,
    store: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Extract and write what is not in the result table yet: (summary row, rejected answers).

    Pairs whose extractor failed every time are among the rejected, with the reason ``failed`` and their ``error``.
    ``articles`` are resolved and carry ``format``. With ``store``, answers are kept in that folder by their prompt, and a
    prompt answered before makes no call. Finished pairs are dropped before any text is read for ranking.
    """
    block, opening = head or prompt_head(spark, spec)
    key = F.col("article_id").cast("string").alias(fixed.ARTICLE_KEY)

    pairs = planning.screening_pairs(plan, hits, drop_empty_articles(articles))
    keyed = stage(pairs.select("question_id", "article_id", "question", *spec.params, key), "pairs")
    done = results.results_near(spark, table, keyed, spec.keys)
    pending = stage(results.pending_extractions(keyed, done, spec.keys, spec.overwrite_existing), "pending")
    texts = cut_to_pairs(articles, pending)

    evidence = ranked_evidence(pending, texts, spec.top_sections, stem)
    work = pending.join(evidence, ["question_id", "article_id"]).join(texts.select("article_id", "format"), "article_id")
    work = stage(prompts.build_prompts(work, block, opening), "prompts")
    ids = ["question_id", "article_id"]
    if store:
        answers = stage(extraction.run_extractor_stored(work, extractor, ids, store, concurrency), "answers")
    else:
        answers = stage(extraction.run_extractor(work, extractor, ids, concurrency), "answers")
    parsed = stage(extraction.parse_responses(answers.filter(F.col("error").isNull()), spec.features), "parsed")
    good, rejected = extraction.split_rejects(parsed)
    failures = answers.filter(F.col("error").isNotNull())
    rejected = rejected.unionByName(failures.withColumn("reject_reason", F.lit("failed")), allowMissingColumns=True)

    records = work.drop("prompt", "question").join(good, ["question_id", "article_id"])
    rows = results.serialise_record(results.project_columns(records, spec, "question_id"))
    written = results.write_results(spark, table, rows, spec, "question_id", spec.overwrite_existing)

    added = written.select(*spec.keys, F.lit(True).alias("added"))
    lost = rejected.select("question_id", "article_id", F.lit(True).alias("lost"), F.col("error").isNotNull().alias("failed"))
    outcomes = (
        keyed.join(answers.select("question_id", "article_id", "cost"), ["question_id", "article_id"], "left")
        .join(lost, ["question_id", "article_id"], "left")
        .join(added, spec.keys, "left")
        .select(
            F.when(F.col("lost"), 0.0).otherwise(F.coalesce("cost", F.lit(0.0))).alias("cost"),
            F.coalesce("added", F.lit(False)).alias("added"),
            F.coalesce("failed", F.lit(False)).alias("failed"),
        )
    )
    return summary.run_summary(outcomes, failed_col="failed"), rejected


def run_review(
    spark: SparkSession,
    spec: ReviewSpec,
    articles: DataFrame,
    table: str,
    extractor: extraction.Extractor,
    concurrency: int = fixed.EXTRACTOR_CONCURRENCY,
    stem: bool = True,
    store: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Create the table, search the corpus and screen every article found."""
    results.create_result_table(spark, table, spec)
    hits = review_hits(spark, spec, articles)
    return screen(spark, spec, review_plan(spark, spec), hits, articles, table, extractor, concurrency, stem, store=store)


def run_review_from_sources(
    spark: SparkSession,
    spec: ReviewSpec,
    abstracts: DataFrame,
    full_text: DataFrame,
    pdf_text: DataFrame,
    table: str,
    extractor: extraction.Extractor,
    concurrency: int = fixed.EXTRACTOR_CONCURRENCY,
    stem: bool = True,
    store: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Search the landed ``abstracts``, give each article found its best landed text and its ``format``, and screen it.

    Only found articles are resolved, so full texts and PDF texts are cut to them before anything is joined. A found
    article without any text is not screened.
    """
    results.create_result_table(spark, table, spec)
    hits = review_hits(spark, spec, abstracts)
    articles = stage(resolve_articles(hits, full_text, abstracts, pdf_text), "resolved")
    return screen(spark, spec, review_plan(spark, spec), hits, articles, table, extractor, concurrency, stem, store=store)

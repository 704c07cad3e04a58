"""One query per operator. Each reads whole tables of the given folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import shared
from litscreen.functions import fixed
from litscreen.functions.scale import held, spread_small_scan, stage, stage_path
from litscreen.functions.text import search_words
from litscreen.operators import extraction, index, planning, prompts, ranking, results, summary
from litscreen.operators.resolve import resolve_articles as resolve
from litscreen.operators.search import search_corpus as search
from litscreen.plans import screening
from litscreen.sources import articles as art
from litscreen.sources import journals, lookups, markup
from litscreen.spec import InputItem, InputParameter, keyword_groups
from litscreen.streaming import resolve as arrivals
from litscreen.streaming import screening as streams
from litscreen.streaming import search as searched

K = fixed.TOP_SECTIONS_PER_ARTICLE


# -- bindings --------------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, doi: bool = False) -> DataFrame:
    """Documents as articles; with ``doi``, labelled ones have an outside identifier."""
    docs = spread_small_scan(table(spark, sf, "documents").select("doc_id", "text"))
    if not doi:
        return art.articles_from_lines(docs, "doc_id", "text")
    known = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("x/"), "doc_id").alias("doi"))
    return art.articles_from_lines(docs.join(known, "doc_id", "left"), "doc_id", "text", "doi")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread_small_scan(table(spark, sf, "pages").select("page_id", "html"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def question_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search terms of a question: words 1 and 2 of four letters or more, and words 3 and 4 or its two opening words."""
    long = F.regexp_extract_all(F.lower("question"), F.lit(r"[\p{L}]{4,}"), F.lit(0))
    opening = F.array_join(F.slice(search_words(F.col("question")), 1, 2), " ")
    groups = F.array(F.slice(long, 1, 2), F.concat(F.slice(long, 3, 2), F.array(opening)))
    rows = questions(spark, sf).select("question_id", F.posexplode(groups).alias("group_no", "terms"))
    return rows.select("question_id", "group_no", F.explode("terms").alias("term"))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return search(documents(spark, sf), question_search(spark, sf))


def work_list(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored pairs with their question, and the stored articles they name."""
    docs = documents(spark, sf)
    pairs = stage(search(docs, question_search(spark, sf)).join(questions(spark, sf), "question_id"), "pairs")
    return pairs, screening.cut_to_pairs(docs, pairs)


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    nation_items = nations.select(
        F.lit("nation").alias("param"),
        F.col("n_nationkey").alias("pos"),
        F.col("n_name").alias("name"),
        F.concat(F.lit('["'), "r_name", F.lit('", "'), "r_name", F.lit(" region"), F.lit('"]')).alias("search_aliases"),
        F.concat(F.lit('["'), "r_name", F.lit('"]')).alias("question_aliases"),
    )
    brands = table(spark, sf, "part").groupBy("p_brand").agg(
        (F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") - 1).alias("pos")
    )
    brand_items = brands.select(
        F.lit("brand"), "pos", "p_brand", F.lit("").alias("search_aliases"), F.lit("").alias("question_aliases")
    )
    return planning.parse_aliases(nation_items.union(brand_items), "search_aliases", "question_aliases")


def labelled_answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.expr(shared.ANSWER).alias("response"))


def stored_records(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as stored records, each twice under different ids."""
    labels = table(spark, sf, "labels")
    first = labels.select(
        (F.col("doc_id") + 1).alias("id"),
        F.col("doc_id").cast("string").alias("pubmed_id"),
        F.lit("quality").alias("topic"),
        F.concat(F.lit("stored "), "quality").alias("note"),
    )
    return first.unionByName(first.withColumn("id", F.col("id") + 10_000_000))


def new_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as new records, each given twice, in the order of ``seq``."""
    docs = table(spark, sf, "documents")
    base = docs.select(F.col("doc_id").cast("string").alias("pubmed_id"), F.lit("quality").alias("topic"), "lang", "source")
    one = base.select("pubmed_id", "topic", F.col("lang").alias("note"), F.lit(1).alias("seq"))
    return one.unionByName(base.select("pubmed_id", "topic", F.col("source").alias("note"), F.lit(2).alias("seq")))


KEYS = ["topic", "pubmed_id"]


def flat(articles: DataFrame, *extra: str) -> DataFrame:
    """Articles with their lists as text."""
    return articles.select(
        "article_id",
        *extra,
        F.size("abstract").alias("n_abstract"),
        F.size("sections").alias("n_sections"),
        F.array_join("abstract", "\n").alias("abstract"),
        F.array_join(F.transform("sections", lambda s: s["text"]), "\n").alias("sections"),
    )


def answer_by_length(limit: int) -> Callable[[str], tuple[str, float]]:
    """A deterministic extractor: sorts prompts by length."""

    def answer(prompt: str) -> tuple[str, float]:
        size = len(prompt)
        label = "L" if size > limit else "S"
        return f'{{"size_class": "{label}", "n_chars": {size}}}', size / 1000

    return answer


# -- sources ---------------------------------------------------------------------------------------------------------


def read_articles(spark, sf):
    return flat(art.read_articles(spark, f"{sf}/documents.parquet", "doc_id", "text"))


def sections_from_markup(spark, sf):
    cut = markup.sections_from_markup(pages(spark, sf))
    rows = cut.select("page_id", F.posexplode("sections").alias("section_no", "s"))
    return rows.select("page_id", "section_no", F.col("s.title").alias("title"), F.col("s.text").alias("text"))


def search_corpus(spark, sf):
    return hits(spark, sf)


def search_index(spark, sf):
    """The corpus goes into the index in two additions; a share of it arrives twice and replaces what was there."""
    docs, path = documents(spark, sf), stage_path(spark, "index")
    late = F.col("article_id") % 3 == 0
    index.add_to_index(docs.filter(~late | (F.col("article_id") % 2 == 0)), path, buckets=16)
    index.add_to_index(docs.filter(late), path)
    return index.search_index(spark, path, question_search(spark, sf))


def search_corpus_grid(spark, sf):
    """Every combination of input values, with common words in every question and keywords that all of them share."""
    grid = planning.input_grid(inputs(spark, sf), shared.INPUTS)
    terms = planning.search_terms(grid, shared.INPUTS, keyword_groups("AND (the OR of)"))
    common = F.when(F.col("question_id") % 2 == 0, "the").otherwise("que")
    more = grid.select("question_id", F.lit(0).alias("group_no"), common.alias("term"))
    also = grid.select("question_id", F.lit(1).alias("group_no"), F.lit("that").alias("term"))
    return search(documents(spark, sf), terms.unionByName(more).unionByName(also))


def map_external_ids(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"))
    known = table(spark, sf, "labels").select(
        F.col("doc_id").alias("article_id"), F.concat(F.lit("PMC"), "doc_id").alias("external_id")
    )
    return lookups.map_external_ids(ids, known)


def explode_locations(spark, sf):
    url = F.col("url")
    record = F.to_json(
        F.struct(
            F.struct(url.alias("url_for_pdf")).alias("first_oa_location"),
            F.struct(F.lit("x").alias("url_for_pdf")).alias("other_place"),
            F.struct(F.lit("").alias("url_for_pdf")).alias("empty_oa_location"),
            F.struct(F.concat(url, F.lit(".pdf")).alias("url_for_pdf")).alias("best_oa_location"),
            F.lit(None).cast("string").alias("last_oa_location"),
        ),
        {"ignoreNullFields": "false"},
    )
    return lookups.explode_locations(table(spark, sf, "pages").select("page_id", record.alias("record")), "record")


def first_valid_candidate(spark, sf):
    candidates = table(spark, sf, "pages").select(
        F.regexp_extract("url", "//([^/]+)", 1).alias("article_id"),
        F.col("page_id").alias("pos"),
        "url",
        F.octet_length("html").alias("size"),
    )
    return lookups.first_valid_candidate(candidates)


def pending_fetch(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"))
    landed = table(spark, sf, "labels").select(
        F.col("doc_id").alias("article_id"), (F.col("quality") == 1).alias("is_valid")
    )
    return lookups.pending_fetch(ids, landed)


def full_text_gate(spark, sf):
    return flat(art.full_text_gate(documents(spark, sf)))


def drop_empty_articles(spark, sf):
    return flat(art.drop_empty_articles(markup.articles_from_markup(pages(spark, sf))))


def resolve_articles(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"))
    web = stage(markup.articles_from_markup(pages(spark, sf)), "web")
    return flat(resolve(ids, web, documents(spark, sf, doi=True), web), "format")


def journal_xml(spark, sf):
    """Documents written as journal articles: two abstract paragraphs, then sections of two paragraphs, every second one
    inside the one before; every third has a DOI."""
    clean = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, shared.SPACES, " ")))
    lines = F.transform(F.filter(clean, lambda x: x != ""), lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    docs = spread_small_scan(table(spark, sf, "documents").select("doc_id", F.coalesce(lines, F.array()).alias("lines")))
    n = F.ceil((F.size("lines") - 2) / 2).cast("int")

    def block(values):
        return F.concat(F.array_join(F.transform(values, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "\n"))

    def section(j):
        inside = F.concat(F.lit("<title>Part <b>"), j.cast("string"), F.lit("</b></title>"), block(F.slice("lines", 3 + 2 * j, 2)))
        close = F.when(j % 2 == 1, "</sec></sec>").when(j == n - 1, "</sec>").otherwise("")
        return F.concat(F.lit('<sec id="s">'), inside, close)

    sections = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), section), "")).otherwise("")
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<article-id pub-id-type="doi">10.1/'), "doc_id", F.lit("</article-id>"))).otherwise("")
    xml = F.concat(
        F.lit('<?xml version="1.0"?><article article-type="research"><front><article-meta><article-id pub-id-type="pmid">1</article-id>'), doi,
        F.lit("<abstract>"), block(F.slice("lines", 1, 2)), F.lit("</abstract></article-meta></front><body>"), sections, F.lit("</body></article>"),
    )
    return docs.select(F.col("doc_id").alias("article_id"), xml.alias("xml"))


def journal_articles(spark, sf):
    read = journals.articles_from_journals(journal_xml(spark, sf)).withColumn("titles", F.array_join(F.transform("sections", lambda s: s["title"]), "\n"))
    return flat(read, "doi", "n_sec", "titles")


def resolve_journals(spark, sf):
    """Journal XML to articles, through the gate, to the best text of each: all three formats."""
    read = stage(journals.articles_from_journals(journal_xml(spark, sf)), "journals")
    web = stage(markup.articles_from_markup(pages(spark, sf)), "web")
    return flat(resolve(read.select("article_id"), read, read, web), "format").drop("abstract", "sections")


def review_from_sources(spark, sf):
    """Two one-word questions, from search over resolution to the result table."""
    items = [InputItem(word) for word in shared.REVIEW_WORDS]
    spec = replace(shared.item_review(), inputs=[InputParameter("item", items, 20)])
    name, place = f"review_{uuid.uuid4().hex}", stage_path(spark, "result-table")
    results.create_result_table(spark, name, spec, buckets=8, location=place)
    web = stage(markup.articles_from_markup(pages(spark, sf)), "web")
    screening.run_review_from_sources(
        spark, spec, documents(spark, sf, doi=True), web, web, name, answer_by_length(10**9), 8, stem=False,
        store=stage_path(spark, "answers-by-prompt"),
    )
    return results.read_results(spark, name).select("item", F.col("pubmed_id").cast("long").alias("article_id"), "format")


# -- plan ------------------------------------------------------------------------------------------------------------


def parse_aliases(spark, sf):
    return inputs(spark, sf).select(
        "param", "pos", "name",
        F.array_join("search_aliases", "|").alias("search_aliases"),
        F.array_join("question_aliases", "|").alias("question_aliases"),
    )


def input_grid(spark, sf):
    grid = planning.input_grid(inputs(spark, sf), shared.INPUTS)
    return grid.select("question_id", *[F.col(f"{p}.name").alias(p) for p in shared.INPUTS])


def input_grid_sparse(spark, sf):
    """As ``input_grid``, from values whose positions have gaps and start anywhere."""
    apart = inputs(spark, sf).withColumn("pos", F.col("pos") * 3 + 7)
    grid = planning.input_grid(apart, shared.INPUTS)
    return grid.select("question_id", *[F.col(f"{p}.name").alias(p) for p in shared.INPUTS])


def build_search_query(spark, sf):
    grid = planning.input_grid(inputs(spark, sf), shared.INPUTS)
    return planning.build_search_query(grid, shared.INPUTS, shared.EXTRA_KEYWORDS).select("question_id", "search_query")


def search_terms(spark, sf):
    grid = planning.input_grid(inputs(spark, sf), shared.INPUTS)
    terms = planning.search_terms(grid, shared.INPUTS, shared.EXTRA_GROUPS)
    return planning.normalise_terms(terms)


def format_question(spark, sf):
    grid = planning.input_grid(inputs(spark, sf), shared.INPUTS)
    return planning.format_question(grid, shared.QUESTION_TEMPLATE, shared.INPUTS).select("question_id", "question")


def screening_pairs(spark, sf):
    found = stage(hits(spark, sf), "hits")
    return planning.screening_pairs(questions(spark, sf), found, art.full_text_gate(documents(spark, sf))).select(
        "question_id", "article_id", "rank", "question"
    )


# -- ranking ---------------------------------------------------------------------------------------------------------


def explode_sections(spark, sf):
    return ranking.explode_sections(documents(spark, sf))


def tokenize(spark, sf):
    tokens = ranking.tokenize(ranking.explode_sections(documents(spark, sf)), "text")
    return tokens.select("article_id", "section_no", F.array_join("tokens", " ").alias("tokens"))


def remove_stopwords(spark, sf):
    tokens = ranking.tokenize(ranking.explode_sections(documents(spark, sf)), "text")
    return ranking.remove_stopwords(tokens).select(
        "article_id", "section_no", F.size("tokens").alias("dl"), F.array_join("tokens", " ").alias("tokens")
    )


def stem_tokens(spark, sf):
    docs = spread_small_scan(table(spark, sf, "documents").select("doc_id", "text"))
    tokens = ranking.tokenize(docs, "text").select(F.explode("tokens").alias("token"))
    return ranking.stem_tokens(tokens, "token")


def section_term_stats(spark, sf):
    return ranking.section_term_stats(documents(spark, sf))


def bm25_scores(spark, sf):
    pairs, docs = work_list(spark, sf)
    terms = held(ranking.question_terms(questions(spark, sf)), "question-terms")
    return ranking.bm25_scores(ranking.section_term_stats(docs, vocabulary=terms), terms, pairs)


def top_sections(spark, sf):
    pairs, docs = work_list(spark, sf)
    return ranking.rank_sections(pairs, docs, questions(spark, sf), K, stem=False)


def top_sections_stemmed(spark, sf):
    pairs, docs = work_list(spark, sf)
    return ranking.rank_sections(pairs, docs, questions(spark, sf), K, stem=True)


def label_sections(spark, sf):
    pairs, docs = work_list(spark, sf)
    return screening.ranked_evidence(pairs, docs, K, stem=False)


# -- prompts and extraction ------------------------------------------------------------------------------------------


def render_examples(spark, sf):
    turns = table(spark, sf, "conversations")
    ask = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    examples = ask.join(reply, ["conv_id", "turn"]).select(
        "conv_id", "turn", "question",
        F.to_json(F.struct(F.col("question").alias("section_1"))).alias("sections"),
        F.to_json(F.struct(F.col("text").alias("answer"))).alias("answer"),
    )
    return prompts.render_examples(examples).select("conv_id", "turn", "example")


def _prompts(spark, sf):
    pairs, docs = work_list(spark, sf)
    evidence = screening.ranked_evidence(pairs, docs, K, stem=False)
    work = evidence.join(questions(spark, sf), "question_id")
    return prompts.build_prompts(work, shared.BLOCK, shared.OPENING).select("question_id", "article_id", "prompt")


def build_prompts(spark, sf):
    return _prompts(spark, sf)


def run_extractor(spark, sf):
    return extraction.run_extractor(
        _prompts(spark, sf), answer_by_length(shared.LONG_PROMPT), ["question_id", "article_id"], concurrency=8
    )


def few_shot_prompts(spark, sf):
    """Prompts for every question, headed by the examples of the review."""
    block = prompts.few_shot_block(prompts.example_rows(spark, shared.item_review(examples=shared.EXAMPLES)))
    asked = questions(spark, sf).withColumn("sections", F.lit("{}"))
    return prompts.build_prompts(asked, block, shared.OPENING).select("question_id", "prompt")


def extraction_failures(spark, sf):
    def answer(prompt: str) -> tuple[str, float]:
        if len(prompt) % 7 == 0:
            raise ValueError("no answer")
        return "{}", 0.0

    answers = extraction.run_extractor(_prompts(spark, sf), answer, ["question_id", "article_id"], 8, attempts=2, wait=(0.0, 0.0))
    return answers.filter(F.col("error").isNotNull()).select("question_id", "article_id", "error")


def _parsed_flat(df):
    return df.select(
        "doc_id", "verdict", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"),
        F.array_join("kinds", ",").alias("kinds"), "note", "weight", "flagged", "analysis",
    )


def parse_responses(spark, sf):
    parsed = extraction.parse_responses(labelled_answers(spark, sf), shared.FEATURES)
    return _parsed_flat(parsed).join(parsed.select("doc_id", "reject_reason"), "doc_id")


def split_rejects_good(spark, sf):
    parsed = stage(extraction.parse_responses(labelled_answers(spark, sf), shared.FEATURES), "parsed")
    return _parsed_flat(extraction.split_rejects(parsed)[0])


def split_rejects_bad(spark, sf):
    parsed = stage(extraction.parse_responses(labelled_answers(spark, sf), shared.FEATURES), "parsed")
    return extraction.split_rejects(parsed)[1].select("doc_id", "response", "reject_reason")


def expand_allowed_values(spark, sf):
    parsed = extraction.parse_responses(labelled_answers(spark, sf), shared.FEATURES)
    verdict, kinds = shared.FEATURES[0], shared.FEATURES[2]
    out = extraction.expand_allowed_values(parsed, "verdict", verdict.allowed_values)
    out = extraction.expand_allowed_values(out, "kinds", kinds.allowed_values)
    return out.select(
        "doc_id", "verdict", "verdict_name", "verdict_description",
        F.array_join("kinds_name", ",").alias("kinds_name"),
        F.array_join("kinds_description", ",").alias("kinds_description"),
    )


def cost_summary(spark, sf):
    calls = table(spark, sf, "events").select(
        F.col("value").alias("cost"), F.when(F.col("event_type") == "error", "failed").alias("error")
    )
    return summary.cost_summary(calls)


def cost_summary_small(spark, sf):
    """Costs far below the last digit of the total."""
    calls = table(spark, sf, "events").select(
        (F.col("value").cast("decimal(28,15)") / 1_000_000).alias("cost"), F.when(F.col("event_type") == "error", "failed").alias("error")
    )
    return summary.cost_summary(calls)


def run_summary(spark, sf):
    outcomes = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("cost"),
        (F.col("event_type") == "purchase").alias("added"),
    )
    return summary.run_summary(outcomes)


# -- result table ----------------------------------------------------------------------------------------------------


def project_columns(spark, sf):
    spec = shared.item_review()
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    wide = docs.select(
        (F.col("quality") + F.col("toxic")).cast("long").alias("n_chars"),
        F.when(F.col("quality") == 1, "L").otherwise("S").alias("size_class"),
        F.col("lang").alias("item"),
        F.col("text").alias("sections"),
        F.lit(fixed.FORMAT_ABSTRACT).alias("format"),
        "source",
        F.col("doc_id").cast("string").alias("pubmed_id"),
    )
    return results.project_columns(wide, spec)


def serialise_record(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    nested = docs.select(
        "doc_id", "lang",
        F.array("quality", "toxic").alias("marks"),
        F.create_map(F.lit("section_1"), "text").alias("sections"),
        F.struct("source", "n_chars").alias("origin"),
    )
    return results.serialise_record(nested)


def find_existing(spark, sf):
    pairs = new_records(spark, sf).filter("seq = 1").select(*KEYS)
    return results.find_existing(pairs, stored_records(spark, sf), KEYS)


def pending_extractions(spark, sf):
    pairs = new_records(spark, sf).filter("seq = 1").select(*KEYS)
    return results.pending_extractions(pairs, stored_records(spark, sf), KEYS)


def pending_extractions_overwrite(spark, sf):
    pairs = new_records(spark, sf).filter("seq = 1").select(*KEYS)
    return results.pending_extractions(pairs, stored_records(spark, sf), KEYS, overwrite=True)


def assign_record_ids(spark, sf):
    stored = stored_records(spark, sf)
    pairs = new_records(spark, sf).filter("seq = 1").select(*KEYS)
    return results.assign_record_ids(results.pending_extractions(pairs, stored, KEYS), stored, KEYS)


def upsert_results(spark, sf):
    return results.upsert_results(stored_records(spark, sf), new_records(spark, sf), KEYS, "seq")


def upsert_results_overwrite(spark, sf):
    return results.upsert_results(stored_records(spark, sf), new_records(spark, sf), KEYS, "seq", overwrite=True)


def _table_rows(df: DataFrame, lang: str, n) -> DataFrame:
    return df.select(
        F.col("doc_id").cast("string").alias("pubmed_id"), F.lit(fixed.FORMAT_ABSTRACT).alias("format"),
        F.lit("{}").alias("sections"), F.lit("all").alias("item"), F.lit(lang).alias("size_class"),
        n.cast("long").alias("n_chars"), F.lit(0).alias("seq"),
    )


def _label_table(spark: SparkSession, sf: str):
    """A table at a place of its own, with the labels written into it."""
    spec, name = shared.item_review(), f"review_{uuid.uuid4().hex}"
    results.create_result_table(spark, name, spec, buckets=8, location=stage_path(spark, "result-table"))
    labels = _table_rows(table(spark, sf, "labels"), "S", F.col("quality"))
    results.write_results(spark, name, labels, spec, "seq")
    return spec, name, _table_rows(table(spark, sf, "documents"), "L", F.col("n_chars"))


def result_table(spark, sf):
    """Write the documents over the labels, and read the table back."""
    spec, name, docs = _label_table(spark, sf)
    results.write_results(spark, name, docs, spec, "seq", overwrite=True)
    return results.read_results(spark, name)


def reset_result_table(spark, sf):
    """Empty the table of labels, then write the documents."""
    spec, name, docs = _label_table(spark, sf)
    results.reset_result_table(spark, name, spec, buckets=8)
    results.write_results(spark, name, docs, spec, "seq")
    return results.read_results(spark, name)


def pending_extractions_stored(spark, sf):
    """Documents without a row in the stored table of labels; only the partitions of their keys are read."""
    spec, name, docs = _label_table(spark, sf)
    pairs = docs.select(*spec.keys)
    return results.pending_extractions(pairs, results.results_near(spark, name, pairs, spec.keys), spec.keys)


# -- streams ---------------------------------------------------------------------------------------------------------


ARRIVALS = 3


def _at_once(source: DataFrame) -> int:
    """Files of one arrival: as many as it takes for a file to hold about what one task reads of the table ``source``."""
    return -(-source.rdd.getNumPartitions() // ARRIVALS)


def _landed(articles: DataFrame, at_once: int) -> str:
    path = stage_path(articles.sparkSession, "landed")
    articles.repartition(ARRIVALS * at_once).write.parquet(path)
    return path


def stream_articles(spark, sf):
    at_once = _at_once(table(spark, sf, "pages"))
    path = _landed(markup.articles_from_markup(pages(spark, sf)), at_once)
    out = stage_path(spark, "streamed")
    stream = streams.stream_articles(spark, path, max_files_per_trigger=at_once)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", stage_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return flat(spark.read.schema(art.ARTICLES).parquet(out))


def stream_search(spark, sf):
    docs, at_once = documents(spark, sf), _at_once(table(spark, sf, "documents"))
    stream = streams.stream_articles(spark, _landed(docs, at_once), docs.schema, max_files_per_trigger=at_once)
    path = stage_path(spark, "stream-hits")
    searched.stream_search(stream, stage(question_search(spark, sf), "terms"), path, stage_path(spark, "stream-state")).awaitTermination()
    return searched.read_hits(spark, path)


def stream_screen(spark, sf):
    spec, name = shared.item_review(), f"review_{uuid.uuid4().hex}"
    results.create_result_table(spark, name, spec, buckets=8, location=stage_path(spark, "result-table"))
    docs = documents(spark, sf).withColumn("format", F.lit(fixed.FORMAT_ABSTRACT))
    found = stage(hits(spark, sf), "hits")
    plan = questions(spark, sf).withColumn("item", F.col("question_id").cast("string"))
    at_once = _at_once(table(spark, sf, "documents"))
    path = _landed(docs, at_once)
    stream = streams.stream_articles(spark, path, docs.schema, max_files_per_trigger=at_once)
    query = streams.stream_screen(
        spark, stream, spec, plan, found, name, answer_by_length(shared.LONG_PROMPT),
        stage_path(spark, "stream-state"), concurrency=8, stem=False,
    )
    query.awaitTermination()
    return results.read_results(spark, name).drop("id")


def stream_resolved(spark, sf):
    """Abstracts a second apart. A third of the full texts lands a day after, a third after the wait is over, a third never.
    One last article far later ends every wait; files come in any order, so all of them are within the lateness."""
    docs, place = documents(spark, sf, doi=True), stage_path(spark, "resolved")
    landed = docs.withColumn("landed_at", F.timestamp_seconds(F.col("article_id")))
    last = spark.range(1).select(
        F.lit(-1).cast("long").alias("article_id"),
        F.lit(None).cast("string").alias("doi"),
        F.array(F.lit("last")).alias("abstract"),
        F.array_repeat(F.struct(F.lit("").alias("title"), F.lit("last").alias("text")), 9).alias("sections"),
        (F.timestamp_seconds(F.lit(0)) + F.expr("INTERVAL 40000 days")).alias("landed_at"),
    )
    third = F.col("article_id") % 3
    after = F.when(third == 0, F.expr("INTERVAL 1 day")).otherwise(F.expr("INTERVAL 30 days"))
    late = landed.filter(third != 2).withColumn("landed_at", F.col("landed_at") + after)
    streamed, at_once = [], _at_once(table(spark, sf, "documents"))
    for rows in (landed, late):
        path = _landed(rows, at_once)
        last.select(*rows.columns).write.mode("append").parquet(path)
        streamed.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * at_once).parquet(path))
    web = stage(markup.articles_from_markup(pages(spark, sf)), "web")
    out = arrivals.stream_resolved(*streamed, web, wait="7 days", lateness="20000 days")
    writer = out.writeStream.format("parquet").option("checkpointLocation", stage_path(spark, "stream-state"))
    writer.trigger(availableNow=True).start(place).awaitTermination()
    found = spark.read.schema(out.schema).parquet(place).filter("article_id >= 0")
    return flat(found, "format").drop("abstract", "sections")


QUERIES = {
    f.__name__: f
    for f in (
        read_articles, sections_from_markup, search_corpus, search_corpus_grid, search_index, map_external_ids, explode_locations, first_valid_candidate,
        pending_fetch, full_text_gate, drop_empty_articles, resolve_articles, journal_articles, resolve_journals, review_from_sources,
        parse_aliases, input_grid, input_grid_sparse, build_search_query, search_terms, format_question, screening_pairs,
        explode_sections, tokenize, remove_stopwords, stem_tokens, section_term_stats, bm25_scores, top_sections,
        top_sections_stemmed, label_sections,
        render_examples, build_prompts, run_extractor, few_shot_prompts, extraction_failures, parse_responses, split_rejects_good, split_rejects_bad,
        expand_allowed_values, cost_summary, cost_summary_small, run_summary,
        project_columns, serialise_record, find_existing, pending_extractions, pending_extractions_overwrite,
        assign_record_ids, upsert_results, upsert_results_overwrite, result_table, reset_result_table, pending_extractions_stored,
        stream_articles, stream_screen, stream_search, stream_resolved,
    )
}

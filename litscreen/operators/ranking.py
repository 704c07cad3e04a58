"""BM25 ranking of an article's own sections against a question.

All statistics are per article: the number of sections, their mean length and in how many of them a term occurs. They
do not depend on the question, so they are computed once per article however many questions found it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litscreen.functions import fixed
from litscreen.functions.scale import held, once, stage
from litscreen.functions.stemming import english_stem
from litscreen.functions.text import ranking_tokens, section_texts, without_stop_words, words


def _texts() -> Column:
    return section_texts(F.col("abstract"), F.col("sections"))


def section_count(articles: DataFrame) -> Column:
    """Number of abstract paragraphs and sections; read from ``n_sections`` where that is stored with the article."""
    stored = "n_sections" in articles.columns
    return F.col("n_sections") if stored else F.size("abstract") + F.size("sections")


def explode_sections(articles: DataFrame) -> DataFrame:
    """Abstract paragraphs, then section texts, numbered from 0."""
    return articles.select("article_id", F.posexplode(_texts()).alias("section_no", "text"))


def tokenize(df: DataFrame, col: str, out: str = "tokens") -> DataFrame:
    """Lower-case words of two or more characters."""
    return df.withColumn(out, words(F.col(col)))


def remove_stopwords(df: DataFrame, col: str = "tokens", stop_words: Sequence[str] = fixed.STOP_WORDS) -> DataFrame:
    return df.withColumn(col, without_stop_words(F.col(col), stop_words))


def stem_tokens(df: DataFrame, col: str, out: str = "stem") -> DataFrame:
    """English stem of each distinct value of ``col``: the vocabulary is stemmed, not every occurrence.

    Words are few bytes but much work, so they are dealt out by number rather than merged into partitions by size.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(col).distinct().repartition(tasks).select(col, once(english_stem(F.col(col))).alias(out))


def question_terms(questions: DataFrame, stem: bool = False) -> DataFrame:
    """``(question_id, term, qtf)``: the question's words as ranked, with how often each occurs."""
    tokens = questions.select("question_id", F.explode(ranking_tokens(F.col("question"))).alias("term"))
    if stem:
        tokens = tokens.withColumn("term", english_stem(F.col("term")))
    return tokens.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _runs(items: Column, key: Callable[[Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """``make(first position, length)`` of each run of equal keys in a sorted array."""
    new = F.transform(items, lambda x, i: F.when((i == 0) | (key(x) != key(F.get(items, i - 1))), i))
    starts = F.filter(new, lambda i: i.isNotNull())

    def lengths(all_starts: Column) -> Column:
        return F.transform(all_starts, lambda at, j: make(at, F.coalesce(F.get(all_starts, j + 1), F.size(items)) - at))

    # The one-element array names the positions, so that they are worked out once.
    return F.transform(F.array(starts), lengths)[0]


def _tokens(articles: DataFrame, min_sections: int) -> DataFrame:
    """``(article_id, n_sections, avgdl, tokens)``: the words of each section. A null paragraph is a section without words."""
    tokens = F.transform(_texts(), lambda t: ranking_tokens(F.coalesce(t, F.lit(""))))
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda n, t: n + F.size(t))
    count = section_count(articles)
    rows = articles.filter(count >= min_sections).select("article_id", count.alias("n_sections"), once(tokens).alias("tokens"))
    return rows.withColumn("avgdl", total / F.col("n_sections"))


def word_counts(articles: DataFrame, min_sections: int = 1) -> DataFrame:
    """``(article_id, n_sections, avgdl, term, places)``: a row per word of an article, with ``(section_no, tf, dl)`` of
    each section that has it.

    Words are sorted and counted inside the article's row, so no occurrence becomes a row and nothing is exchanged.
    """

    def counted(tokens: Column, section_no: Column) -> Column:
        def place(at: Column, length: Column) -> Column:
            tf, dl = length.cast("long").alias("tf"), F.size(tokens).alias("dl")
            return F.struct(F.get(tokens, at).alias("term"), section_no.alias("section_no"), tf, dl)

        return _runs(tokens, lambda t: t, place)

    def with_places(at: Column, length: Column) -> Column:
        places = F.transform(
            F.slice("entries", at + 1, length), lambda e: F.struct(*[e[c].alias(c) for c in ("section_no", "tf", "dl")])
        )
        return F.struct(F.get("entries", at)["term"].alias("term"), places.alias("places"))

    ordered = _tokens(articles, min_sections).withColumn("tokens", once(F.transform("tokens", lambda t: F.sort_array(t))))
    entries = F.sort_array(F.flatten(F.transform("tokens", counted)))
    rows = ordered.select("article_id", "n_sections", "avgdl", once(entries).alias("entries"))
    return rows.select("article_id", "n_sections", "avgdl", F.inline(_runs(F.col("entries"), lambda e: e["term"], with_places)))


def question_word_forms(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, stem)``: the words of ``word_counts`` whose stem a question uses.

    Only the distinct vocabulary is stemmed, and only the few forms a question needs are kept, so the join back onto the
    words is a lookup in a small table.
    """
    stems = terms.select(F.col("term").alias("stem"))
    return stem_tokens(counts, "term").join(stems, "stem", "left_semi").select("term", "stem")


def section_term_stats(
    articles: DataFrame,
    vocabulary: DataFrame | None = None,
    word_forms: DataFrame | None = None,
    min_sections: int = 1,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``(article_id, section_no, term, tf, dl, avgdl, n_sections, df)``.

    ``vocabulary`` (column ``term``) keeps only those words, ``word_forms`` maps words to the stems that replace them;
    both are small tables made ready with ``held``. Lengths always count every word. Without a vocabulary everything is
    counted inside the article's row (``counts``, if that is stored already). With one, words that no question uses are gone
    before anything is sorted or exchanged, and the exchange by article and word is the one the join with the question's
    words needs.
    """
    columns = ["article_id", "section_no", "term", "tf", "dl", "avgdl", "n_sections"]
    if word_forms is not None:
        rows = word_counts(articles, min_sections) if counts is None else counts
        forms = rows.join(word_forms, "term").select(
            "article_id", "n_sections", "avgdl", F.col("stem").alias("term"), F.inline("places")
        )
        wanted = (
            forms.repartition("article_id", "term")
            .groupBy("article_id", "term", "section_no", "dl", "avgdl", "n_sections")
            .agg(F.sum("tf").alias("tf"))
        )
    elif vocabulary is not None:
        found = (
            _tokens(articles, min_sections)
            .select("article_id", "n_sections", "avgdl", F.posexplode("tokens").alias("section_no", "words"))
            .withColumn("dl", F.size("words"))
            .select("article_id", "n_sections", "avgdl", "section_no", "dl", F.explode("words").alias("term"))
        )
        wanted = (
            found.join(vocabulary.select("term"), "term", "left_semi")
            .repartition("article_id", "term")
            .groupBy("article_id", "term", "section_no", "dl", "avgdl", "n_sections")
            .agg(F.count(F.lit(1)).alias("tf"))
        )
    else:
        rows = word_counts(articles, min_sections) if counts is None else counts
        df = F.size("places").cast("long").alias("df")
        return rows.select("article_id", "term", "avgdl", "n_sections", df, F.inline("places")).select(*columns, "df")
    per_term = Window.partitionBy("article_id", "term")
    return wanted.select(*columns, F.count(F.lit(1)).over(per_term).alias("df"))


def bm25_weight() -> Column:
    """Weight of a term in a section, from the columns of ``section_term_stats``."""
    n, df, tf = F.col("n_sections"), F.col("df"), F.col("tf")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    length = 1 - fixed.BM25_B + fixed.BM25_B * F.col("dl") / F.col("avgdl")
    return idf * tf / (tf + fixed.BM25_K1 * length)


# An article found by more questions than this is scored in as many parts as keep each part below it.
PAIRS_PER_PART = 10_000


def _parts(pairs: DataFrame) -> DataFrame | None:
    """``(article_id, n_parts)`` of the articles that very many questions share, or nothing.

    There is at most one such article per ``PAIRS_PER_PART`` pairs, so the table is small by construction.
    """
    counted = pairs.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIRS_PER_PART)
    if counted.isEmpty():
        return None
    return held(counted.select("article_id", F.ceil(F.col("n") / PAIRS_PER_PART).cast("int").alias("n_parts")), "parts")


def _term_scores(stats: DataFrame, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """One score per (pair, section, term).

    A merge join, because neither side has a size known beforehand. Each matching section of an article is repeated for
    every question that found it, so an article many questions share is split: its questions are dealt out to parts by
    a hash, and its few statistics are copied to each part.
    """
    keys = ["article_id", "term"]
    wanted = pairs.select("question_id", "article_id")
    parts = _parts(wanted)
    if parts is not None:
        keys = [*keys, "part"]
        n_parts = F.coalesce("n_parts", F.lit(1))
        dealt = F.pmod(F.xxhash64("question_id"), n_parts).cast("int")
        wanted = wanted.join(parts, "article_id", "left").withColumn("part", dealt).drop("n_parts")
        copies = F.explode(F.sequence(F.lit(0), n_parts - 1))
        stats = stats.join(parts, "article_id", "left").withColumn("part", copies).drop("n_parts")
    return stats.join(wanted.join(terms, "question_id").hint("merge"), keys).select(
        "question_id", "article_id", "section_no", (bm25_weight() * F.col("qtf")).alias("score")
    )


def _rounded_sum() -> Column:
    """Rounded so that the order of additions cannot change a rank."""
    return F.round(F.sum("score"), fixed.SCORE_DIGITS)


def bm25_scores(stats: DataFrame, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(question_id, article_id, section_no, score)`` for every section that shares a term with the question."""
    scores = _term_scores(stats, terms, pairs)
    return scores.groupBy("question_id", "article_id", "section_no").agg(_rounded_sum().alias("score"))


def top_sections(
    stats: DataFrame, terms: DataFrame, sized_pairs: DataFrame, k: int = fixed.TOP_SECTIONS_PER_ARTICLE
) -> DataFrame:
    """``(question_id, article_id, section_no, score, rank)``: the best ``k`` sections of each pair.

    ``stats`` covers the articles with more than ``k`` sections. The others keep all sections in document order,
    unscored. A section without a matching term scores 0 and equal scores keep document order, so at most the first
    ``k`` sections can be needed to fill up with zeros, and only those are added. One exchange by pair serves the sums
    and the window.
    """
    keys = ["question_id", "article_id"]
    first_k = F.sequence(F.lit(0), F.least(F.col("n_sections"), F.lit(k)) - 1)
    zeros = sized_pairs.filter(F.col("n_sections") > 0).select(
        *keys, F.explode(first_k).alias("section_no"), F.lit(0.0).alias("score"), (F.col("n_sections") <= k).alias("whole")
    )
    scored = _term_scores(stats, terms, sized_pairs).withColumn("whole", F.lit(False))
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "section_no")
    return (
        scored.unionByName(zeros)
        .repartition(*keys)
        .groupBy(*keys, "section_no")
        .agg(F.when(~F.bool_or("whole"), _rounded_sum()).alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )


def rank_sections(
    pairs: DataFrame,
    articles: DataFrame,
    questions: DataFrame,
    k: int = fixed.TOP_SECTIONS_PER_ARTICLE,
    stem: bool = True,
) -> DataFrame:
    """Best ``k`` sections of each ``(question_id, article_id)`` of ``pairs``.

    ``pairs`` and ``articles`` are read several times: hand in stored tables, with ``articles`` cut to the pairs.
    """
    terms = held(question_terms(questions, stem), "question-terms")
    if stem:
        counts = stage(word_counts(articles, k + 1), "word-counts")
        forms = held(question_word_forms(counts, terms), "word-forms")
        stats = section_term_stats(articles, word_forms=forms, counts=counts)
    else:
        stats = section_term_stats(articles, vocabulary=terms, min_sections=k + 1)
    sizes = articles.select("article_id", section_count(articles).alias("n_sections"))
    return top_sections(stats, terms, pairs.select("question_id", "article_id").join(sizes, "article_id"), k)


def with_section_text(ranked: DataFrame, articles: DataFrame) -> DataFrame:
    """Put the text beside each ranked section."""
    return ranked.join(explode_sections(articles), ["article_id", "section_no"])


def label_sections(top: DataFrame) -> DataFrame:
    """``(question_id, article_id, sections)``: JSON text ``{"section_1": ..}`` in rank order, at most k entries."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "text")))
    labelled = F.transform(
        entries, lambda e: F.struct(F.concat(F.lit("section_"), e["rank"].cast("string")).alias("k"), e["text"].alias("v"))
    )
    return top.groupBy("question_id", "article_id").agg(F.to_json(F.map_from_entries(labelled)).alias("sections"))

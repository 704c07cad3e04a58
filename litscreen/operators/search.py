"""Boolean search over the corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litscreen.functions import fixed
from litscreen.functions.scale import LOCAL_MAX_ROWS, broadcast_if_small, once, stage
from litscreen.functions.text import paragraph_words, word_runs
from litscreen.operators.planning import normalise_terms


def term_groups(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct groups as ``(group_id, term, n_words)``, and what each question needs as ``(question_id, needs)``.

    A group is known by its set of terms, so values that many questions share, and keywords that all of them share, are
    one group each. ``needs`` lists every group of the question with how often the question names it.
    """
    named = normalise_terms(terms)
    sets = named.groupBy("question_id", "group_no").agg(
        F.sort_array(F.collect_set("term")).alias("terms"), F.max("n_words").alias("most")
    )
    sets = stage(sets.select("question_id", F.md5(F.array_join("terms", "\n")).alias("group_id"), "terms"), "term-groups")
    groups = sets.groupBy("group_id").agg(F.first("terms").alias("terms")).select("group_id", F.explode("terms").alias("term"))
    groups = groups.withColumn("n_words", F.size(F.split("term", " ")))
    needed = sets.groupBy("question_id", "group_id").agg(F.count(F.lit(1)).alias("times"))
    return groups, needed.groupBy("question_id").agg(F.collect_list(F.struct("group_id", "times")).alias("needs"))


def _runs(length: int) -> Callable[[Column], Column]:
    return lambda words: word_runs(words, length)


def _found(asked: Sequence[str], n_words: int) -> Column:
    """Those of the asked terms of that many words that the row's ``paragraphs`` hold, once per occurrence."""
    if n_words == 1:
        return F.filter(F.flatten("paragraphs"), lambda w: w.isin(*asked))
    opening = sorted({t.split(" ")[0] for t in asked})

    def runs(words: Column) -> Column:
        # A run that the paragraph's end cuts short has fewer words than any of these terms.
        begun = F.transform(words, lambda w, i: F.when(w.isin(*opening), F.array_join(F.slice(words, i + 1, n_words), " ")))
        return F.filter(begun, lambda r: r.isin(*asked))

    return F.flatten(F.transform("paragraphs", runs))


def matched_terms(articles: DataFrame, groups: DataFrame) -> DataFrame:
    """``(article_id, terms)``: for each row of ``articles``, the distinct terms of ``groups`` that it holds, if any.

    Up to ``LOCAL_MAX_ROWS`` terms (what people type in) are looked up inside the article's row, so no other word becomes
    a row. More are kept by a checked join.
    """
    asked = groups.select("term", "n_words").distinct().limit(LOCAL_MAX_ROWS + 1).coalesce(1).collect()
    paragraphs = paragraph_words(F.col("abstract"), F.col("sections"))
    rows = articles.select("article_id", paragraphs.alias("paragraphs"))
    nothing = F.array().cast("array<string>")
    if len(asked) <= LOCAL_MAX_ROWS:
        by_length: dict[int, list[str]] = {}
        for term, n_words in asked:
            by_length.setdefault(n_words, []).append(term)
        found = [_found(sorted(terms), n) for n, terms in sorted(by_length.items())]
        rows = rows.select("article_id", once(F.array_distinct(F.concat(nothing, *found))).alias("terms"))
        return rows.filter(F.size("terms") > 0)
    lengths = sorted(r["n_words"] for r in groups.select("n_words").distinct().collect())
    runs = [F.flatten(F.transform("paragraphs", _runs(n))) for n in lengths]
    words = rows.select("article_id", F.explode(F.array_distinct(F.concat(nothing, *runs))).alias("term"))
    kept = words.join(broadcast_if_small(stage(groups.select("term").distinct(), "group-terms")), "term")
    return kept.select("article_id", F.array("term").alias("terms"))


def groups_of_terms(rows: DataFrame, groups: DataFrame, top_n: int | None = None) -> DataFrame:
    """``(article_id, matched)`` from ``(article_id, terms)``, which may name an article in several rows.

    Articles that hold the same terms are equal to every question but for their id. So with ``top_n`` only the first
    ``top_n`` ids of each set of terms go on: any other has ``top_n`` better ones wherever it is found. What very many
    articles hold, such as a few common words, is thereby cut down inside the tasks, before its exchange, and what is done
    per group and per question grows with the different sets of terms, not with the corpus.
    """
    held = rows.groupBy("article_id").agg(F.sort_array(F.flatten(F.collect_list("terms"))).alias("terms"))
    if top_n is not None:
        alike = Window.partitionBy("terms").orderBy("article_id")
        held = held.withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= top_n)
        held = held.repartition("article_id")  # so that only articles move, not each term and group of theirs
    return (
        held.select("article_id", F.explode("terms").alias("term"))
        .join(broadcast_if_small(stage(groups.select("term", "group_id"), "group-terms")), "term")
        .groupBy("article_id", "group_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("article_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("group_id", "n"))).alias("matched"))
    )


def matched_groups(articles: DataFrame, groups: DataFrame, top_n: int | None = None) -> DataFrame:
    """``(article_id, matched)``: for each article, its matching groups with the number of terms that match.

    How many rows come out doesn't depend on the questions, only on the distinct groups. With ``top_n`` only articles come
    out that can be among the best ``top_n`` of a question.
    """
    return groups_of_terms(matched_terms(articles, groups), groups, top_n)


def search_corpus(
    articles: DataFrame, terms: DataFrame, top_n: int = fixed.TOP_ARTICLES_PER_SEARCH
) -> DataFrame:
    """Best ``top_n`` articles per question: ``(question_id, article_id, n_terms, rank)``.

    An article is found when every group of the question has a matching term; a term of several words matches them side
    by side within one paragraph. Articles with more matching terms come first, then the lower article id.

    Articles are matched to distinct terms once, and of those that hold the same terms the first N go on. A question then starts from the articles of its rarest group, and its
    other groups are tested inside the article's row. The corpus itself never shuffles: only ids and the terms found move,
    and the window keeps the best N of each task before its exchange, so a question that matches a third of the corpus
    sends N rows per task.
    """
    groups, needs = term_groups(terms)
    return best_articles(stage(matched_groups(articles, groups, top_n), "matched-groups"), needs, top_n)


def best_articles(matched: DataFrame, needs: DataFrame, top_n: int) -> DataFrame:
    """Best ``top_n`` articles per question, from the groups that articles match and those that questions need."""
    each = matched.select("article_id", "matched", F.explode(F.map_keys("matched")).alias("group_id"))
    spread = each.groupBy("group_id").agg(F.count(F.lit(1)).alias("articles"))
    asked = needs.select("question_id", "needs", F.explode("needs.group_id").alias("group_id")).join(spread, "group_id", "left")
    order = F.struct(F.coalesce("articles", F.lit(0)).alias("articles"), "group_id")
    rarest = asked.groupBy("question_id").agg(F.min(order)["group_id"].alias("group_id"), F.first("needs").alias("needs"))
    found = each.join(broadcast_if_small(stage(rarest, "rarest-groups")), "group_id")
    # Null where a group of the question is missing.
    n_terms = F.aggregate("needs", F.lit(0).cast("long"), lambda n, g: n + g["times"] * F.element_at("matched", g["group_id"]))
    best = Window.partitionBy("question_id").orderBy(F.desc("n_terms"), "article_id")
    return (
        found.select("question_id", "article_id", once(n_terms).alias("n_terms"))
        .filter(F.col("n_terms").isNotNull())
        .select("question_id", "article_id", "n_terms", F.row_number().over(best).alias("rank"))
        .filter(F.col("rank") <= top_n)
    )

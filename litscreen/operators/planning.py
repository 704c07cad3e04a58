"""From input values to questions and searches.

``inputs`` is the dimension table ``(param, pos, name, search_aliases, question_aliases)``: one row per value a user
typed in, ``pos`` counting from 0 within each parameter.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litscreen.functions.scale import broadcast_if_small
from litscreen.functions.text import search_words

ITEM = "struct<name:string,search_aliases:array<string>,question_aliases:array<string>>"


def parse_aliases(items: DataFrame, *alias_cols: str) -> DataFrame:
    """JSON list text to array; empty text or an empty list to null."""
    out = items
    for c in alias_cols:
        parsed = F.from_json(F.nullif(F.trim(F.col(c)), F.lit("")), "array<string>")
        out = out.withColumn(c, F.when(F.size(parsed) > 0, parsed))
    return out


def input_grid(inputs: DataFrame, params: Sequence[str]) -> DataFrame:
    """Every combination of input values, numbered so that the last parameter varies fastest.

    The combination number is counted out by ``range`` and read as one digit per parameter; each digit then looks its
    value up by an equality join, so no Cartesian join is planned however long the lists get. Values are numbered anew in
    the order of ``pos``, so gaps and equal positions lose nothing.
    """
    spark = inputs.sparkSession
    sizes = inputs.filter(F.col("param").isin(*params)).groupBy("param").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["param"]: r["n"] for r in sizes.collect()}
    total = reduce(lambda n, p: n * counts.get(p, 0), params, 1)
    grid, stride = spark.range(total).withColumnRenamed("id", "question_id"), total
    for p in params:
        stride //= max(counts.get(p, 1), 1)
        digit = F.pmod(F.floor(F.col("question_id") / F.lit(max(stride, 1))), F.lit(counts.get(p, 1)))
        order = Window.orderBy("pos", "name")  # the values of one parameter, as a user listed them
        values = inputs.filter(F.col("param") == p).select(
            (F.row_number().over(order) - 1).cast("long").alias("__pos"),
            F.struct("name", "search_aliases", "question_aliases").alias(p),
        )
        grid = grid.withColumn("__pos", digit.cast("long")).join(broadcast_if_small(values), "__pos").drop("__pos")
    return grid.select("question_id", *params)


def _all_names(item: str) -> Column:
    aliases = F.coalesce(F.col(f"{item}.search_aliases"), F.array().cast("array<string>"))
    return F.concat(F.array(F.col(f"{item}.name")), aliases)


def build_search_query(grid: DataFrame, params: Sequence[str], extra_keywords: str = "") -> DataFrame:
    """Add the boolean search text, such as ``(a OR b) AND (c)``."""
    groups = [F.concat(F.lit("("), F.array_join(_all_names(p), " OR "), F.lit(")")) for p in params]
    return grid.withColumn("search_query", F.trim(F.concat_ws(" ", F.concat_ws(" AND ", *groups), F.lit(extra_keywords.strip()))))


def search_terms(grid: DataFrame, params: Sequence[str], extra_groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """The same search as rows ``(question_id, group_no, term)``; extra keyword groups apply to every question."""
    groups = [_all_names(p) for p in params]
    groups += [F.array(*[F.lit(t) for t in g]) for g in extra_groups]
    exploded = grid.select("question_id", F.posexplode(F.array(*groups)).alias("group_no", "terms"))
    return exploded.select("question_id", "group_no", F.explode("terms").alias("term"))


def normalise_terms(terms: DataFrame) -> DataFrame:
    """Terms as lower-case words joined by blanks, once per group, with their number of words."""
    tokens = terms.select("question_id", "group_no", search_words(F.col("term")).alias("w"))
    return (
        tokens.filter(F.size("w") > 0)
        .select("question_id", "group_no", F.array_join("w", " ").alias("term"), F.size("w").alias("n_words"))
        .distinct()
    )


def format_question(grid: DataFrame, template: str, params: Sequence[str], column: str = "question") -> DataFrame:
    """Fill ``{param}`` with ``name (a.k.a x, y)`` or ``name``.

    The template is cut into pieces first and the pieces are joined once, so braces inside a value stay as they are.
    """

    def filled(p: str) -> Column:
        if p not in params:
            raise ValueError(f"the question names {{{p}}}, which is not an input parameter")
        aliases = F.array_join(F.col(f"{p}.question_aliases"), ", ")
        named = F.concat(F.col(f"{p}.name"), F.lit(" (a.k.a "), aliases, F.lit(")"))
        return F.when(F.size(f"{p}.question_aliases") > 0, named).otherwise(F.col(f"{p}.name"))

    pieces: list[Column] = []
    for text, field, _, _ in string.Formatter().parse(template):
        pieces.append(F.lit(text))
        if field is not None:
            pieces.append(filled(field))
    return grid.withColumn(column, F.concat(*pieces))


def screening_pairs(plan: DataFrame, hits: DataFrame, articles: DataFrame) -> DataFrame:
    """The work list: every (question, found article) whose article is there.

    Only ids take part: the article's text stays where it is. ``hits`` holds at most the top N per question, so it is
    the small side against the corpus.
    """
    present = articles.select("article_id").join(
        broadcast_if_small(hits.select("article_id").distinct()), "article_id", "left_semi"
    )
    return hits.join(broadcast_if_small(plan), "question_id").join(present, "article_id")

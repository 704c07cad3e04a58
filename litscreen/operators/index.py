"""A stored index of the corpus: each article is read once, and later searches read only the words they ask for.

The index is a folder of Parquet tables, each cut into one folder per addition:

* ``postings``: ``(word, article_id, positions)``, in ``word_bucket`` folders by a hash of the word;
* ``articles``: the ids that an addition brought, ``replaced``: those of them that were there already;
* ``commits``: a row per addition that is complete. What no commit names is never read.

A position is a paragraph's number times 2^32, plus the word's place in it, so two words stand side by side in one
paragraph if and only if their positions differ by one. One writer at a time.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litscreen.functions import fixed
from litscreen.functions.scale import LOCAL_MAX_ROWS, broadcast_if_small, delete_folder, folder_exists, folders_in, once, stage
from litscreen.functions.text import paragraph_words
from litscreen.operators.search import best_articles, groups_of_terms, term_groups

BUCKETS = 256
BUCKET = "word_bucket"
PARAGRAPH = 1 << 32

_COMMITS = "batch long, base long, buckets int"


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


# -- postings --------------------------------------------------------------------------------------------------------


def postings(articles: DataFrame) -> DataFrame:
    """``(word, article_id, positions)``: one row per article and different word, without an exchange.

    All occurrences of an article are sorted inside its row and cut where the word changes. Only what needs a lambda is
    kept in steps of its own: Spark compiles the others, the sort and the cutting among them.
    """
    rows = articles.select("article_id", once(paragraph_words(F.col("abstract"), F.col("sections"))).alias("paragraphs"))
    first = lambda p: p.cast("long") * F.lit(PARAGRAPH)
    places = F.transform("paragraphs", lambda words, p: F.when(
        F.size(words) > 0, F.sequence(first(p), first(p) + F.size(words) - 1)).otherwise(F.array().cast("array<long>")))
    rows = rows.select("article_id", once(F.struct(
        F.flatten("paragraphs").alias("word"), F.flatten(places).alias("at"))).alias("read"))
    rows = rows.select("article_id", once(F.sort_array(F.arrays_zip("read.word", "read.at"))).alias("found"))
    rows = rows.select("article_id", once(F.struct(
        F.col("found")["word"].alias("words"), F.col("found")["at"].alias("at"))).alias("f"))
    rows = rows.select("article_id", "f.words", "f.at").filter(F.size("words") > 0)
    begins = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("words", i - 1) != F.get("words", i)))
    rows = rows.select("article_id", "words", "at", once(begins).alias("starts"))
    rows = rows.select("article_id", "words", "at", "starts", F.posexplode("starts").alias("n", "s"))
    end = F.coalesce(F.get("starts", F.col("n") + 1), F.size("words"))
    return rows.select(
        F.get("words", F.col("s")).alias("word"), "article_id", F.slice("at", F.col("s") + 1, end - F.col("s")).alias("positions"))


# -- what is stored --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _State:
    """The complete additions that count, oldest first; those before ``base`` were merged into it."""

    batches: tuple[int, ...] = ()
    base: int | None = None
    buckets: int = BUCKETS


def _state(spark: SparkSession, path: str) -> _State:
    if not folder_exists(spark, f"{path}/commits"):
        return _State()
    rows = spark.read.schema(_COMMITS).parquet(f"{path}/commits").collect()  # one row per addition
    if not rows:
        return _State()
    base = max(r["base"] for r in rows)
    return _State(tuple(sorted(r["batch"] for r in rows if r["batch"] >= base)), base, rows[0]["buckets"])


def _commit(spark: SparkSession, path: str, batch: int, base: int, buckets: int) -> None:
    spark.createDataFrame([(batch, base, buckets)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _stored(spark: SparkSession, path: str, name: str, columns: str, state: _State) -> DataFrame:
    """A table of the index, of the additions that count."""
    schema = T.StructType.fromDDL(f"{columns}, batch long")
    folders = [f"{path}/{name}/batch={b}" for b in state.batches]
    folders = [f for f in folders if folder_exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*folders)


def _postings(spark: SparkSession, path: str, state: _State, id_type: str) -> DataFrame:
    return _stored(spark, path, "postings", f"word string, article_id {id_type}, positions array<long>, {BUCKET} int", state)


def _id_type(spark: SparkSession, path: str, state: _State) -> str:
    return spark.read.parquet(f"{path}/articles/batch={state.batches[0]}").schema["article_id"].dataType.simpleString()


def _current(rows: DataFrame, spark: SparkSession, path: str, state: _State, id_type: str) -> DataFrame:
    """Without what a later addition of the same article replaced."""
    later = _stored(spark, path, "replaced", f"article_id {id_type}", state)
    later = later.groupBy("article_id").agg(F.max("batch").alias("newest"))
    if later.isEmpty():
        return rows
    kept = rows.join(broadcast_if_small(stage(later, "replaced")), "article_id", "left")
    return kept.filter(F.col("newest").isNull() | (F.col("batch") >= F.col("newest"))).drop("newest")


def _new_batch(state: _State) -> int:
    """Later than every addition so far; never a number that one which failed may have left files under."""
    return max(int(time.time() * 1e6), max(state.batches, default=0) + 1)


def _write_postings(rows: DataFrame, path: str, batch: int, buckets: int) -> None:
    """One folder per bucket. A bucket that a very frequent word fills is split over tasks, and so over files.

    A file keeps the order of the articles. A search reads whole buckets, so an order by word would gain it nothing.
    """
    spread = rows.withColumn(BUCKET, _bucket(F.col("word"), buckets)).hint("rebalance", BUCKET)
    spread.write.partitionBy(BUCKET).parquet(f"{path}/postings/batch={batch}")


# -- operators -------------------------------------------------------------------------------------------------------


def add_to_index(articles: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Add articles to the index at ``path``, which is made by the first addition, with that many ``buckets``.

    An article that is there already is replaced. Its id must stand once in ``articles``. An addition that fails leaves
    nothing that a search would see, and can be repeated. Null paragraphs have no words, and an article without words is
    known but never found.
    """
    spark = articles.sparkSession
    state = _state(spark, path)
    batch = _new_batch(state)
    buckets = state.buckets if state.batches else buckets
    _write_postings(postings(articles), path, batch, buckets)
    articles.select("article_id").write.parquet(f"{path}/articles/batch={batch}")
    if state.batches:
        id_type = _id_type(spark, path, state)
        known = _stored(spark, path, "articles", f"article_id {id_type}", state).select("article_id")
        arrived = spark.read.parquet(f"{path}/articles/batch={batch}")
        again = stage(arrived.join(known, "article_id", "left_semi"), "known")
        if not again.isEmpty():
            again.write.parquet(f"{path}/replaced/batch={batch}")
    _commit(spark, path, batch, batch if state.base is None else state.base, buckets)


def compact_index(spark: SparkSession, path: str) -> None:
    """Merge all additions into one, without what was replaced, and delete what that leaves unused.

    A search that was planned before must be planned again. A failure at any point leaves an index that is whole.
    """
    state = _state(spark, path)
    if not state.batches:
        return
    batch, id_type = _new_batch(state), _id_type(spark, path, state)
    rows = _current(_postings(spark, path, state, id_type), spark, path, state, id_type)
    _write_postings(rows.select("word", "article_id", "positions"), path, batch, state.buckets)
    known = _stored(spark, path, "articles", f"article_id {id_type}", state)
    known.select("article_id").distinct().write.parquet(f"{path}/articles/batch={batch}")
    _commit(spark, path, batch, batch, state.buckets)
    for name in ("postings", "articles", "replaced"):
        for folder in folders_in(spark, f"{path}/{name}"):
            if folder != f"batch={batch}":
                delete_folder(spark, f"{path}/{name}/{folder}")


def indexed_groups(spark: SparkSession, path: str, groups: DataFrame, top_n: int | None = None) -> DataFrame:
    """What ``matched_groups`` says of the articles, read from the index: ``(article_id, matched)``.

    Only the buckets of words that are asked for are read, and positions only for words of longer terms. A term of one
    word matches wherever the word is listed. The words of all longer ones are brought together by article, each once
    however many terms share it; a term is looked up where its first two words are, the positions of its words moved back by
    their place in it, and what they have in common tells where it begins.
    """
    state = _state(spark, path)
    asked = groups.select("term", "n_words").distinct()
    words = asked.select("term", "n_words", F.posexplode(F.split("term", " ")).alias("place", "word"))
    words = stage(words, "asked-words")
    if not state.batches:
        return spark.createDataFrame([], "article_id long, matched map<string,bigint>")
    id_type = _id_type(spark, path, state)
    rows = _postings(spark, path, state, id_type)

    def listed(some: DataFrame, *columns: str) -> DataFrame:
        buckets = [r[0] for r in some.select(_bucket(F.col("word"), state.buckets)).distinct().collect()]
        found = rows.filter(F.col(BUCKET).isin(buckets)).select("word", "article_id", "batch", *columns)
        few = some.select("word").distinct().limit(LOCAL_MAX_ROWS + 1).coalesce(1).collect()
        if len(few) <= LOCAL_MAX_ROWS:  # a set tells the words that nobody asks for apart at less cost than the join
            found = found.filter(F.col("word").isin([r["word"] for r in few]))
        return _current(found.join(broadcast_if_small(some), "word"), spark, path, state, id_type)

    single = listed(words.filter("n_words = 1").select("term", "word")).select("article_id", "term")
    held = (
        listed(words.filter("n_words > 1").select("word").distinct(), "positions")
        .groupBy("article_id")
        .agg(F.collect_list(F.struct("word", "positions")).alias("held"))
        .select("article_id", "held", F.col("held")["word"].alias("names"))
        .select("article_id", "held", "names", F.explode("held").alias("h"))
        .select("article_id", "held", "names", F.col("h.word").alias("word"), F.col("h.positions").alias("begins"))
    )
    opening = asked.filter("n_words > 1").select("term", "n_words", F.split("term", " ").alias("parts"))
    opening = opening.select("term", "n_words", "parts", F.get("parts", F.lit(0)).alias("word"), F.get("parts", F.lit(1)).alias("second"))

    def places(k: Column) -> Column:
        """Where the term would begin, by its word number ``k``; null if the article doesn't hold that word."""
        return F.transform(F.get(F.filter("held", lambda h: h["word"] == F.get("parts", k)), F.lit(0))["positions"], lambda p: p - k)

    begins = F.aggregate(
        F.sequence(F.lit(1), F.col("n_words") - 1), F.col("begins"), lambda left, k: F.array_intersect(left, places(k)))
    longer = (
        held.join(broadcast_if_small(opening), "word")
        .filter(F.array_contains("names", F.col("second")))
        .select("article_id", "term", once(F.size(begins)).alias("n_begins"))
        .filter("n_begins > 0")
        .select("article_id", "term")
    )
    terms = single.unionByName(longer).select("article_id", F.array("term").alias("terms"))
    return groups_of_terms(terms, groups, top_n)


def search_index(
    spark: SparkSession, path: str, terms: DataFrame, top_n: int = fixed.TOP_ARTICLES_PER_SEARCH
) -> DataFrame:
    """The rows that ``search_corpus`` gives for the indexed articles, without reading them."""
    groups, needs = term_groups(terms)
    groups = stage(groups, "groups")
    return best_articles(stage(indexed_groups(spark, path, groups, top_n), "matched-groups"), needs, top_n)

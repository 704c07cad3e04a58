"""The stored index, and searches that follow a stream, against a search of the whole corpus."""

import pytest

from litscreen.functions import scale
from litscreen.functions.scale import folder_exists, folders_in, stage_path
from litscreen.operators import index, search
from litscreen.sources.articles import ARTICLES
from litscreen.streaming.screening import stream_articles
from litscreen.streaming.search import read_hits, stream_search

TEXTS = {
    1: (["Lidocaine blocks Kv 1.1 currents."], ["More text."]),
    2: (["lidocaine acts"], ["kv", "1.1 is far away"]),
    3: (["Lidocaine on kcna1 and on KV1.1"], []),
    4: (["kcna1 alone"], []),
    5: (["lidocaine alone"], ["and again: lidocaine"]),
    6: ([], []),
    7: (["very good, very very good lidocaine"], ["kcna1 kcna1"]),
    8: (["very", "good lidocaine"], ["1.1 kv"]),
}
TERMS = [
    (7, 0, "kv1.1"), (7, 0, "kv 1.1"), (7, 0, "kcna1"), (7, 1, "lidocaine"), (8, 0, "nowhere"), (9, 0, "LIDOCAINE!"),
    (10, 0, "very good"), (11, 0, "very very good lidocaine"), (12, 0, "alone"), (12, 1, "alone"), (12, 1, "very good lidocaine"),
]


@pytest.fixture
def terms(spark):
    return spark.createDataFrame(TERMS, "question_id long, group_no int, term string")


def rows(df):
    return sorted((r["question_id"], r["rank"], r["article_id"], r["n_terms"]) for r in df.collect())


def some(*ids):
    return {i: TEXTS[i] for i in ids}


def test_postings_hold_every_occurrence(spark, make_articles):
    got = {(r["word"], r["article_id"]): r["positions"] for r in index.postings(make_articles(some(5, 6, 7))).collect()}
    p = index.PARAGRAPH
    assert got == {
        ("lidocaine", 5): [0, p + 2], ("alone", 5): [1], ("and", 5): [p], ("again", 5): [p + 1],
        ("very", 7): [0, 2, 3], ("good", 7): [1, 4], ("lidocaine", 7): [5], ("kcna1", 7): [p, p + 1],
    }


def test_postings_need_no_exchange(spark, make_articles):
    plan = index.postings(make_articles(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_the_sort_of_an_article_is_compiled(make_articles):
    plan = index.postings(make_articles(TEXTS))._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "sort_array" in line]
    assert sorts and all("*(" in line for line in sorts)


def test_words_of_phrases_move_once_however_many_phrases_share_them(spark, make_articles):
    texts = {1: (["a b a c b a b c", "d"], []), 2: (["c d", "b a"], ["a b d"]), 3: (["a", "b"], []), 4: (["b b b c"], [])}
    phrases = ["a b", "a c", "a d", "b a", "a b a", "a b c", "b b", "b b c", "b b b b", "a b d", "b c d", "a b a c b a b c"]
    asked = spark.createDataFrame([(i, 0, t) for i, t in enumerate(phrases)], "question_id long, group_no int, term string")
    path = stage_path(spark, "index")
    index.add_to_index(make_articles(texts), path, buckets=4)
    groups, _ = search.term_groups(asked)
    plan = index.indexed_groups(spark, path, groups)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(article_id" in line]
    assert moved and not any(", term#" in line for line in moved)
    assert rows(index.search_index(spark, path, asked)) == rows(search.search_corpus(make_articles(texts), asked))
    found = {(r["question_id"], r["article_id"]) for r in index.search_index(spark, path, asked).collect()}
    assert found == {(i, a) for i, t in enumerate(phrases) for a, (p, s) in texts.items() if any(f" {t} " in f" {x} " for x in p + s)}


def test_words_that_nobody_asks_for_are_dropped_before_the_join(spark, make_articles, terms, monkeypatch):
    path = stage_path(spark, "index")
    index.add_to_index(make_articles(TEXTS), path, buckets=4)
    groups, _ = search.term_groups(terms)

    def dropped():
        return "In(word, [" in index.indexed_groups(spark, path, groups)._jdf.queryExecution().executedPlan().toString()

    assert dropped()
    monkeypatch.setattr(index, "LOCAL_MAX_ROWS", 2)
    assert not dropped()
    assert rows(index.search_index(spark, path, terms)) == rows(search.search_corpus(make_articles(TEXTS), terms))


def test_index_gives_what_a_search_of_the_corpus_gives(spark, make_articles, terms):
    path = stage_path(spark, "index")
    index.add_to_index(make_articles(some(1, 2, 3, 6)), path, buckets=4)
    index.add_to_index(make_articles(some(4, 5, 7, 8)), path)
    for n in (1, 10):
        assert rows(index.search_index(spark, path, terms, n)) == rows(search.search_corpus(make_articles(TEXTS), terms, n))


def test_large_sides_are_not_broadcast_and_give_the_same(spark, make_articles, terms, monkeypatch):
    monkeypatch.setattr(scale, "fits_broadcast", lambda *_: False)
    path = stage_path(spark, "index")
    index.add_to_index(make_articles(TEXTS), path, buckets=4)
    index.add_to_index(make_articles(some(3, 7)), path)
    assert rows(index.search_index(spark, path, terms)) == rows(search.search_corpus(make_articles(TEXTS), terms))


def test_an_article_that_arrives_again_replaces_itself(spark, make_articles, terms):
    path = stage_path(spark, "index")
    index.add_to_index(make_articles(TEXTS), path, buckets=4)
    index.add_to_index(make_articles({3: (["kcna1 only"], []), 4: (["lidocaine kcna1"], []), 5: ([], [])}), path)
    now = TEXTS | {3: (["lidocaine, alone"], []), 4: (["lidocaine kcna1"], []), 5: ([], [])}
    index.add_to_index(make_articles({3: now[3]}), path)
    expected = rows(search.search_corpus(make_articles(now), terms))
    assert rows(index.search_index(spark, path, terms)) == expected
    index.compact_index(spark, path)
    assert rows(index.search_index(spark, path, terms)) == expected
    index.add_to_index(make_articles({3: TEXTS[3], 4: TEXTS[4], 5: TEXTS[5]}), path)
    assert rows(index.search_index(spark, path, terms)) == rows(search.search_corpus(make_articles(TEXTS), terms))


def test_compaction_bounds_the_files(spark, make_articles, terms):
    path = stage_path(spark, "index")
    for i in TEXTS:
        index.add_to_index(make_articles(some(i)), path, buckets=2)
    assert len(folders_in(spark, f"{path}/postings")) == len(TEXTS)
    index.compact_index(spark, path)
    (batch,) = folders_in(spark, f"{path}/postings")
    assert len(folders_in(spark, f"{path}/postings/{batch}")) == 2 and not folders_in(spark, f"{path}/replaced")
    assert len(spark.read.parquet(f"{path}/postings").inputFiles()) <= 4
    assert rows(index.search_index(spark, path, terms)) == rows(search.search_corpus(make_articles(TEXTS), terms))


def test_an_addition_that_fails_is_not_seen(spark, make_articles, terms, monkeypatch):
    path = stage_path(spark, "index")
    index.add_to_index(make_articles(some(1, 2, 3, 4)), path, buckets=4)
    before = rows(index.search_index(spark, path, terms))

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(index, "_commit", broken)
        for fails in (lambda: index.add_to_index(make_articles(some(5, 6, 7, 8)), path), lambda: index.compact_index(spark, path)):
            with pytest.raises(OSError):
                fails()
    assert rows(index.search_index(spark, path, terms)) == before
    index.add_to_index(make_articles(some(5, 6, 7, 8)), path)
    index.compact_index(spark, path)
    assert rows(index.search_index(spark, path, terms)) == rows(search.search_corpus(make_articles(TEXTS), terms))


def test_a_search_reads_the_buckets_of_its_words_alone(spark, make_articles, terms):
    path = stage_path(spark, "index")
    index.add_to_index(make_articles(TEXTS), path, buckets=16)
    groups, _ = search.term_groups(terms.filter("question_id = 9"))
    found = index.indexed_groups(spark, path, groups)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "word_bucket IN" in plan.replace("#", " #").replace("word_bucket  #", "word_bucket#") or "PartitionFilters: [" in plan
    assert "positions" not in plan.split("Union")[0]
    assert all("/postings/" in f or "litscreen-stage" in f for f in found.inputFiles())
    asked = {f.split("word_bucket=")[1].split("/")[0] for f in found.inputFiles() if "word_bucket=" in f}
    assert found.count() == 6 and asked


def test_empty_tables(spark, make_articles, terms):
    path = stage_path(spark, "index")
    assert rows(index.search_index(spark, path, terms)) == []
    index.compact_index(spark, path)
    assert not folder_exists(spark, path)
    index.add_to_index(spark.createDataFrame([], ARTICLES), path, buckets=4)
    assert rows(index.search_index(spark, path, terms)) == []
    index.add_to_index(make_articles(some(3, 6)), path)
    assert rows(index.search_index(spark, path, terms.limit(0))) == []
    assert rows(index.search_index(spark, path, terms)) == rows(search.search_corpus(make_articles(some(3, 6)), terms))


def test_a_null_paragraph_has_no_words(spark, terms):
    articles = spark.createDataFrame([(1, None, [None, "kcna1 and lidocaine"], [("", None), ("", "alone")])], ARTICLES)
    path = stage_path(spark, "index")
    index.add_to_index(articles, path, buckets=4)
    expected = [(7, 1, 1, 2), (9, 1, 1, 1), (12, 1, 1, 2)]
    assert rows(search.search_corpus(articles, terms)) == rows(index.search_index(spark, path, terms)) == expected


# -- streams ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("files", [[[1, 2, 3, 4, 5, 6, 7, 8]], [[5, 8], [2, 6], [1, 3, 7], [4]], [[8], [7], [6], [5], [4], [3], [2], [1]]])
def test_stream_keeps_the_best_whatever_the_files(spark, make_articles, terms, files):
    landed, path, state = (stage_path(spark, n) for n in ("landed", "hits", "state"))
    for ids in files:
        make_articles(some(*ids)).coalesce(1).write.mode("append").parquet(landed)
    stream = stream_articles(spark, landed, max_files_per_trigger=1)
    stream_search(stream, terms, path, state, top_n=2).awaitTermination()
    assert rows(read_hits(spark, path)) == rows(search.search_corpus(make_articles(TEXTS), terms, 2))
    assert len(folders_in(spark, path)) <= 2


def test_stream_goes_on_and_survives_an_unfinished_state(spark, make_articles, terms):
    landed, path, state = (stage_path(spark, n) for n in ("landed", "hits", "state"))

    def run():
        stream_search(stream_articles(spark, landed, ARTICLES), terms, path, state, top_n=2).awaitTermination()
        return rows(read_hits(spark, path))

    make_articles(some(5, 8, 2)).write.parquet(landed)
    assert run() == rows(search.search_corpus(make_articles(some(5, 8, 2)), terms, 2))
    # A job that died while it wrote the next state: files, but no success mark.
    spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=1")
    assert run() == rows(search.search_corpus(make_articles(some(5, 8, 2)), terms, 2))
    make_articles(some(1, 3, 4, 6, 7)).write.mode("append").parquet(landed)
    assert run() == rows(search.search_corpus(make_articles(TEXTS), terms, 2))
    with pytest.raises(ValueError):
        read_hits(spark, stage_path(spark, "nothing"))


def test_two_runs_in_one_driver_delete_only_their_own_tables(spark):
    import threading

    inside, done = threading.Event(), threading.Event()
    kept = {}

    def other():
        with scale.stages_dropped(spark):
            inside.set()
            done.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    kept["table"] = scale.stage(spark.range(3), "kept")
    done.set()
    thread.join()
    assert kept["table"].count() == 3

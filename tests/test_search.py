import pytest

from litscreen.functions import scale
from litscreen.operators import search

TEXTS = {
    1: (["Lidocaine blocks Kv 1.1 currents."], ["More text."]),
    2: (["lidocaine acts"], ["kv", "1.1 is far away"]),
    3: (["Lidocaine on kcna1 and on KV1.1"], []),
    4: (["kcna1 alone"], []),
    5: (["lidocaine alone"], ["and again: lidocaine"]),
    6: ([], []),
}
TERMS = [(7, 0, "kv1.1"), (7, 0, "kv 1.1"), (7, 0, "kcna1"), (7, 1, "lidocaine"), (8, 0, "nowhere"), (9, 0, "LIDOCAINE!")]


@pytest.fixture
def found(spark, make_articles):
    terms = spark.createDataFrame(TERMS, "question_id long, group_no int, term string")

    def run(top_n=10):
        rows = search.search_corpus(make_articles(TEXTS), terms, top_n).collect()
        return sorted((r["question_id"], r["rank"], r["article_id"], r["n_terms"]) for r in rows)

    return run


# A phrase must stand within one paragraph (2 is out); more matching terms rank first, then the lower id.
EXPECTED = [(7, 1, 3, 3), (7, 2, 1, 2), (9, 1, 1, 1), (9, 2, 2, 1), (9, 3, 3, 1), (9, 4, 5, 1)]


def test_groups_phrases_and_order(found):
    assert found() == EXPECTED


def test_best_n(found):
    assert found(1) == [(7, 1, 3, 3), (9, 1, 1, 1)]


def test_terms_too_large_to_broadcast_give_the_same(found, monkeypatch):
    monkeypatch.setattr(scale, "fits_broadcast", lambda *_: False)
    assert found() == EXPECTED


def test_rows_do_not_grow_with_the_questions(spark, make_articles):
    """Questions that share their groups are matched to the articles once."""
    texts = make_articles(TEXTS)

    def matched(n):
        terms = [(q, g, t) for q in range(n) for g, t in ((0, "lidocaine"), (1, "kcna1"))]
        groups, needs = search.term_groups(spark.createDataFrame(terms, "question_id long, group_no int, term string"))
        assert needs.count() == n
        return groups.count(), search.matched_groups(texts, groups).selectExpr("sum(size(matched))").first()[0]

    assert matched(2) == matched(400) == (2, 6)


def test_a_group_named_twice_counts_twice(spark, make_articles):
    terms = spark.createDataFrame([(1, 0, "kcna1"), (1, 1, "kcna1"), (2, 0, "kcna1")], "question_id long, group_no int, term string")
    rows = search.search_corpus(make_articles(TEXTS), terms, 1).collect()
    assert sorted((r["question_id"], r["article_id"], r["n_terms"]) for r in rows) == [(1, 3, 2), (2, 3, 1)]


def test_articles_that_hold_the_same_terms_are_cut_to_the_best_n(spark, make_articles, monkeypatch):
    """What a question does with common words grows with the different sets of terms, not with the articles."""
    texts = {i: (["the que of that" if i % 3 else "the of that that"], ["Of the kv 1.1 kind."] if i % 10 == 0 else []) for i in range(60)}
    asked = [(q, g, t) for q in range(4) for g, t in ((0, "the"), (0, "kv 1.1" if q % 2 else "que"), (1, "of the"), (1, "that"))]
    terms = spark.createDataFrame(asked, "question_id long, group_no int, term string")
    articles = make_articles(texts)
    groups, _ = search.term_groups(terms)
    assert search.matched_groups(articles, groups, 2).count() == 8  # four sets of terms

    def best():
        return sorted((r["question_id"], r["rank"], r["article_id"], r["n_terms"]) for r in search.search_corpus(articles, terms, 2).collect())

    # Article 0 holds no "que", article 10 every term.
    even, odd = [(1, 10, 4), (2, 20, 4)], [(1, 0, 4), (2, 10, 4)]
    assert best() == [(q, *r) for q in range(4) for r in (odd if q % 2 else even)]
    monkeypatch.setattr(search, "LOCAL_MAX_ROWS", 0)  # terms too many to look up in the row
    assert best() == [(q, *r) for q in range(4) for r in (odd if q % 2 else even)]

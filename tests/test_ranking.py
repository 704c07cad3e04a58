"""Ranking against a brute-force computation."""

import json
import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litscreen.functions import fixed
from litscreen.functions.stemming import english_stem
from litscreen.operators import ranking
from litscreen.plans import screening

K = 3


def tokens(text):
    return [t for t in re.findall(r"(?u)\b\w\w+\b", text.lower()) if t not in fixed.STOP_WORDS]


def best(texts, question, k, stem=lambda t: t):
    """[(section number, rounded score or None)] in rank order."""
    if len(texts) <= k:
        return [(i, None) for i in range(len(texts))]
    docs = [[stem(t) for t in tokens(x)] for x in texts]
    mean = sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    scores = []
    for d in docs:
        score = 0.0
        for q in map(stem, tokens(question)):
            tf = d.count(q)
            if tf:
                idf = math.log(1 + (len(docs) - df[q] + 0.5) / (df[q] + 0.5))
                score += idf * tf / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
        scores.append(round(score, 6))
    order = sorted(range(len(docs)), key=lambda i: (-scores[i], i))[:k]
    return [(i, scores[i]) for i in order]


def ours(spark, make_articles, texts, questions, stem=False, k=K):
    articles = make_articles(texts)
    asked = spark.createDataFrame(list(questions.items()), "question_id long, question string")
    pairs = spark.createDataFrame([(q, a) for q in questions for a in texts], "question_id long, article_id long")
    rows = ranking.rank_sections(pairs, articles, asked, k, stem).collect()
    out = {(q, a): [] for q in questions for a in texts}
    for r in sorted(rows, key=lambda r: r["rank"]):
        assert r["rank"] == len(out[r["question_id"], r["article_id"]]) + 1
        out[r["question_id"], r["article_id"]].append((r["section_no"], r["score"]))
    return out


TEXTS = {
    1: (["Cells were treated with the drug."], ["The drug blocks the channel.", "Mice ran.", "Channel channel drug!", "None"]),
    2: (["one"], ["two", "three"]),  # exactly k
    3: (["alpha"], ["beta", "gamma", "delta"]),  # k + 1, nothing matches
    4: ([], ["drug"]),
    5: ([], []),
    6: (["of the and"], ["to", "is", "was"]),  # only stop words
    7: (["Kneading knives"], ["kneaded knife", "channels", "the channel kneads", "drugs drugged"]),
}
QUESTIONS = {0: "Does the drug block the channel? Drug!", 1: "", 2: "kneading of channels and drugs"}


def all_texts(article):
    return [*article[0], *article[1]]


def close(found, expected):
    assert [i for i, _ in found] == [i for i, _ in expected]
    for (_, score), (_, wanted) in zip(found, expected):
        assert score is None if wanted is None else score == pytest.approx(wanted, abs=2e-6)


@pytest.mark.parametrize("stemmed", [False, True])
def test_against_brute_force(spark, make_articles, stemmed):
    words = sorted({t for a in TEXTS.values() for x in all_texts(a) for t in tokens(x)}
                   | {t for q in QUESTIONS.values() for t in tokens(q)})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", english_stem(F.col("w")).alias("s")).collect()
    stems = {r["w"]: r["s"] for r in rows}
    stem = stems.__getitem__ if stemmed else (lambda t: t)
    found = ours(spark, make_articles, TEXTS, QUESTIONS, stemmed)
    for (q, a), got in found.items():
        close(got, best(all_texts(TEXTS[a]), QUESTIONS[q], K, stem))


sections = st.lists(st.lists(st.sampled_from("drug channel cell mice the of x kv1".split()), max_size=8).map(" ".join), max_size=7)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(corpus=st.lists(sections, min_size=1, max_size=12), question=sections.map(" ".join))
def test_random_articles(spark, make_articles, corpus, question):
    texts = {i: (s[:1], s[1:]) for i, s in enumerate(corpus)}
    found = ours(spark, make_articles, texts, {0: question})
    for (_, a), got in found.items():
        close(got, best(all_texts(texts[a]), question, K))


@pytest.mark.parametrize("pairs_per_part", [10_000, 7])
def test_one_article_found_by_every_question(spark, make_articles, monkeypatch, pairs_per_part):
    """A hot article: the ranking of each pair is that of the pair alone, in one part or in many."""
    monkeypatch.setattr(ranking, "PAIRS_PER_PART", pairs_per_part)
    questions = {q: f"drug channel word{q % 7}" for q in range(300)}
    found = ours(spark, make_articles, {1: TEXTS[1]}, questions)
    for q, text in questions.items():
        close(found[q, 1], best(all_texts(TEXTS[1]), text, K))


def test_labels_follow_the_rank(spark, make_articles):
    articles = make_articles({1: TEXTS[1], 2: TEXTS[2]})
    pairs = spark.createDataFrame([(0, 1, "drug channel"), (0, 2, "drug")], "question_id long, article_id long, question string")
    stored = screening.cut_to_pairs(articles, pairs)
    rows = {r["article_id"]: r["sections"] for r in screening.ranked_evidence(pairs, stored, K, stem=False).collect()}
    assert rows[2] == '{"section_1":"one","section_2":"two","section_3":"three"}'
    assert list(json.loads(rows[1])) == ["section_1", "section_2", "section_3"]
    assert rows[1].startswith('{"section_1":"Channel channel drug!"')


@pytest.mark.parametrize("how", ["whole", "vocabulary", "stems"])
def test_statistics_of_any_article(spark, make_articles, how):
    """Null and empty paragraphs are sections without words; an article without any section has no statistics."""
    texts = {1: (["red red blue"], [None, "", "blue green red", "green"]), 2: ([], []), 3: ([None], [None]), 4: (["red"], [])}
    articles = make_articles(texts)
    named = spark.createDataFrame([("red",), ("green",)], "term string")
    if how == "whole":
        stats = ranking.section_term_stats(articles)
    elif how == "vocabulary":
        stats = ranking.section_term_stats(articles, vocabulary=named)
    else:
        forms = spark.createDataFrame([("red", "colour"), ("blue", "colour")], "term string, stem string")
        stats = ranking.section_term_stats(articles, word_forms=forms)
    columns = ["article_id", "section_no", "term", "tf", "dl", "avgdl", "n_sections", "df"]
    assert stats.columns == columns
    rows = sorted(map(tuple, stats.collect()))
    mean = 7 / 5
    want = {
        "whole": [
            (1, 0, "blue", 1, 3, mean, 5, 2), (1, 0, "red", 2, 3, mean, 5, 2), (1, 3, "blue", 1, 3, mean, 5, 2),
            (1, 3, "green", 1, 3, mean, 5, 2), (1, 3, "red", 1, 3, mean, 5, 2), (1, 4, "green", 1, 1, mean, 5, 2),
            (4, 0, "red", 1, 1, 1.0, 1, 1),
        ],
        "stems": [(1, 0, "colour", 3, 3, mean, 5, 2), (1, 3, "colour", 2, 3, mean, 5, 2), (4, 0, "colour", 1, 1, 1.0, 1, 1)],
    }
    want["vocabulary"] = [r for r in want["whole"] if r[2] != "blue"]
    assert rows == want[how]

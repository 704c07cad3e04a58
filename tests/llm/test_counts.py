"""Phrases, language model and hard negatives against brute force, and the cases that every operator meets."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litscreen.llm import language_model, negatives, phrases
from litscreen.llm.common import table

SF = "/root/testdata/sf0.001"
CLASHES = ("n", "f", "k", "w", "phrase", "score", "rank", "kind", "chunk", "part", "slot", "anchor", "x", "id", "a", "row")


def clashing(df):
    return df.withColumns({c: F.lit("old") for c in CLASHES if c not in df.columns})


# ---------------------------------------------------------------- phrases

TEXTS = [
    ("en", "New York, New York! The new york\ttimes; of New  York. New York City new york"), ("en", None), (None, "und und und. und und"), ("de", ""),
    ("en", "New York times new york times of the day"), ("en", "New York times new york times of the day"), ("und", "und, und und"),
    ("fr", "été été été \U0001f600 \U0001f600 \x85 \x85"), ("x y", "a b a b a b a b a b"), ("", "a b a b a b"),
]


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("held, burst, bits", [(600_000, 8192, 1 << 26), (5, 2, 1 << 15), (40, 3, 1 << 16)])
def test_phrases_equal_brute_force(spark, held, burst, bits):
    rng = random.Random(held)
    words = [f"w{int(rng.paretovariate(0.6)) % 40}" for _ in range(3000)]
    docs = TEXTS + [(rng.choice(["en", "de"]), " ".join(words[i : i + 60]) + rng.choice([".", "\n", ""])) for i in range(0, 3000, 50)]
    df = clashing(spark.createDataFrame([(x, t) for x, t in docs], "lang string, text string"))
    got = found(phrases.collocations(df, least=3, best=25, held=held, burst=burst, bits=bits))
    assert got == sorted(phrases.brute_force(docs, least=3, best=25))
    assert {r[0] for r in got} >= {"en", "und", "x y", ""}


def test_phrases_on_documents(spark):
    docs = [(r["lang"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = found(phrases.collocations(table(spark, SF, "documents"), least=5))
    assert got == sorted(phrases.brute_force(docs, least=5)) and len(got) > 100


def test_runs_travel_as_one_row_per_range(spark):
    rng = random.Random(8)
    docs = [(lang, " ".join(f"{lang}{rng.randrange(40)}" for _ in range(300)) + ".") for lang in ("a", "b", "a\u00e9") for _ in range(20)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    ends = phrases.range_ends([(lang, t.encode()) for lang, t in docs[:25]], (2,), None, 16)  # one language is not in the sample
    runs = phrases.phrase_runs(df, (2,), ends, held=500)
    different = len({(lang, p) for lang, t in docs for p in zip(t[:-1].split(), t[:-1].split()[1:], strict=False)})
    assert 1 < len(ends) < 16 and runs.count() < different / 10
    got = phrases.merged(runs, 5).collect()
    want = {}
    for lang, t in docs:
        w = t[:-1].split()
        for x, y in zip(w, w[1:], strict=False):
            want[lang, f"{x} {y}"] = want.get((lang, f"{x} {y}"), 0) + 1
    assert sorted((r["lang"], r["phrase"], r["f"]) for r in got if r["k"]) == sorted((*p, f) for p, f in want.items() if f >= 5)
    assert sum(r["f"] for r in got if not r["k"]) == sum(want.values())


def test_ranges_are_cut_by_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SAMPLED", 20)
    df = spark.range(4000).select(F.lit("en").alias("lang"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    assert 1 <= len(phrases.sample_texts(df)) <= 40
    copies = spark.range(400).select(F.lit("en").alias("lang"), F.lit("x" * 5000).alias("text"))
    assert all(len(t) == 2000 for _, t in phrases.sample_texts(copies)) and len(phrases.sample_texts(copies)) <= 40


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 6 * 10**15
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, k int, f long")
    totals = spark.createDataFrame([("en", 2 * big)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: (counts, totals))
    row = phrases.collocations(spark.createDataFrame([], "lang string, text string")).first()
    assert row["score"] == 2_000_000 * (big - 7) // (2 * big + 1) and row["a"] == big - 7


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(0, 4)), max_size=20), max_size=6), st.integers(1, 6), st.integers(0, 30))
def test_trie_keeps_every_count(rounds, burst, leave):
    trie, want, got = phrases.Trie(3, burst), {}, {}
    for grams in [*rounds, []]:
        rests = [(b << phrases.WORD) | c for _, b, c in grams]
        for key in zip([g[0] for g in grams], rests, strict=True):
            want[key] = want.get(key, 0) + 1
        if grams:
            trie.add(*phrases.folded(np.array([g[0] for g in grams]), np.array(rests, np.int64), 3))
        assert trie.size == sum(trie.sizes.values()) == sum(len(f) for r in trie.roots.values() for _, f in r.walk())
        for first, rest, n in zip(*map(np.ndarray.tolist, trie.spill(leave if len(grams) else 0)), strict=True):
            got[first, rest] = got.get((first, rest), 0) + n
        assert trie.size <= leave
    assert got == want and not trie.roots


def test_containers_burst_by_the_next_word():
    trie = phrases.Trie(3, 8)
    trie.add(np.ones(60, np.int64), np.array([(i // 10 << phrases.WORD) | i for i in range(60)], np.int64), np.ones(60, np.int64))
    root = trie.roots[1]
    assert root.found is None and len(root.below) == 6 and all(len(n.found) == 10 for n in root.below.values())


def test_no_task_holds_more_than_it_may():
    counter = phrases.Counter((2,), None, 1000, 16, at_once=101)
    rng, most, total = random.Random(1), 0, 0
    for _ in range(60):
        counter.add("en", " ".join(f"w{rng.randrange(300)}" for _ in range(101)).encode())
        total += sum(int(n.sum()) for *_, n in counter.spilled())
        most = max(most, sum(t.size for t in counter.tries.values()))
    total += sum(int(n.sum()) for *_, n in counter.spilled(everything=True))
    assert most <= 1100 and total == 6000


def test_runs_are_sorted_and_words_can_be_forgotten(monkeypatch):
    monkeypatch.setattr(phrases, "NAMES_HELD", 2000)
    counter = phrases.Counter((1,), None, 10**6, 16)
    total: dict = {}
    for i in range(40):
        counter.add("en", f"x{i} y{i} common\ncommon".encode())
        for _, _, run, times in counter.spilled(everything=i == 39):
            run = run.to_pylist()
            assert run == sorted(run)
            for p, n in zip(run, times.tolist(), strict=True):
                total[p] = total.get(p, 0) + n
    assert total["common"] == 80 and len(total) == 81


# ---------------------------------------------------------------- language model


def scored(df, **options):
    out = {}
    for r in language_model.score_texts(df, **options).collect():
        out.setdefault(r["doc_id"], []).append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
    return out


def close(a, b):
    return a[:4] == b[:4] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[4:], b[4:], strict=True))


@pytest.mark.parametrize("order, size", [(2, 16 << 20), (2, 300), (3, 16 << 20), (4, 900)])
def test_language_model_equals_brute_force(spark, monkeypatch, order, size):
    monkeypatch.setattr(language_model, "PART_BYTES", size)
    rng = random.Random(order)
    docs = [(i, " ".join(f"W{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "ÄÖ ÄÖ   　"), (1004, "w1 " * 3000)]
    got = scored(clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).cache(), order=order)
    want = language_model.brute_force(docs, order)
    assert got.keys() == want.keys()
    assert all(close(got[d][0], want[d]) for d in want)


def test_language_model_on_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got, want = scored(table(spark, SF, "documents")), language_model.brute_force(docs)
    assert all(close(got[d][0], want[d]) for d in want) and len(got) == len(docs)
    held = [v[0] for v in got.values() if v[0][0]]
    assert sum(v[5] for v in held) > sum(v[4] for v in held)  # better than word counts on texts it has not seen


def test_chunks_are_bounded_and_keep_all(spark, monkeypatch):
    rows = [(i, f"a{i} b c") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", language_model._kinds("doc_id"))
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 40)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(df.toPandas(), preserve_index=False)
    chunks = [(k, c) for k, c in language_model._chunks(iter([batch]))]
    assert sorted(d for _, c in chunks for d in c.docs) == list(range(50))
    assert all(c.bytes <= 48 for _, c in chunks) and len(chunks) > 8


def test_language_model_edges(spark):
    rows = [(None, "a b"), (None, None), (7, "a b c"), (7, "a b c"), (8, "x")]
    got = scored(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(got[7]) == 2 and got[7][0] == got[7][1] and [v[0] for v in got[None]] == [False, False]
    assert language_model.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # Only held-out documents: nothing is known, and every score is finite.
    held = [i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 7 == 2]
    only = scored(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string"))
    assert all(v[0][:5] == (True, 3, 0, 0, 0.0) and math.isfinite(v[0][5]) for v in only.values())


def test_probabilities_sum_to_one(spark):
    docs = [(i, " ".join(f"w{(i * j) % 5}" for j in range(8))) for i in range(40)]
    base = [d for d in docs if __import__("zlib").crc32(str(d[0]).encode()) % 7 != 2]
    # Every continuation of one context, the end and one unknown word among them, as held-out documents.
    held = iter(i for i in range(1000, 9000) if __import__("zlib").crc32(str(i).encode()) % 7 == 2)
    ends = {next(held): w for w in ["w0", "w1", "w2", "w3", "w4", "never"]}
    empty = next(held)
    got = scored(spark.createDataFrame(base + list(ends.items()) + [(empty, "")], "doc_id long, text string"))
    want = language_model.brute_force(base + list(ends.items()) + [(empty, "")])
    assert all(close(got[d][0], want[d]) for d in want)
    first = 10 ** got[empty][0][5]
    assert 0 < first < 1


# ---------------------------------------------------------------- hard negatives


def mined(df, **options):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect())


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("part_bytes, step", [(16 << 20, 512), (400, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, part_bytes, step):
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", step)
    rng = random.Random(step)
    rows = [(i, rng.randrange(3), [rng.choice([-0.5, 0.0, 0.25, 0.5, 0.75, 1.0]) for _ in range(rng.choice([3, 3, 3, 4]))]) for i in range(400)]
    rows += rows[:20] + [(401, None, [1.0, 1.0, 1.0]), (402, 1, None), (403, 1, [1.0, None, 1.0]), (404, 1, [float("nan"), 1.0, 1.0])]
    rows += [(405, 1, [float("inf"), 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (406, 1, []), (450, 1, []), (50, 2, [0.5, 0.5, 0.5])]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = mined(df, part_bytes=part_bytes)
    assert got == sorted(negatives.brute_force(rows, lambda i: i % 50 == 0)) and len(got) > 30


def test_negatives_on_embeddings(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    assert mined(table(spark, SF, "embeddings")) == sorted(negatives.brute_force(rows, lambda i: i % 50 == 0))


def test_negatives_of_large_components(spark):
    rows = [(0, 0, [3e6, 1.0]), (1, 1, [3e6, 0.0]), (2, 1, [2e6, 0.5]), (3, 1, [1.9e6, -1.0]), (4, 0, [2.5e6, 0.0]), (5, 1, [2.0e6, 0.25])]
    assert mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")) == sorted(negatives.brute_force(rows, lambda i: i % 50 == 0))


def test_negatives_of_nothing(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, 1, [1.0])], SCHEMA)) == []
    assert mined(spark.createDataFrame([(50, 1, [1.0]), (51, 1, [1.0])], SCHEMA)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-9, 9), st.integers(0, 20)), max_size=80), st.integers(1, 4), st.integers(1, 9))
def test_combiner_keeps_the_first(rows, k, step):
    best = negatives.Best(4, k)
    for i in range(0, len(rows), step):
        part = np.array(rows[i : i + step], np.int64).reshape(-1, 3)
        part = part[part[:, 1] >= best.least[part[:, 0]]]
        best.add(part[:, 0], part[:, 1], part[:, 2])
    want = [(g, s, i) for g in range(4) for s, i in sorted({(-s, i) for h, s, i in rows if h == g})[:k]]
    assert list(zip(best.group.tolist(), (-best.score).tolist(), best.id.tolist(), strict=True)) == want

from pyspark.sql import functions as F

from litscreen.operators import planning
from litscreen.spec import ReviewSpec
from tests.test_spec import SETTINGS


def grid(spark):
    spec = ReviewSpec.from_dict(SETTINGS)
    return spec, planning.input_grid(spec.input_rows(spark), spec.params)


def test_combinations_vary_the_last_parameter_fastest(spark):
    rows = [("a", i, n, None, None) for i, n in enumerate("xyz")] + [("b", i, n, None, None) for i, n in enumerate("12")]
    schema = "param string, pos int, name string, search_aliases array<string>, question_aliases array<string>"
    out = planning.input_grid(spark.createDataFrame(rows, schema), ["a", "b"]).orderBy("question_id").collect()
    assert [(r["question_id"], r["a"]["name"] + r["b"]["name"]) for r in out] == list(
        enumerate(["x1", "x2", "y1", "y2", "z1", "z2"])
    )


def test_question_and_search_text(spark):
    spec, df = grid(spark)
    df = planning.format_question(df, spec.question, spec.params)
    out = planning.build_search_query(df, spec.params, " AND (pain) ").orderBy("question_id").collect()
    assert out[0]["question"] == "How does lidocaine act on kv1.1 (a.k.a kcna1)?"
    assert out[0]["search_query"] == "(kv1.1 OR kv 1.1 OR kcna1) AND (lidocaine) AND (pain)"
    assert planning.build_search_query(df, spec.params).orderBy("question_id").first()["search_query"].endswith("(lidocaine)")


def test_braces_inside_a_value_stay(spark):
    schema = "param string, pos int, name string, search_aliases array<string>, question_aliases array<string>"
    rows = [("a", 0, "{b}", None, None), ("b", 0, "two", None, None)]
    df = planning.input_grid(spark.createDataFrame(rows, schema), ["a", "b"])
    assert planning.format_question(df, "{a} or {b}", ["a", "b"]).first()["question"] == "{b} or two"


def test_search_terms_keep_one_character_words(spark):
    spec, df = grid(spark)
    terms = planning.normalise_terms(planning.search_terms(df, spec.params, [["brain", "cortex"]]))
    first = {(r["group_no"], r["term"], r["n_words"]) for r in terms.filter("question_id = 0").collect()}
    assert first == {
        (0, "kv1 1", 2), (0, "kv 1 1", 3), (0, "kcna1", 1), (1, "lidocaine", 1), (2, "brain", 1), (2, "cortex", 1)
    }


def test_empty_aliases_are_null(spark):
    df = spark.createDataFrame([('["a"]',), ("",), ("[]",), (None,)], "x string")
    assert [r["x"] for r in planning.parse_aliases(df, "x").collect()] == [["a"], None, None, None]


def test_pairs_need_the_article(spark, make_articles):
    plan = spark.createDataFrame([(0, "q")], "question_id long, question string")
    hits = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "question_id long, article_id long, rank int")
    out = planning.screening_pairs(plan, hits, make_articles({2: (["x"], [])}))
    assert [(r["question_id"], r["article_id"]) for r in out.select(F.col("question_id"), "article_id").collect()] == [(0, 2)]


def test_positions_with_gaps_lose_nothing(spark):
    schema = "param string, pos int, name string, search_aliases array<string>, question_aliases array<string>"
    rows = [("a", p, f"v{p}", None, None) for p in (0, 2, 5, 5)]
    out = planning.input_grid(spark.createDataFrame(rows, schema), ["a"]).orderBy("question_id").collect()
    assert [(r["question_id"], r["a"]["name"]) for r in out] == [(0, "v0"), (1, "v2"), (2, "v5"), (3, "v5")]

"""A whole review, run in one go, again, and as a stream."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from litscreen.functions.scale import stage_path
from litscreen.operators import extraction, planning, results
from litscreen.plans import screening
from litscreen.spec import AllowedValue, Example, InputItem, InputParameter, OutputFeature, ReviewSpec
from litscreen.streaming.screening import stream_articles, stream_screen

SPEC = ReviewSpec(
    question="What does {drug} do to {channel}?",
    goal="to learn what drugs do",
    inputs=[
        InputParameter("channel", [InputItem("kv1.1", ["kv 1.1", "kcna1"], ["kcna1"]), InputItem("kv1.2")], 10),
        InputParameter("drug", [InputItem("lidocaine"), InputItem("aspirin")], 20),
    ],
    features=[
        OutputFeature("effect", allowed_values=[AllowedValue("close", "CLOSE"), AllowedValue("none", "NR")]),
        OutputFeature("kinds", multiple_values=True),
        OutputFeature("note", required=False),
    ],
    examples=[Example({"drug": "d", "channel": "c"}, {"section 1": "s"}, {"effect": "NR", "kinds": []})],
    top_sections=2,
)
TEXTS = {
    1: (["Lidocaine and kcna1."], ["Nothing.", "Lidocaine blocks kcna1.", "More on lidocaine."]),
    2: (["kv1.2 and aspirin"], ["aspirin and lidocaine"]),
    3: (["Unrelated"], ["text"]),
    4: (["kv 1.1 meets lidocaine, a bad answer"], []),
}


def answers():
    def fn(prompt):
        asked = prompt[prompt.rindex("QUESTION: "):]
        if "bad answer" in asked:
            return "no json", 1.0
        effect = "CLOSE" if "blocks" in asked else "NR"
        return json.dumps({"effect": effect, "kinds": ["é", "b"]}), 0.5

    return fn


def content(spark, table):
    return sorted(tuple(r) for r in results.read_results(spark, table).drop("id").collect())


@pytest.fixture(scope="module")
def corpus(make_articles):
    return make_articles(TEXTS).withColumn("format", F.lit("PUBMED"))


@pytest.fixture(scope="module")
def batch(spark, corpus):
    results.reset_result_table(spark, "batch_review", SPEC, 4)
    summary, rejected = screening.run_review(spark, SPEC, corpus, "batch_review", answers(), 2)
    return summary.first(), rejected.collect()


def test_batch(spark, batch):
    summary, rejected = batch
    # kv1.1 x lidocaine finds 1 and 4; kv1.2 finds 2 with either drug.
    assert (summary["pairs"], summary["added"], float(summary["total_cost"])) == (4, 3, 1.5)
    assert [(r["article_id"], r["reject_reason"]) for r in rejected] == [(4, "invalid_json")]
    found = {(r["channel"], r["drug"], r["pubmed_id"]): r for r in results.read_results(spark, "batch_review").collect()}
    assert set(found) == {("kv1.1", "lidocaine", "1"), ("kv1.2", "lidocaine", "2"), ("kv1.2", "aspirin", "2")}
    row = found["kv1.1", "lidocaine", "1"]
    assert (row["format"], row["effect"], row["kinds"], row["note"]) == ("PUBMED", "CLOSE", '["é","b"]', None)
    # Both sections hold the same question words; the shorter one scores higher.
    assert list(json.loads(row["sections"]).values()) == ["Lidocaine and kcna1.", "Lidocaine blocks kcna1."]
    assert sorted(r["id"] for r in found.values()) == [1, 2, 3]


def test_second_run_adds_nothing(spark, corpus, batch):
    before = content(spark, "batch_review")
    summary, _ = screening.run_review(spark, SPEC, corpus, "batch_review", answers(), 2)
    assert summary.first()["added"] == 0
    assert content(spark, "batch_review") == before


def test_stream_gives_the_batch_table(spark, corpus, batch):
    path = stage_path(spark, "landed")
    corpus.repartition(3).write.parquet(path)
    results.reset_result_table(spark, "stream_review", SPEC, 4)
    hits = screening.review_hits(spark, SPEC, corpus)
    for _ in range(2):  # the second time a new checkpoint replays every batch
        stream = stream_articles(spark, path, corpus.schema, max_files_per_trigger=2)
        query = stream_screen(
            spark, stream, SPEC, screening.review_plan(spark, SPEC), hits, "stream_review", answers(),
            stage_path(spark, "stream-state"), concurrency=2,
        )
        query.awaitTermination()
        assert query.exception() is None
        assert content(spark, "stream_review") == content(spark, "batch_review")


def test_failed_extractions_are_returned_and_counted(spark, corpus):
    def fn(prompt):
        asked = prompt[prompt.rindex("QUESTION: "):]
        if "blocks" in asked:
            raise RuntimeError("no service")
        return answers()(prompt)

    results.reset_result_table(spark, "failing_review", SPEC, 4)
    summary, rejected = screening.run_review(spark, SPEC, corpus, "failing_review", fn, 2)
    row = summary.first()
    assert (row["pairs"], row["added"], row["failed"]) == (4, 2, 1)
    found = {(r["article_id"], r["reject_reason"], r["error"]) for r in rejected.collect()}
    assert found == {(1, "failed", "RuntimeError: no service"), (4, "invalid_json", None)}


def test_stream_from_terms_finds_what_lands(spark, corpus, batch):
    path = stage_path(spark, "landed")
    corpus.repartition(2).write.parquet(path)
    results.reset_result_table(spark, "terms_review", SPEC, 4)
    grid = planning.input_grid(SPEC.input_rows(spark), SPEC.params)
    stream = stream_articles(spark, path, corpus.schema, max_files_per_trigger=1)
    query = stream_screen(
        spark, stream, SPEC, screening.review_plan(spark, SPEC), None, "terms_review", answers(),
        stage_path(spark, "stream-state"), concurrency=2, terms=planning.search_terms(grid, SPEC.params, SPEC.search_groups),
    )
    query.awaitTermination()
    assert query.exception() is None
    assert content(spark, "terms_review") == content(spark, "batch_review")


def counting(folder, fn):
    def call(prompt):
        answer = fn(prompt)
        (folder / uuid.uuid4().hex).write_text(prompt)
        return answer

    return call


def test_stored_answers_make_no_second_call(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "fails")], "k long, prompt string")

    def fn(prompt):
        if prompt == "fails":
            raise RuntimeError("no service")
        return prompt.upper(), 0.5

    for _ in range(2):  # the second run finds every answer but the failed one
        out = extraction.run_extractor_stored(prompts, counting(calls, fn), ["k"], store, 2, 2, (0.0, 0.0))
        assert sorted(tuple(r) for r in out.select("k", "response", "error").collect()) == [
            (1, "A", None), (2, "B", None), (3, "A", None), (4, None, "RuntimeError: no service")
        ]
        assert sorted(p.read_text() for p in calls.iterdir()) == ["a", "b"]


def test_review_from_sources_resolves_what_it_finds(spark, make_articles, tmp_path):
    abstracts = make_articles({k: (a, []) for k, (a, _) in TEXTS.items()})
    full = make_articles({1: (["From the full text"], [f"kcna1 part {i}" for i in range(6)]), 3: (["Not found"], ["x"] * 9)})
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    tables = []
    for name in ("sourced_review", "replayed_review"):  # the second table is filled from the stored answers alone
        results.reset_result_table(spark, name, SPEC, 4)
        summary, _ = screening.run_review_from_sources(
            spark, SPEC, abstracts, full, full.limit(0), name, counting(calls, answers()), 2, store=store
        )
        row = summary.first()
        assert (row["pairs"], row["added"]) == (3, 2)
        assert len(list(calls.iterdir())) == 3
        tables.append(content(spark, name))
    assert tables[0] == tables[1]
    formats = results.read_results(spark, "sourced_review").select("pubmed_id", "format").collect()
    assert sorted(map(tuple, formats)) == [("1", "PMC"), ("2", "PUBMED")]

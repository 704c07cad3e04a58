import json
import os
import tempfile

import pytest

from litscreen.operators import extraction, prompts, summary
from litscreen.spec import AllowedValue, Example, InputItem, InputParameter, OutputFeature, ReviewSpec

FEATURES = [
    OutputFeature("effect", required=False, allowed_values=[AllowedValue("shut", "CLOSE", "closes"), AllowedValue("ajar", "OPEN")]),
    OutputFeature("ids", "int", required=False, multiple_values=True),
    OutputFeature("dose", "str"),
    OutputFeature("n", "int", required=False),
    OutputFeature("x", "float", required=False),
    OutputFeature("ok", "bool", required=False),
    OutputFeature("more", "dict", required=False),
    OutputFeature("items", "list", required=False),
]


def parse(spark, text):
    df = spark.createDataFrame([(text,)], "response string")
    return extraction.parse_responses(df, FEATURES).first()


CASES = [
    ("", "invalid_json"), ("{", "invalid_json"), ("no answer", "invalid_json"), ("[1]", "not_object"), ('"a"', "not_object"),
    ("null", "not_object"), ("{}", "missing:dose"), ('{"dose": null}', "type:dose"), ('{"dose": 5}', "type:dose"),
    ('{"dose": ["a"]}', "type:dose"), ('{"dose": "a", "effect": "MAYBE"}', "value:effect"),
    ('{"dose": "a", "effect": "shut"}', "value:effect"), ('{"dose": "a", "effect": 1}', "type:effect"),
    ('{"dose": "a", "effect": ["OPEN"]}', "type:effect"), ('{"dose": "a", "ids": 1}', "type:ids"),
    ('{"dose": "a", "ids": ["x"]}', "value:ids"), ('{"dose": "a", "ids": [1, null]}', "value:ids"),
    ('{"dose": "a", "n": 4.5}', "type:n"), ('{"dose": "a", "n": "4.5"}', "type:n"), ('{"dose": "a", "x": "much"}', "type:x"),
    ('{"dose": "a", "ok": "perhaps"}', "type:ok"), ('{"dose": "a", "ok": 2}', "type:ok"),
    ('{"dose": "a", "more": []}', "type:more"), ('{"dose": "a", "items": {}}', "type:items"),
]


def test_rejects(spark):
    df = spark.createDataFrame(CASES, "response string, wanted string")
    rows = extraction.parse_responses(df, FEATURES).collect()
    assert [(r["response"], r["reject_reason"]) for r in rows] == CASES
    assert all(r[f.name] is None for r in rows for f in FEATURES)
    good, bad = extraction.split_rejects(extraction.parse_responses(df, FEATURES))
    assert (good.count(), bad.count()) == (0, len(CASES))


def test_lenient_conversions(spark):
    row = parse(spark, '```json\n{"dose": "a", "n": "4", "x": "2.5", "ok": "Yes", "ids": [1, "2", 3.0, true]}\n```')
    assert row["reject_reason"] is None
    assert (row["n"], row["x"], row["ok"], row["ids"]) == (4, 2.5, True, [1, 2, 3, 1])
    row = parse(spark, '{"dose": "a", "n": 4.0, "x": 3, "ok": 0, "ids": []}')
    assert (row["n"], row["x"], row["ok"], row["ids"], row["reject_reason"]) == (4, 3.0, False, [], None)


def test_optional_nulls_and_objects(spark):
    row = parse(spark, '{"dose": "a", "effect": null, "ids": null, "more": {"b": "1", "a": [2]}, "items": [1, "b"], "extra": 1}')
    assert row["reject_reason"] is None and row["effect"] is None and row["ids"] is None
    assert row["more"] == '{"b":"1","a":[2]}' and row["items"] == '[1,"b"]'


def test_allowed_values_get_names(spark):
    df = spark.createDataFrame([("OPEN", ["CLOSE", "OPEN"]), ("??", None)], "one string, many array<string>")
    out = extraction.expand_allowed_values(df, "one", FEATURES[0].allowed_values)
    rows = extraction.expand_allowed_values(out, "many", FEATURES[0].allowed_values).collect()
    assert (rows[0]["one_name"], rows[0]["one_description"], rows[0]["many_name"]) == ("ajar", "", ["shut", "ajar"])
    assert (rows[1]["one_name"], rows[1]["many_name"]) == (None, None)


def test_failed_calls_are_retried_then_kept_as_errors(spark):
    counter = tempfile.mkdtemp()

    def fn(prompt):
        mark = os.path.join(counter, prompt)
        with open(mark, "a") as file:
            file.write("x")
        if prompt == "never" or (prompt == "later" and os.path.getsize(mark) < 3):
            raise RuntimeError("down")
        return prompt.upper(), 0.25

    df = spark.createDataFrame([(1, "now"), (2, "later"), (3, "never")], "id long, prompt string")
    out = extraction.run_extractor(df, fn, ["id"], concurrency=2)
    rows = {r["id"]: r for r in out.collect()}
    assert (rows[1]["response"], rows[2]["response"], rows[3]["response"]) == ("NOW", "LATER", None)
    assert rows[3]["error"] == "RuntimeError: down" and rows[1]["error"] is None
    assert os.path.getsize(os.path.join(counter, "never")) == 5
    assert out.rdd.getNumPartitions() == 2
    total = summary.cost_summary(out).first()
    assert (total["calls"], total["failed"], float(total["total_cost"])) == (3, 1, 0.5)


def spec_with(outputs):
    return ReviewSpec(
        question="What of {drug}?", goal="to learn", exclude=" Leave out mutants.",
        inputs=[InputParameter("drug", [InputItem("lidocaine")], 20)], features=FEATURES[:3],
        examples=[Example({"drug": "d1"}, {"section 1": "é text"}, outputs), Example({"drug": "d2"}, {}, {"dose": "b"})],
    )


def test_prompt_text(spark):
    spec = spec_with({"ids": [1], "dose": "a", "effect": "OPEN"})
    block = prompts.few_shot_block(prompts.example_rows(spark, spec))
    first, second = block.split("\n\n")
    assert first == 'QUESTION: What of d1?\n{"section 1": "é text"}\n{"effect":"OPEN","ids":[1],"dose":"a"}'
    assert json.loads(second.splitlines()[2]) == {"effect": None, "ids": None, "dose": "b"}
    df = spark.createDataFrame([("What of lidocaine?", '{"section_1":"{x}"}')], "question string, sections string")
    text = prompts.build_prompts(df, block, prompts.prompt_opening(spec)).first()["prompt"]
    assert "aiming to learn.\n" in text and "answer. Leave out mutants.\n" in text
    assert text.endswith('\n\nQUESTION: What of lidocaine?\n{"section_1":"{x}"}\n')
    assert text.count("QUESTION: ") == 3
    alone = prompts.build_prompts(df, "", "Go.").first()["prompt"]
    assert alone == 'Go.\n\nQUESTION: What of lidocaine?\n{"section_1":"{x}"}\n'


def test_examples_must_fit_the_features(spark):
    with pytest.raises(ValueError, match="example 0 .* value:effect"):
        prompts.example_rows(spark, spec_with({"dose": "a", "effect": "MAYBE"}))


def test_examples_are_written_with_typed_values(spark):
    block = prompts.few_shot_block(prompts.example_rows(spark, spec_with({"ids": ["4", 5.0], "dose": "a", "effect": "OPEN"})))
    assert block.splitlines()[2] == '{"effect":"OPEN","ids":[4,5],"dose":"a"}'


@pytest.mark.parametrize("response, dose", [
    ('Here is the JSON:\n```json\n{"dose": "x"}\n```\nHope this helps.', "x"),
    ('```\n{"dose": "x"}```', "x"),
    ('Sure: {"dose": "two\nlines\tand a \\"quote\\""} Done.', 'two\nlines\tand a "quote"'),
    ('{"dose": "a ```json``` word"}', "a ```json``` word"),
])
def test_answers_as_models_write_them(spark, response, dose):
    df = spark.createDataFrame([(response,)], "response string")
    row = extraction.parse_responses(df, [OutputFeature("dose")]).first()
    assert (row["reject_reason"], row["dose"]) == (None, dose)


def test_answers_of_finished_tasks_outlive_a_job_that_fails(spark, tmp_path):
    log, store = str(tmp_path / "calls"), str(tmp_path / "store")
    asked = spark.range(40).selectExpr("id AS k", "concat('prompt ', id) AS prompt")

    def calls():
        with open(log) as lines:
            return sorted(lines.read().split())

    def answer(prompt):
        with open(log, "a") as lines:
            lines.write(prompt.split()[1] + "\n")
        return prompt.upper(), 1.0

    def dies(prompt):
        if prompt == "prompt 7":
            import time

            time.sleep(12)  # the other tasks finish first
            raise SystemExit("the worker is gone")
        return answer(prompt)

    with pytest.raises(Exception, match="worker|aborted|SystemExit"):
        extraction.run_extractor_stored(asked, dies, ["k"], store, concurrency=4, attempts=1).collect()
    kept = {r["prompt_hash"] for r in spark.read.schema(extraction.STORED).parquet(store).collect()}
    first = calls()
    assert 20 <= len(kept) < 40 and len(first) >= len(kept)
    os.remove(log)
    rows = extraction.run_extractor_stored(asked, answer, ["k"], store, concurrency=4, attempts=1).collect()
    assert sorted(r["response"] for r in rows) == sorted(f"PROMPT {i}" for i in range(40))
    assert all(r["cost"] == 1.0 and r["error"] is None for r in rows)
    again = calls()
    assert len(again) == 40 - len(kept) and "7" in again and len(set(again)) == len(again)


def test_rows_stored_twice_are_one_answer_and_failures_are_tried_again(spark, tmp_path):
    store = str(tmp_path / "store")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "k int, prompt string")

    def picky(prompt):
        if prompt == "b":
            raise ValueError("busy")
        return f"<{prompt}>", 0.5

    def got(fn):
        rows = extraction.run_extractor_stored(asked, fn, ["k"], store, 2, 1, (0.0, 0.0)).collect()
        return sorted((r["k"], r["response"], r["error"]) for r in rows)

    assert got(picky) == [(1, "<a>", None), (2, None, "ValueError: busy"), (3, "<a>", None)]
    spark.read.parquet(store).write.mode("append").parquet(store)
    assert got(picky) == [(1, "<a>", None), (2, None, "ValueError: busy"), (3, "<a>", None)]
    assert got(lambda p: (f"[{p}]", 0.5)) == [(1, "<a>", None), (2, "[b]", None), (3, "<a>", None)]

"""Few-shot prompts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscreen.functions import fixed
from litscreen.operators.extraction import parse_responses
from litscreen.spec import ReviewSpec


def render_examples(examples: DataFrame, out: str = "example") -> DataFrame:
    """``(.., question, sections, answer)`` to the text of one example; sections and answer are JSON text."""
    question = F.concat(F.lit(fixed.QUESTION_PREFIX), F.col("question"))
    return examples.withColumn(out, F.concat_ws("\n", question, "sections", "answer"))


def example_rows(spark, spec: ReviewSpec) -> DataFrame:
    """The spec's examples as ``(pos, question, sections, answer)``; answers are checked and written with typed values."""

    def answer(outputs) -> str:
        return json.dumps({f.name: outputs.get(f.name) for f in spec.features}, ensure_ascii=False, separators=(",", ":"))

    rows = [
        (i, spec.question.format(**e.inputs), json.dumps(dict(e.sections), ensure_ascii=False), answer(e.outputs))
        for i, e in enumerate(spec.examples)
    ]
    examples = spark.createDataFrame(rows, "pos int, question string, sections string, answer string")
    parsed = parse_responses(examples, spec.features, "answer")
    bad = parsed.filter(F.col("reject_reason").isNotNull()).first()
    if bad is not None:
        raise ValueError(f"example {bad['pos']} does not fit the features: {bad['reject_reason']}")
    typed = F.concat(F.lit("{"), F.concat_ws(",", *[_member(f) for f in spec.features]), F.lit("}"))
    return parsed.select("pos", "question", "sections", typed.alias("answer"))


def _member(feature) -> Column:
    """One name and value of an answer as JSON text. Objects and lists without a declared element are JSON already."""
    value = F.col(feature.name)
    raw = feature.data_type in ("list", "dict") and not feature.multiple_values and not feature.allowed_values
    # A struct of one field gives the JSON of any type; its braces are cut off again.
    text = value if raw else F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.concat(F.lit(json.dumps(feature.name, ensure_ascii=False) + ":"), F.when(value.isNull(), F.lit("null")).otherwise(text))


def few_shot_block(examples: DataFrame) -> str:
    """All examples in order of ``pos`` as one text, put together in Spark; the one row that comes back is the prompt's."""
    rows = render_examples(examples).agg(F.array_sort(F.collect_list(F.struct("pos", "example"))).alias("e"))
    return rows.select(F.array_join(F.transform("e", lambda x: x["example"]), fixed.PROMPT_SEPARATOR)).first()[0]


def prompt_opening(spec: ReviewSpec) -> str:
    return fixed.PROMPT_OPENING.format(
        research_goal=spec.goal,
        information_to_exclude=spec.exclude,
        format_instructions=spec.format_instructions(),
    )


def build_prompts(pairs: DataFrame, block: str, opening: str, out: str = "prompt") -> DataFrame:
    """Opening text, examples, then the row's own ``question`` and ``sections``."""
    head = fixed.PROMPT_SEPARATOR.join(part for part in (opening, block) if part)
    return pairs.withColumn(
        out,
        F.concat(
            F.lit(head + fixed.PROMPT_SEPARATOR + fixed.QUESTION_PREFIX), "question", F.lit("\n"), "sections", F.lit("\n")
        ),
    )

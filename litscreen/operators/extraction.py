"""Run the extractor and turn its answers into typed, checked columns."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litscreen.functions import fixed
from litscreen.functions.scale import broadcast_if_small, folder_exists, stage
from litscreen.spec import AllowedValue, OutputFeature

# Texts that count as a truth value.
TRUE_TEXTS = ("1", "on", "t", "true", "y", "yes")
FALSE_TEXTS = ("0", "off", "f", "false", "n", "no")

Extractor = Callable[[str], tuple[str, float]]

STORED = T.StructType([
    T.StructField("prompt_hash", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("error", T.StringType()),  # of a call that failed; such a row is not an answer
    T.StructField("run", T.StringType()),
])

# A task moves its files into place when it finishes, not when the whole job does, so what it paid for outlives a job
# that fails later. A task that is lost while it moves them may leave rows twice; a prompt's rows are folded when read.
KEPT_PER_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def run_extractor(
    prompts: DataFrame,
    fn: Extractor,
    keys: Sequence[str],
    concurrency: int = fixed.EXTRACTOR_CONCURRENCY,
    attempts: int = fixed.EXTRACTOR_ATTEMPTS,
    wait: tuple[float, float] = fixed.EXTRACTOR_WAIT,
) -> DataFrame:
    """Call ``fn(prompt) -> (response, cost)`` for every row: ``keys`` + ``(response, cost, error)``.

    The number of partitions is the number of calls made at once. A call is tried ``attempts`` times, with a random pause of
    ``wait`` seconds in between; a row that still
    fails carries the message in ``error`` and does not stop the others. Only keys and prompts cross to Python.
    """
    schema = T.StructType([prompts.schema[k] for k in keys])
    schema = schema.add("response", T.StringType()).add("cost", T.DoubleType()).add("error", T.StringType())
    names = list(keys)

    def call(prompt: str) -> tuple[str | None, float, str | None]:
        error = None
        for attempt in range(attempts):
            if attempt:
                time.sleep(random.uniform(*wait))
            try:
                response, cost = fn(prompt)
                return response, float(cost), None
            except Exception as failure:  # the callable is the user's: any failure belongs to its row
                error = f"{type(failure).__name__}: {failure}"
        return None, 0.0, error

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [call(p) for p in frame["prompt"]]
            out = frame[names].copy()
            out["response"] = [a[0] for a in answers]
            out["cost"] = [a[1] for a in answers]
            out["error"] = pd.Series([a[2] for a in answers], index=out.index, dtype=object)
            yield out

    return prompts.select(*names, "prompt").repartition(concurrency).mapInPandas(batches, schema)


def run_extractor_stored(
    prompts: DataFrame,
    fn: Extractor,
    keys: Sequence[str],
    store: str,
    concurrency: int = fixed.EXTRACTOR_CONCURRENCY,
    attempts: int = fixed.EXTRACTOR_ATTEMPTS,
    wait: tuple[float, float] = fixed.EXTRACTOR_WAIT,
) -> DataFrame:
    """As ``run_extractor``, but answers are kept under the folder ``store`` by the hash of their prompt.

    A prompt that has an answer there, from an earlier run or a batch that is replayed, makes no call, and equal prompts
    make one. The answers of each task are kept as soon as it finishes, also if the job fails after that: the next run only
    calls for the rest. Failed calls give no answer, so the next run tries them again. ``cost`` is what the answer cost when
    it was given. The store itself is only scanned: what is asked for is cut out of it before anything is joined.
    """
    asked = prompts.select(*keys, "prompt", F.sha2("prompt", 256).alias("prompt_hash"))
    wanted = broadcast_if_small(stage(asked.select("prompt_hash").distinct(), "asked-hashes"))
    kept = _answers(wanted, store)
    fresh = asked.join(kept.select("prompt_hash"), "prompt_hash", "left_anti").dropDuplicates(["prompt_hash"])
    run = uuid.uuid4().hex
    given = run_extractor(fresh, fn, ["prompt_hash"], concurrency, attempts, wait).withColumn("run", F.lit(run))
    given.write.mode("append").options(**KEPT_PER_TASK).parquet(store)
    return asked.drop("prompt").join(_answers(wanted, store, run), "prompt_hash").select(*keys, "response", "cost", "error")


def _answers(wanted: DataFrame, store: str, run: str | None = None) -> DataFrame:
    """``(prompt_hash, response, cost, error)``: the stored answer to each wanted prompt; else the failure in ``run``."""
    spark = wanted.sparkSession
    if not folder_exists(spark, store):
        return spark.createDataFrame([], STORED).drop("run")
    rows = spark.read.schema(STORED).parquet(store).filter(F.col("error").isNull() | F.col("run").eqNullSafe(run))
    answer = F.struct(F.col("error").isNotNull().alias("failed"), "response", "cost", "error")
    once_each = rows.join(wanted, "prompt_hash", "left_semi").groupBy("prompt_hash").agg(F.min(answer).alias("a"))
    return stage(once_each.select("prompt_hash", "a.response", "a.cost", "a.error"), "answers")


def _checked(feature: OutputFeature, value: Column) -> Column:
    """``struct(ok, value)`` of one JSON value; conversions are those a lenient typed parser makes."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")
    as_double = F.try_variant_get(value, "$", "double")
    if feature.allowed_values:
        ok, out = (kind == "STRING") & text.isin(*[a.alias for a in feature.allowed_values]), text
    elif feature.data_type == "str":
        ok, out = kind == "STRING", text
    elif feature.data_type == "int":
        whole = (kind == "STRING") & F.rlike(text, F.lit(r"^\s*[+-]?[0-9]+(\.0+)?\s*$"))
        ok = (kind == "BIGINT") | (kind == "BOOLEAN") | (number & (as_double == F.floor(as_double))) | whole
        out = (
            F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint"))
            .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
            .when(number, as_double.cast("bigint"))
            .when(whole, F.regexp_extract(text, r"[+-]?[0-9]+", 0).try_cast("bigint"))
        )
        ok = ok & out.isNotNull()
    elif feature.data_type == "float":
        read = F.trim(text).try_cast("double")
        ok = number | (kind == "BOOLEAN") | ((kind == "STRING") & read.isNotNull())
        out = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(
            F.coalesce(as_double, read)
        )
    elif feature.data_type == "bool":
        low = F.lower(F.trim(text))
        out = (
            F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
            .when(number & (as_double == 1), True)
            .when(number & (as_double == 0), False)
            .when((kind == "STRING") & low.isin(*TRUE_TEXTS), True)
            .when((kind == "STRING") & low.isin(*FALSE_TEXTS), False)
        )
        ok = out.isNotNull()
    else:
        ok = kind.startswith("ARRAY" if feature.data_type == "list" else "OBJECT")
        out = F.to_json(value)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), out.cast(feature.element_type).alias("value"))


def _checker(feature: OutputFeature) -> Callable[[Column], Column]:
    return lambda value: _checked(feature, value)


def answer_json(response: Column) -> Column:
    """The JSON text of an answer: the whole answer if it is JSON, else its first fenced block, else what stands from the
    first ``{`` to the last ``}``. Raw line breaks and tabs inside strings are escaped."""

    def escaped(text: Column) -> Column:
        # Every second piece between unescaped quotes is inside a string.
        pieces = F.split(F.replace(text, F.lit('\\"'), F.lit("\x01")), '"')
        for raw, safe in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            pieces = _odd_replaced(pieces, raw, safe)
        return F.replace(F.array_join(pieces, '"'), F.lit("\x01"), F.lit('\\"'))

    fenced = F.regexp_extract(response, r"(?s)```(?:[A-Za-z]*)\s*\n?(.*?)```", 1)
    span = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    plain = F.trim(response)
    choices = [plain, *[F.nullif(F.trim(x), F.lit("")) for x in (fenced, span)]]
    readable = [F.when(F.try_parse_json(escaped(c)).isNotNull(), escaped(c)) for c in choices]
    return F.coalesce(*readable, response)


def _odd_replaced(pieces: Column, raw: str, safe: str) -> Column:
    return F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(raw), F.lit(safe))).otherwise(x))


def parse_responses(responses: DataFrame, features: Sequence[OutputFeature], response_col: str = "response") -> DataFrame:
    """Add one typed column per feature and ``reject_reason`` (null when the answer is good).

    Reasons, in the order tested: ``invalid_json``, ``not_object``, then per feature ``missing:f``, ``type:f`` (wrong
    type, or not a list) and ``value:f`` (a list element or choice that is not allowed). A missing or null optional
    feature is null. Columns of rejected rows are null.
    """
    names = responses.columns
    df = responses.withColumn("__text", answer_json(F.col(response_col))).withColumn("__json", F.try_parse_json("__text"))
    is_object = F.schema_of_variant("__json").startswith("OBJECT")
    reason = F.when(F.col("__json").isNull(), "invalid_json").when(~is_object, "not_object")

    found = {}
    for f in features:
        df = df.withColumn(f"__v_{f.name}", F.try_variant_get("__json", f"$['{f.name}']", "variant"))
    for f in features:
        raw = F.col(f"__v_{f.name}")
        if f.multiple_values:
            elements = F.try_variant_get(raw, "$", "array<variant>")
            found[f.name] = F.transform(elements, _checker(f))
        else:
            found[f.name] = _checked(f, raw)
    for f in features:
        df = df.withColumn(f"__c_{f.name}", found[f.name])

    for f in features:
        raw, checked = F.col(f"__v_{f.name}"), F.col(f"__c_{f.name}")
        kind = F.schema_of_variant(raw)
        given = raw.isNotNull() & (kind != "VOID") if not f.required else F.lit(True)
        if f.required:
            reason = reason.when(raw.isNull(), f"missing:{f.name}")
        if f.multiple_values:
            reason = reason.when(given & ~kind.startswith("ARRAY"), f"type:{f.name}")
            reason = reason.when(given & F.exists(checked, lambda e: ~e["ok"]), f"value:{f.name}")
        elif f.allowed_values:
            reason = reason.when(given & (kind != "STRING"), f"type:{f.name}")
            reason = reason.when(given & ~checked["ok"], f"value:{f.name}")
        else:
            reason = reason.when(given & ~checked["ok"], f"type:{f.name}")
    df = df.withColumn("__reason", reason)

    good = F.col("__reason").isNull()
    typed = []
    for f in features:
        checked = F.col(f"__c_{f.name}")
        value = F.transform(checked, lambda e: e["value"]) if f.multiple_values else checked["value"]
        if f.data_type in ("list", "dict") and not f.multiple_values and not f.allowed_values:
            # Read from the text, because a parsed object does not keep its keys in order.
            value = F.get_json_object("__text", f"$['{f.name}']")
        typed.append(F.when(good, value).alias(f.name))
    return df.select(*names, *typed, F.col("__reason").alias("reject_reason"))


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows. Hand in a stored table, so that nothing is extracted or parsed twice."""
    good = F.col("reject_reason").isNull()
    return parsed.filter(good).drop("reject_reason"), parsed.filter(~good)


def expand_allowed_values(df: DataFrame, col: str, allowed: Sequence[AllowedValue]) -> DataFrame:
    """Add ``<col>_name`` and ``<col>_description`` for the aliases in ``col``; lists give lists.

    The choices are written in the spec, so they travel as constants inside the plan and no row moves.
    """
    names = F.create_map(*[F.lit(x) for a in allowed for x in (a.alias, a.name)])
    texts = F.create_map(*[F.lit(x) for a in allowed for x in (a.alias, a.description)])

    def looked_up(table: Column) -> Column:
        if isinstance(df.schema[col].dataType, T.ArrayType):
            return F.transform(F.col(col), lambda a: F.try_element_at(table, a))
        return F.try_element_at(table, F.col(col))

    return df.withColumn(f"{col}_name", looked_up(names)).withColumn(f"{col}_description", looked_up(texts))

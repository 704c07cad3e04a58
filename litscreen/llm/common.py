"""What several operators of this package share: input columns, batches of rows, and the row key of a document."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litscreen.functions.scale import broadcast_if_small

# Texts handed to one step of a Python function are cut to about this many characters in all, so that memory is bounded
# by this and by the longest single text, whatever an Arrow batch holds.
BATCH_CHARS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application: their Python needs it to run the functions."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="litscreen-code-"), "litscreen_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, named ``doc_id`` and ``text``; extra columns, whatever their names, play no part."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_version(text: Column) -> Column:
    """Tells texts apart that share an id; a null text has a version of its own."""
    return F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))


def rows_apart(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, version, text``: the other columns are packed into ``row``, where no name of theirs can clash."""
    text = F.col(text_col).cast("string")
    others = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    return docs.select(others.alias("row"), F.col(id_col).alias("doc_id"), text_version(text).alias("version"), text.alias("text"))


def rows_together(docs: DataFrame, text: Column, text_col: str = "text") -> list[Column]:
    """The columns of ``docs``, in their order, from ``row`` and a text."""
    return [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]


def split_join(wide: DataFrame, counted: DataFrame, on: list[str], n: str, spread: list[str], at_once: int = 10_000) -> DataFrame:
    """Inner join of ``wide`` with ``counted``, which has one row per key and in ``n`` how many rows of ``wide`` it meets.

    The rows of a key of more than ``at_once`` are dealt over several tasks, by a hash of ``spread``, and its one row of
    ``counted`` is copied to each. Such keys are few: ``at_once`` grows so that there are at most 20,000 of them, whatever
    the tables hold, so they can be sent to all tasks, which tells ``wide`` how many ways each is dealt.
    """
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    at_once = max(at_once, -(-total // 20_000))
    ways = F.ceil(F.col(n) / at_once).cast("int")
    hot = broadcast_if_small(counted.filter(F.col(n) > at_once).select(*on, ways.alias("_ways")))
    dealt = wide.join(hot, on, "left").withColumn("_way", F.when(F.col("_ways").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), "_ways")).cast("int"))
    copied = counted.withColumn("_way", F.explode(F.sequence(F.lit(0), F.greatest(ways, F.lit(1)) - 1)))
    return dealt.drop("_ways").join(copied, [*on, "_way"]).drop("_way")


def give_back() -> None:
    """What this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other libraries may not
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, and at the end of its task what it has freed goes back to the system.

    A Python worker stays for the next task, beside those of other stages, and would keep the most that any of its tasks
    has held.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def map_texts(
    df: DataFrame, text_col: str, schema: str, make: Callable[[], Callable[[list[str | None]], dict[str, list]]]
) -> DataFrame:
    """Add columns computed from a text column by Python over Arrow batches.

    ``make`` is called once per task and returns a function from a list of texts to lists of new values, one list per
    column of ``schema``. The other columns of ``df`` are kept as they are; the text itself is not returned.
    """
    ship_package(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != text_col]
    added = T._parse_datatype_string(schema)
    out = T.StructType([*kept, *added.fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in bounded(batch, text_col):
                values = work(piece.column(text_col).to_pylist())
                cols = [piece.column(n) for n in names]
                new = [pa.array(values[f.name], type=_arrow(f.dataType)) for f in added.fields]
                yield pa.RecordBatch.from_arrays(cols + new, names=names + added.names)

    return df.mapInArrow(giving_back(run), out)


def bounded(batch: pa.RecordBatch, text_col: str, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece hold about ``limit`` bytes; a longer single text is a piece of its own."""
    column = batch.column(text_col)
    sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start, len(sizes) - start)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)

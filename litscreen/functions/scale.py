"""Guards that keep plans sound when the tables grow: checked broadcasts, staged tables, small-scan spreading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is only broadcast when it was counted and stays below both bounds.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# A table of at most this many rows may be held in the plan itself.
LOCAL_MAX_ROWS = 20_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Measure rows and text bytes with one partial aggregation, so the check itself scales."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> DataFrame:
    """Hint a broadcast when the measured size allows it; otherwise leave a shuffle join that AQE can split."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. Only a local session may fall back to a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="litscreen-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/litscreen-stage/{name}-{uuid.uuid4().hex}"


# Of the run that is going on in this thread: a stream beside it has its own.
_SCOPE: ContextVar[list[str] | None] = ContextVar("staged tables", default=None)


@contextmanager
def stages_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete every table staged inside, at the end. Nothing that reads them may be used after that."""
    paths: list[str] = []
    before = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for path in paths:
            delete_folder(spark, path)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete_folder(spark: SparkSession, path: str) -> None:
    system, where = _folder(spark, path)
    system.delete(where, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    system, where = _folder(spark, path)
    return system.exists(where)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``, if it is there."""
    system, where = _folder(spark, path)
    return [f.getPath().getName() for f in system.listStatus(where) if f.isDirectory()] if system.exists(where) else []


def file_sizes(spark: SparkSession, path: str) -> list[int]:
    """Bytes of each data file directly under ``path``, if it is there."""
    system, where = _folder(spark, path)
    found = [f for f in system.listStatus(where) if f.isFile()] if system.exists(where) else []
    return [f.getLen() for f in found if not f.getPath().getName().startswith(("_", "."))]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that a lost executor never repeats the work before it, keeps columns prunable, and gives the
    planner the true size. Used for results far smaller than the corpus.
    """
    path = stage_path(df.sparkSession, name)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, name: str, max_rows: int = LOCAL_MAX_ROWS) -> DataFrame:
    """Compute a small table that is used several times once, ready for joins.

    Up to ``max_rows`` rows (what people type in, or a question's words) become part of the plan. A larger table is
    staged instead, and broadcast only if its measured size allows it.
    """
    # The coalesce makes every partition work on its share at once; a bare limit would try them a few at a time.
    rows = df.limit(max_rows + 1).coalesce(1).collect()
    if len(rows) > max_rows:
        return broadcast_if_small(stage(df, name))
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def once(value: Column) -> Column:
    """Compute a costly column exactly once per row.

    A filter or a second use would otherwise be rewritten to the whole expression, and each copy evaluated again. The
    one-element explode is a line the optimizer does not move expressions across.
    """
    return F.explode(F.array(value))


def spread_small_scan(df: DataFrame) -> DataFrame:
    """Give every core work when a scan has fewer splits than cores; large scans are returned untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

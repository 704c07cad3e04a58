"""The keyed result table: one row per (inputs, article), kept as partitioned Parquet.

Rows are spread over ``key_bucket`` partitions by a hash of their key. A write reads and rewrites only the buckets it
touches, from a copy that is complete in the shared folder before anything is replaced. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litscreen.functions import fixed
from litscreen.functions.scale import broadcast_if_small, delete_folder, file_sizes, folder_exists, stage
from litscreen.spec import ReviewSpec

BUCKETS = 256
BUCKET = "key_bucket"

# A bucket with more small files than this, and than files that aren't small, is written anew as a whole.
MAX_SMALL_FILES = 8
SMALL_FILE_BYTES = 64 * 1024 * 1024
_BUCKETS_PROPERTY = "litscreen.buckets"
_NEXT_ID_PROPERTY = "litscreen.next_id"


# -- columns ---------------------------------------------------------------------------------------------------------


def sql_columns(spec: ReviewSpec) -> list[tuple[str, str]]:
    """Column names and their declared SQL types, the id first. Metadata columns are long text."""
    columns = [("id", "INT")] + [(m, "LONGTEXT") for m in spec.to_save]
    return columns + [(c.name, c.sql_type) for c in (*spec.inputs, *spec.features)]


def result_schema(spec: ReviewSpec) -> T.StructType:
    """Spark columns of the stored table: JSON and text are strings, numbers keep their type; ids are 64 bits wide."""
    plain = {"BOOL": T.BooleanType(), "INT": T.LongType(), "FLOAT": T.DoubleType()}
    return T.StructType([T.StructField(name, plain.get(kind, T.StringType())) for name, kind in sql_columns(spec)])


def project_columns(df: DataFrame, spec: ReviewSpec, *helpers: str) -> DataFrame:
    """Metadata, inputs, features, in that order, then any helper columns; a missing column is an error."""
    missing = [c for c in (*spec.columns, *helpers) if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the result: {missing}")
    return df.select(*spec.columns, *helpers)


def serialise_record(df: DataFrame) -> DataFrame:
    """Lists, maps and structs to JSON text; scalars untouched."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


# -- lookups ---------------------------------------------------------------------------------------------------------


def _stored_for(pairs: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows with a key of ``pairs``. While the work list is small (measured) the table does not shuffle."""
    return results.join(broadcast_if_small(pairs.select(*keys)), list(keys), "left_semi")


def find_existing(pairs: DataFrame, results: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """Add the id of the stored record, null if there is none, the lowest if there are several.

    Minimum per key combines before it shuffles, so a key stored very often costs one row per task.
    """
    lowest = _stored_for(pairs, results.select(*keys, id_col), keys).groupBy(*keys).agg(F.min(id_col).alias(id_col))
    return pairs.join(lowest, list(keys), "left")


def pending_extractions(
    pairs: DataFrame, results: DataFrame, keys: Sequence[str], overwrite: bool = False
) -> DataFrame:
    """Pairs still to do: those without a stored record, or all of them when overwriting."""
    if overwrite:
        return pairs
    return pairs.join(_stored_for(pairs, results.select(*keys), keys).distinct(), list(keys), "left_anti")


def _largest_id(results: DataFrame, id_col: str = "id") -> int:
    return results.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()[0]


def assign_record_ids(
    new_rows: DataFrame, results: DataFrame, order_by: Sequence[str], id_col: str = "id", start: int | None = None
) -> DataFrame:
    """Number new rows upwards from the largest stored id, in the order of ``order_by``, without gaps.

    With ``start``, the last id that is taken, the stored rows aren't read.

    Rows are range-partitioned and sorted, and their place is stored before it is used: an id is the number of rows in
    the partitions before plus the place within its own. Only one count per partition is ever brought together.
    """
    if start is None:
        start = _largest_id(results, id_col)
    ordered = new_rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = stage(ordered.withColumn("__place", F.monotonically_increasing_id()), "record-ids")
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    row = F.col("__place").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")  # one row per partition
        .withColumn(id_col, F.lit(start) + F.col("__offset") + row + 1)
        .select(id_col, *new_rows.columns)
    )


# -- writes ----------------------------------------------------------------------------------------------------------


def one_per_key(incoming: DataFrame, keys: Sequence[str], order_col: str, overwrite: bool) -> DataFrame:
    """What writing the rows one after another would leave: the first per key, or the last when overwriting."""
    values = [c for c in incoming.columns if c not in keys]
    pick = F.max_by if overwrite else F.min_by
    kept = incoming.groupBy(*keys).agg(pick(F.struct(*values), F.col(order_col)).alias("__row"))
    return kept.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in values if c != order_col])


def _merged(results: DataFrame, updates: DataFrame, id_col: str) -> DataFrame:
    """Stored rows, with the whole row replaced where an update carries its id."""
    columns = [c for c in results.columns if c != id_col]
    new = updates.select(id_col, F.struct(*columns).alias("__new"))
    joined = results.join(new, id_col, "left")
    changed = F.col("__new").isNotNull()
    return joined.select(
        id_col, *[F.when(changed, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    )


def upsert_results(
    results: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order_col: str,
    overwrite: bool = False,
    id_col: str = "id",
) -> DataFrame:
    """The table after the write: new keys appended, known keys replaced under their id when ``overwrite``."""
    columns = results.columns
    found = stage(find_existing(one_per_key(incoming, keys, order_col, overwrite), results, keys, id_col), "incoming")
    fresh = assign_record_ids(found.filter(F.col(id_col).isNull()).drop(id_col), results, keys, id_col)
    kept = _merged(results, found.filter(F.col(id_col).isNotNull()), id_col) if overwrite else results
    return kept.select(*columns).unionByName(fresh.select(*columns))


def key_bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_result_table(
    spark: SparkSession, table: str, spec: ReviewSpec, buckets: int = BUCKETS, location: str | None = None
) -> None:
    """Create the table if it is not there yet. Rows that lie at ``location`` already belong to it."""
    where = f" LOCATION '{location}'" if location else ""
    attached = bool(location) and folder_exists(spark, location)
    mark = "" if attached else f", '{_NEXT_ID_PROPERTY}' = '1'"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in result_schema(spec))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {BUCKET} int) USING parquet PARTITIONED BY ({BUCKET}) "
        f"TBLPROPERTIES ('{_BUCKETS_PROPERTY}' = '{buckets}'{mark}){where}"
    )
    if attached:
        spark.sql(f"MSCK REPAIR TABLE {table}")


def reset_result_table(spark: SparkSession, table: str, spec: ReviewSpec, buckets: int = BUCKETS) -> None:
    """Delete the table with its rows and create it anew where it was."""
    location = None
    if spark.catalog.tableExists(table):
        about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
        location = about["Location"] if about.get("Type") == "EXTERNAL" else None
        spark.sql(f"DROP TABLE {table}")
        if location:
            delete_folder(spark, location)
    create_result_table(spark, table, spec, buckets, location)


def read_results(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).drop(BUCKET)


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def _n_buckets(spark: SparkSession, table: str) -> int:
    return int(_properties(spark, table)[_BUCKETS_PROPERTY])


def claim_ids(spark: SparkSession, table: str, n: int) -> int:
    """Take the next ``n`` ids and return the first of them.

    The table's mark is raised before any row is written, so a write that fails leaves a gap and never an id that is given
    twice. Only a table that was attached with its rows has no mark yet: then, once, the largest id is looked up.
    """
    mark = _properties(spark, table).get(_NEXT_ID_PROPERTY)
    first = int(mark) if mark else _largest_id(spark.table(table)) + 1
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_NEXT_ID_PROPERTY}' = '{first + n}')")
    return first


def results_near(spark: SparkSession, table: str, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows of the partitions that hold a key of ``pairs``; the others are not read."""
    touched = pairs.select(key_bucket(keys, _n_buckets(spark, table)).alias(BUCKET)).distinct().collect()
    return spark.table(table).filter(F.col(BUCKET).isin([r[0] for r in touched])).drop(BUCKET)


def _location(spark: SparkSession, table: str) -> str:
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    return about["Location"]


def _replace_buckets(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """Put ``rows``, which hold whole buckets, in the place of those buckets. They are complete in the shared folder
    before anything is replaced."""
    copy = stage(rows.select(*spark.table(table).columns), "buckets")
    previous = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        copy.hint("rebalance", BUCKET).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", previous)


def _is_scattered(sizes: Sequence[int], max_small: int) -> bool:
    small = sum(size < SMALL_FILE_BYTES for size in sizes)
    return small > max(max_small, len(sizes) - small)


def compact_results(
    spark: SparkSession, table: str, buckets: Sequence[int] | None = None, max_small_files: int | None = None
) -> list[int]:
    """Write buckets that small appends have scattered anew, and return their numbers.

    ``buckets`` limits the look to some buckets. A bucket is due when it has more than ``max_small_files`` small files
    (``MAX_SMALL_FILES`` if not given) and more of them than others: the files of a bucket stay bounded by its size, and
    a large bucket is rewritten only after many appends. Rows and ids stay as they are.
    """
    limit = MAX_SMALL_FILES if max_small_files is None else max_small_files
    place = _location(spark, table)
    looked_at = range(_n_buckets(spark, table)) if buckets is None else buckets
    due = [b for b in looked_at if _is_scattered(file_sizes(spark, f"{place}/{BUCKET}={b}"), limit)]
    if due:
        _replace_buckets(spark, table, spark.table(table).filter(F.col(BUCKET).isin(due)))
    return due


def write_results(
    spark: SparkSession, table: str, incoming: DataFrame, spec: ReviewSpec, order_col: str, overwrite: bool = False
) -> DataFrame:
    """Upsert into the stored table; returns the written rows ``(id, keys, is_new)``.

    Without updates the new rows are appended, and a touched bucket that many small appends have scattered is compacted.
    With updates every touched bucket is first written out complete in the shared folder, then put in place by a dynamic
    partition overwrite; writing the same rows again changes nothing.
    """
    keys = spec.keys
    buckets = _n_buckets(spark, table)
    rows = one_per_key(incoming, keys, order_col, overwrite).withColumn(BUCKET, key_bucket(keys, buckets))
    rows = stage(rows, "incoming")
    touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most one per bucket
    if not touched:
        return rows.select(F.lit(None).cast("long").alias("id"), *keys, F.lit(True).alias("is_new"))
    stored = spark.table(table)
    nearby = stored.filter(F.col(BUCKET).isin(touched))
    found = stage(find_existing(rows, nearby, keys), "found")
    known = found.filter(F.col("id").isNotNull())
    n_new, n_known = found.agg(F.count_if(F.col("id").isNull()), F.count("id")).first()
    fresh = found.limit(0)
    if n_new:
        taken = claim_ids(spark, table, n_new) - 1
        fresh = assign_record_ids(found.filter(F.col("id").isNull()).drop("id"), stored, keys, start=taken)
    columns = stored.columns

    if overwrite and n_known:
        _replace_buckets(spark, table, _merged(nearby, known, "id").select(*columns).unionByName(fresh.select(*columns)))
    elif n_new:
        fresh.select(*columns).hint("rebalance", BUCKET).write.insertInto(table)
        compact_results(spark, table, touched)
    written = fresh.select("id", *keys, F.lit(True).alias("is_new"))
    return written.unionByName(known.select("id", *keys, F.lit(False).alias("is_new"))) if overwrite else written

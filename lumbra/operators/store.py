"""Tables of documents or chunks kept in hash buckets of their key, of which a change rewrites only those it touches.

A table is a Parquet folder partitioned by ``balde``, the bucket of its key, in most tables ``documento_chave``.  A
change finds the buckets of its keys (at most as many numbers as there are buckets), reads
only their partitions, once, and writes them anew by dynamic partition overwrite: files are
staged beside the table and moved in when all tasks are done, so a change that fails before
that leaves the table as it was.  Each written bucket also holds a row without a key, which
readers pass over: a bucket that loses all its documents is written like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index

KEY = "documento_chave"
BUCKET = "balde"


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _layout(path: str) -> str:
    return f"{path.rstrip('/')}/_layout"


def _read_layout(spark: SparkSession, path: str) -> tuple[int, str]:
    """The number of buckets and the key of a table."""
    return tuple(spark.read.schema("buckets int, key string").json(_layout(path)).first())


def _write(rows: DataFrame, path: str, marks: DataFrame, key: str) -> None:
    """Rows and a mark per bucket, dealt to files by bucket; adaptive execution splits a bucket that is too large for a task."""
    marked = rows.where(F.col(key).isNotNull()).unionByName(marks, allowMissingColumns=True)
    marked.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create_table(rows: DataFrame, path: str, buckets: int = 1024, key: str = KEY) -> None:
    """Lay out a table in a new folder; rows without a key are dropped.

    With as many buckets as a run changes documents, or more, a run leaves at least a third
    of them alone; a bucket should still fill a file.
    """
    spark = rows.sparkSession
    spark.createDataFrame([(buckets, key)], "buckets int, key string").coalesce(1).write.json(_layout(path))
    _write(rows.withColumn(BUCKET, bucket_of(F.col(key), buckets)), path, spark.range(buckets).select(F.col("id").cast("int").alias(BUCKET)), key)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table as they are now."""
    return spark.read.parquet(path).where(F.col(_read_layout(spark, path)[1]).isNotNull()).drop(BUCKET)


def rewrite_buckets(spark: SparkSession, path: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Apply ``change`` to the buckets that hold the keys, and say which they are.

    ``change`` gets the rows of those buckets and returns those to be in their place, all of
    keys of the same buckets.
    """
    buckets, key = _read_layout(spark, path)
    touched = sorted(r[0] for r in keys.where(F.col(key).isNotNull()).select(bucket_of(F.col(key), buckets)).distinct().collect())
    if touched:
        table = spark.read.parquet(path)
        old = table.where(F.col(BUCKET).isin(touched) & F.col(key).isNotNull()).drop(BUCKET)
        rows = change(old).withColumn(BUCKET, bucket_of(F.col(key), buckets))
        _write(rows, path, spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int"), key)
    return touched


def upsert_stored(spark: SparkSession, path: str, new: DataFrame, now: Column) -> list[int]:
    """Put new and changed documents into a stored table, with stamps as in :func:`index.upsert_documents`."""
    return rewrite_buckets(spark, path, new, lambda old: index.upsert_documents(old, new, now))


def replace_stored_chunks(spark: SparkSession, path: str, new: DataFrame, processed: DataFrame) -> list[int]:
    """Put new chunks in place of all those of the processed documents, which must hold the new ones' keys."""
    return rewrite_buckets(spark, path, processed, lambda old: index.replace_chunks(old, new, processed))


def remove_stored(spark: SparkSession, path: str, keys: DataFrame) -> list[int]:
    """Take documents, or their chunks, out of a stored table; unknown keys change nothing."""
    return rewrite_buckets(spark, path, keys, lambda old: index.remove_documents(old, keys))

"""Exact dedup: texts that are identical but for white space, by 128-bit hashes whose groups are compared byte for byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

_SPACE = " \t\n\x0b\x0c\r"


def without_space(text: Column) -> Column:
    """A text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in _SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def hash_128(text: Column) -> Column:
    """128 bits of a text's content, as 16 bytes."""
    return F.unhex(F.md5(text))


def _groups(rows: DataFrame) -> DataFrame:
    """Of each key with several rows: their number and the row that stays (``keep_id``, ``keep_row``).

    The longest original text stays, then the smallest id (null after all others), then of
    repeated rows one.  Rows are summed up by ever shorter keys, so those of a hot key are
    dealt by their ids first and reach the key's task as one row from each task.
    """
    by_id = rows.groupBy("_key", "_chars", "_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_row"))
    by_length = by_id.groupBy("_key", "_chars").agg(
        F.sum("_n").alias("_n"), F.coalesce(F.min_by("_row", "_id"), F.min("_row")).alias("_row"), F.min("_id").alias("_id")
    )
    by_key = by_length.groupBy("_key").agg(
        F.sum("_n").alias("group_size"), F.max_by("_row", "_chars").alias("keep_row"), F.max_by("_id", "_chars").alias("keep_id")
    )
    return materialise(by_key.where("group_size > 1"), "equal-groups")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = hash_128
) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id, group_size, kept, text_sha256, n_chars``.

    Texts are equal when identical after ASCII white space is deleted.  Of equal ones the row
    of most code points stays, then that of the smallest id, a null id last; of rows repeated
    with their id one is ``kept``.  Null and empty texts, and those of white space alone, are
    equal.  Texts are read whole; other columns, whatever their names, are not read; an empty
    table gives no rows.

    Rows are grouped by ``hashed`` texts; only hashes, lengths and ids are shuffled.  Then the
    texts of groups of several rows meet, each distinct one once from each task, and where a
    hash turns out to have several texts its groups are formed again by the texts themselves.
    """
    norm = without_space(F.col(text_col))
    read = docs.select(F.col(id_col).alias("_id"), norm.alias("_text"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_chars"))
    slim = [F.unhex(F.sha2("_text", 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row")]
    # written, so that row numbers stay as they are
    rows = materialise(read.select("_id", "_chars", hashed(F.col("_text")).alias("_key"), *slim), "hashed-texts")
    groups = _groups(rows)

    keyed = read.select(hashed(F.col("_text")).alias("_key"), "_text")
    # distinct by text, not by hash, so that the join before may split a hot hash
    texts = keyed.join(groups.select("_key"), "_key", "left_semi").select("_text").distinct().select(hashed(F.col("_text")).alias("_key"), "_text")
    clashes = materialise(texts.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "hash-clashes")
    if not clashes.isEmpty():
        number = F.row_number().over(Window.partitionBy("_key").orderBy("_text"))
        apart = materialise(texts.join(clashes, "_key", "left_semi").select("_key", "_text", number.alias("_nth")), "clashing-texts")
        told = read.withColumn("_key", hashed(F.col("_text"))).join(apart, ["_key", "_text"], "left")
        key = F.concat("_key", F.coalesce(F.col("_nth").cast("string"), F.lit("")).cast("binary"))
        rows = materialise(told.select("_id", "_chars", key.alias("_key"), *slim), "hashed-texts")
        groups = _groups(rows)

    alone = F.col("group_size").isNull()
    return rows.join(groups, "_key", "left").select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("_row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        F.col("_chars").alias("n_chars"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, all columns as they are.

    Of rows repeated with their id and length, which other columns may tell apart, any one stays.
    """
    marked = exact_duplicates(docs, id_col, text_col)
    alike = ["_of", "_sha", "_chars"]
    kept = marked.groupBy(F.col(id_col).alias("_of"), F.col("text_sha256").alias("_sha"), F.col("n_chars").alias("_chars")).agg(
        F.bool_or("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")
    )
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumns(
        {"_id": F.col(f"row.`{id_col}`"), "_hash": F.sha2(without_space(text), 256), "_length": F.length(text).cast("long")}
    )
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_sha")) & (F.col("_length") == F.col("_chars"))
    stay = rows.join(kept.where("_kept"), same)
    once = stay.where("_rows = 1").unionByName(stay.where("_rows > 1").dropDuplicates(alike))
    return once.select("row.*")

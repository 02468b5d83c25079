"""Line dedup: lines found in many documents go from every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line stripped of ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def kept_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns), ``n_lines, n_dropped`` and ``kept`` (the text of the lines that stay).

    Lines are the parts of a text between ``\n``; null and empty texts have one empty line.
    Keys of at least ``min_chars`` code points that stand in at least ``min_docs`` different
    ids lose all their lines; rows with a null id count as one document.  A text that loses
    all lines gets an empty ``kept``.  Repeated rows are each kept; a text of any length is
    read whole; an empty table gives no rows.

    Exploded lines carry two hashes (96 bits) instead of the line, so the whole text is
    shuffled once only, by document, to be reassembled.  Documents of a key are counted
    distinct by (key, id) first, so that a line that stands in a third of all documents
    reaches no task whole; keys over the threshold meet their lines in a join that adaptive
    execution splits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = materialise(
        docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.hash("_key").alias("_h2")),
        "lines",
    )
    # written, so that the join below deals lines anew and can split those of one hot key
    common = materialise(
        lines.select("_h1", "_h2", "_id").distinct().groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs).select("_h1", "_h2"),
        "common-lines",
    )
    dropped = lines.join(common, ["_h1", "_h2"], "left_semi").groupBy("_id", "_text").agg(F.collect_set("_pos").alias("_drop"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text).alias("_of"))
    joined = rows.join(dropped.hint("shuffle_hash"), F.col(f"row.{id_col}").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left")
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    parts = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.col("_parts")[i]), "\n"))
    return joined.withColumn("_parts", parts).select(
        "row", F.size("_parts").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")
    )


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines, n_dropped`` and ``kept`` as :func:`kept_lines` finds them; its own columns of these names are replaced."""
    own = [f"row.`{c}`" for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    return kept_lines(docs, min_docs, min_chars, id_col, text_col).select(*own, "n_lines", "n_dropped", "kept")

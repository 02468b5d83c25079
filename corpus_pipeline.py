"""A training corpus from ``documents`` in five stages, each written as Parquet and read again.

Documents of bad quality go, then lines that many documents share, then all but one of each
group of near-duplicates; what is left is mixed by source and packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbra.llm.line_dedup import kept_lines
from lumbra.llm.mixture import draw_mixture
from lumbra.llm.near_dedup import keep_one_of_each
from lumbra.llm.packing import pack_documents
from lumbra.llm.quality import keep_good, train_quality
from lumbra.llm.storage import shared_dir
from lumbra.llm.tokens import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts, all columns as they are.

    Null and empty texts are judged like others; repeated rows go or stay together; texts are
    read whole; an empty table gives no rows.
    """
    return keep_good(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines found in ten or more, ``n_chars`` counted anew where lines went.

    A document that had only such lines stays, with an empty text, for the next stage to see
    to; a null text stays null; repeated rows are each kept; other columns, whatever their
    names, stay as they are; an empty table gives no rows.
    """
    kept = kept_lines(docs)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    out = [F.when(F.col("n_dropped") > 0, changed[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns]
    return kept.select(*out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates, all columns as they are.

    Of repeated rows, and of null and empty texts, one is left; an empty table gives no rows.
    """
    return keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them, all columns as they are.

    A null source is a source; documents without words have no copy beyond whole epochs;
    repeated rows are documents of their own; an empty table gives no rows.
    """
    return draw_mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of 4096 tokens: id, ``piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are the end id alone; long texts are cut, not shortened; repeated rows
    are packed each; an empty table gives no rows; other columns are not read.
    """
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: No SQL: classifiers, signatures and packing can't be expressed; tests hold stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

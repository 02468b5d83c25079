"""The index: tables of documents and chunks, replaced by set operations.

Every function returns the new table; write it to a new version's folder, never over the
one being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_documents(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Documents with ``new`` ones (all columns but the stamps) in place of those of equal key; both are read once.

    ``criado_em`` stays as it was; ``atualizado_em`` and ``ingerido_em`` are ``now``.
    """
    stamps = {"criado_em": F.coalesce("o.criado_em", now), "atualizado_em": now, "ingerido_em": now}
    fresh = new.drop(*stamps).withColumn("_new", F.lit(True)).alias("n")
    joined = old.alias("o").join(fresh, F.col("o.documento_chave") == F.col("n.documento_chave"), "full_outer")
    is_new = F.col("n._new").isNotNull()
    return joined.select(*[F.when(is_new, stamps[c] if c in stamps else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns])


def replace_chunks(old: DataFrame, new: DataFrame, processed: DataFrame) -> DataFrame:
    """Chunks where those of all ``processed`` documents (``documento_chave``) are replaced by ``new`` ones."""
    return old.join(processed.select("documento_chave").distinct(), "documento_chave", "left_anti").unionByName(new)


def remove_documents(table: DataFrame, keys: DataFrame) -> DataFrame:
    """A table of documents or chunks without those of some keys; unknown keys change nothing."""
    return table.join(keys.select("documento_chave").distinct(), "documento_chave", "left_anti")


def ingest_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: chunks, those with metadata, their mean length and the models used; without chunks 0, 0 and nulls."""
    per = chunks.groupBy("documento_chave").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(F.col("palavras_chave").isNotNull()).alias("chunks_enriquecidos"),
        F.avg("n_caracteres").alias("media_caracteres"),
        F.max("modelo_llm").alias("modelo_llm"),
        F.max("modelo_embedding").alias("modelo_embedding"),
    )
    joined = documents.select("documento_chave", "titulo").join(per, "documento_chave", "left")
    return joined.fillna(0, ["total_chunks", "chunks_enriquecidos"])


def search_view(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with the fields of their document that searches need."""
    of = documents.select("documento_chave", F.col("titulo").alias("documento_titulo"), "ano", "tema", "regional", "fonte")
    return chunks.join(of, "documento_chave")


def run_summary(pending: DataFrame, chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: documents processed and unchanged (``pendente``), new chunks and removed documents."""
    docs = pending.agg(F.count_if("pendente").alias("documentos"), F.count_if(~F.col("pendente")).alias("inalterados"))
    return docs.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks"))).crossJoin(removed.agg(F.count(F.lit(1)).alias("removidos")))  # one row each


def status_totals(rows: DataFrame) -> DataFrame:
    """Rows per ``status``."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("quantidade"))


def vector_text(vector: Column) -> Column:
    """A vector as JSON text with eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))

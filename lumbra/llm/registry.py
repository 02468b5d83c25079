"""Queries of this subpackage: each applies its operator to a whole table, with production settings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import score_links
from .exact_dedup import exact_duplicates
from .fingerprints import fingerprint_documents
from .license_scan import scan_licenses
from .line_dedup import drop_common_lines
from .mixture import mix_sources
from .near_dedup import near_duplicates
from .packing import pack_documents
from .period_runs import find_runs
from .pii import KINDS, find_personal_data
from .quality import score_quality, train_quality
from .storage import shared_dir
from .token_files import read_token_shards, write_token_shards
from .tokens import vocabulary
from .topk_index import search_top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document; base phrases in columns of their own."""
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    kept = F.filter("detections", lambda d: d["kept"])
    joined = lambda part: F.array_join(F.array_sort(F.array_distinct(F.transform(part, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(kept).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: d["score"])), F.lit(0.0)).alias("score"),
        F.size(kept).cast("long").alias("n_kept"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a 5:2:1 mixture of all sources takes."""
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines found in ten documents or more."""
    kept = drop_common_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and its edited text."""
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document from co-trained text and page classifiers."""
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, _table(spark, sf_dir, "labels")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    written = lambda part: F.array_join(F.transform(part, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written as Re-Pair shards and read back."""
    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_token_shards(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0, base=50_257)
    return read_token_shards(spark, path)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector against all."""
    vectors = _table(spark, sf_dir, "embeddings")
    return search_top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every document, and whether it stays."""
    return exact_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two public vocabularies align in every document, and how common the links are."""
    scored = score_links(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _edited(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where one in ten texts, by the check sum of its id, repeats some of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.when(n > 0, g % n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: words[F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")]), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # as the one item of an array, so that words are found once and not for each of their places
    edited = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, edited).otherwise(F.col("text")).alias("text"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of at least twelve words that repeat, in every document (one in ten edited to hold one)."""
    found = find_runs(_edited(_table(spark, sf_dir, "documents")))
    written = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    best = found.withColumn("_best", longest)
    length = -F.col("_best.less")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        length.alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(1000 * length / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(written, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_mix_sources, op3_line_dedup, op4_near_dedup, op5_fingerprints, op6_quality, op7_pii, op8_best_fit_packing,
        op9_token_files, op10_top_k, op11_exact_dedup, op12_align_tokens, op13_period_runs,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op10_top_k": """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op11_exact_dedup": r"""
WITH bare AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER best = 1 AS kept, sha256(t) AS text_sha256
FROM bare WINDOW best AS (PARTITION BY t ORDER BY n DESC, doc_id)
""",
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (common.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.k = common.k GROUP BY doc_id
""",
}

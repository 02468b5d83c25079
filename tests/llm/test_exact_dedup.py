"""Exact dedup against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumbra.llm import registry
from lumbra.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, hash_128

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "\t\n\x0b\x0c\r ", "a b", "ab", "a\nb", "a  b", "A b", "a b", "x" * 200_000, "x " * 200_000, "é", "é", "ab", "\x00", "\x1f", "a\x85b"]


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def expected(rows):
    """``id, keep_id, group_size, text_sha256, n_chars`` of each row, and per class how many rows stay: one."""
    classes = defaultdict(list)
    for i, text in rows:
        classes[bare(text)].append((-len(text or ""), i is None, i))
    out = []
    for i, text in rows:
        members = classes[bare(text)]
        out.append((i, min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2], len(members), hashlib.sha256(bare(text).encode()).hexdigest(), len(text or "")))
    return sorted(out, key=repr), len(classes)


def rows_of(marked):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"], r["n_chars"]) for r in marked), key=repr)


def few_hashes(text):
    """Three hashes for all texts."""
    return F.unhex(F.format_string("%02x", F.length(text) % 3))


@pytest.mark.parametrize("hashed", [hash_128, few_hashes])
def test_equals_plain_grouping(spark, hashed):
    """Also where hashes clash: groups are told apart by their texts."""
    texts = [*TEXTS, *TEXTS[3:9]]
    rows = [(100 - n, t) for n, t in enumerate(texts)] + [(None, "a b"), (None, "only null id"), (100 - 4, "a b"), (100 - 4, "a b")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, kept string, keep_id int").repartition(3)
    marked = exact_duplicates(docs, hashed=hashed).collect()
    want, classes = expected(rows)
    assert rows_of(marked) == want
    kept = [r for r in marked if r["kept"]]
    assert len(kept) == classes == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, classes = expected(rows)
    marked = exact_duplicates(docs).collect()
    assert rows_of(marked) == want and sum(r["kept"] for r in marked) == classes < len(rows)
    got = registry.op11_exact_dedup(spark, SF)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and got.count() == len(rows)


def test_one_hot_group(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("hot"), F.repeat(F.lit(" "), (F.col("id") % 7).cast("int")))).otherwise(F.col("id").cast("string")).alias("text"))
    marked = exact_duplicates(docs)
    hot = marked.where("group_size > 1").agg(F.count(F.lit(1)), F.max("group_size"), F.min("keep_id"), F.max("keep_id"), F.count_if("kept")).first()
    size = sum(n % 3 > 0 for n in range(20_000))
    keep = min(n for n in range(20_000) if n % 3 > 0 and n % 7 == 6)
    assert tuple(hot) == (size, size, keep, keep, 1)


def test_rows_that_stay(spark):
    rows = [(1, "a b", "u"), (2, "a  b", "v"), (2, "a  b", "w"), (3, "c", "x"), (None, None, "y"), (4, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row.x` string")
    stay = drop_exact_duplicates(docs)
    assert stay.columns == docs.columns
    got = sorted(((r[0], r[1]) for r in stay.collect()), key=repr)
    assert got == [(2, "a  b"), (3, "c"), (4, "")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(docs).collect() == [] and drop_exact_duplicates(docs).collect() == []

"""Tables in buckets: what a change rewrites, and that it changes what it should."""

from pathlib import Path

from pyspark.sql import functions as F

from lumbra.operators import store


def files(path):
    """Data files by bucket."""
    out = {}
    for f in Path(path).rglob("part-*.parquet"):
        out.setdefault(int(f.parent.name.split("=")[1]), set()).add((f.name, f.stat().st_mtime_ns))
    return out


def keys_of(path, spark):
    return sorted(r[0] for r in store.read_table(spark, path).select("documento_chave").collect())


def documents(spark, n):
    stamps = {c: F.lit("2025") for c in ("criado_em", "atualizado_em", "ingerido_em")}
    return spark.range(n).select(F.concat(F.lit("d"), "id").alias("documento_chave"), F.lit("velho").alias("titulo")).withColumns(stamps)


def test_upsert_rewrites_only_buckets_of_its_keys(spark, tmp_path):
    path = f"{tmp_path}/docs"
    store.create_table(documents(spark, 2000), path, buckets=100)
    before = files(path)
    assert set(before) == set(range(100))
    new = spark.createDataFrame([(f"d{n}", "novo") for n in range(0, 2000, 100)] + [("x", "novo")], "documento_chave string, titulo string")
    touched = store.upsert_stored(spark, path, new, F.lit("2026"))
    after = files(path)
    want = {r[0] for r in new.select(store.bucket_of(F.col("documento_chave"), 100)).collect()}
    assert set(touched) == want and 5 < len(want) <= 21
    assert {b for b in before if before[b] != after[b]} == want
    rows = {r["documento_chave"]: r for r in store.read_table(spark, path).collect()}
    assert len(rows) == 2001 == store.read_table(spark, path).count()
    assert {k for k, r in rows.items() if r["titulo"] == "novo"} == {"x", *(f"d{n}" for n in range(0, 2000, 100))}
    assert (rows["d100"]["criado_em"], rows["d100"]["atualizado_em"], rows["x"]["criado_em"], rows["d1"]["ingerido_em"]) == ("2025", "2026", "2026", "2025")
    # a second run of the same changes leaves the same table
    store.upsert_stored(spark, path, new, F.lit("2026"))
    assert {r["documento_chave"]: r for r in store.read_table(spark, path).collect()} == rows


def test_old_buckets_are_pruned_and_read_once(spark, tmp_path):
    path = f"{tmp_path}/docs"
    store.create_table(documents(spark, 300), path, buckets=20)
    plans = []

    def change(old):
        plans.append(old._jdf.queryExecution().toString())
        return old

    store.rewrite_buckets(spark, path, spark.createDataFrame([("d7",)], "documento_chave string"), change)
    assert "PartitionFilters: [balde" in plans[0].replace("isnotnull(balde#", "balde(") or "balde" in plans[0].split("PartitionFilters:")[1][:80]
    assert store.read_table(spark, path).count() == 300


def test_emptied_buckets_and_unknown_keys(spark, tmp_path):
    path = f"{tmp_path}/docs"
    store.create_table(documents(spark, 50).unionByName(documents(spark, 1).withColumn("documento_chave", F.lit(None).cast("string"))), path, buckets=400)
    gone = spark.createDataFrame([(f"d{n}",) for n in range(0, 50, 2)] + [("unknown",), (None,)], "documento_chave string")
    store.remove_stored(spark, path, gone)
    assert keys_of(path, spark) == sorted(f"d{n}" for n in range(1, 50, 2))
    assert store.remove_stored(spark, path, gone.where("documento_chave IS NULL")) == []
    store.remove_stored(spark, path, documents(spark, 50))
    assert keys_of(path, spark) == []
    store.upsert_stored(spark, path, documents(spark, 3).select("documento_chave", "titulo"), F.lit("2026"))
    assert keys_of(path, spark) == ["d0", "d1", "d2"]


def test_chunks_of_a_large_document_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    chunks = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit("big")).otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("documento_chave"), F.col("id").alias("chunk_indice"), F.lit("a").alias("lote"))
    store.create_table(chunks, path, buckets=30)
    done = spark.createDataFrame([("big",), ("d3",), ("nada",)], "documento_chave string")
    new = spark.createDataFrame([("big", k, "b") for k in range(7)] + [("nada", 0, "b")], "documento_chave string, chunk_indice long, lote string")
    store.replace_stored_chunks(spark, path, new, done)
    got = {(r[0], r[1]): r[2] for r in store.read_table(spark, path).groupBy("documento_chave", "lote").count().collect()}
    assert got == {("big", "b"): 7, ("nada", "b"): 1, **{(f"d{k}", "a"): 40 for k in range(50) if k != 3}}


def test_frequencies_follow_the_corpus(spark, tmp_path):
    import random

    from lumbra.operators import tfidf

    rng, path = random.Random(8), f"{tmp_path}/df"
    word = lambda: rng.choice(["alfa", "beta", "gama", "delta", "comum"]) + (str(rng.randrange(300)) if rng.random() < 0.7 else "")
    corpus = {k: ["comum " + word(), word()] if k % 7 else None for k in range(120)}
    rows = lambda keys: spark.createDataFrame([(k, corpus[k]) for k in keys], "k int, termos array<string>")
    got = lambda: sorted(map(tuple, tfidf.stored_frequencies(spark, path).collect()))
    want = lambda: sorted(map(tuple, tfidf.document_frequency(rows(corpus), ["k"]).collect()))
    tfidf.store_frequencies(rows(corpus), path, buckets=500)
    assert got() == want()
    gone = rows(range(4))
    for k in range(3):
        del corpus[k]
    corpus[3] = ["outro texto", "comum"]
    corpus[500] = ["novo"]
    touched = tfidf.update_frequencies(spark, path, gone, rows([3, 500]))
    assert got() == want() and 0 < len(touched) < 60
    # what is replaced by itself changes no bucket
    before = files(path)
    assert tfidf.update_frequencies(spark, path, rows([9, 10]), rows([9, 10])) == [] and files(path) == before
    everything = rows(corpus)
    corpus.clear()
    tfidf.update_frequencies(spark, path, everything, rows([]))
    assert got() == []

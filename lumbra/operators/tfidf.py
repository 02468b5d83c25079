"""Metadata of chunks: clean-up, terms, and terms weighted by TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, tokens
from ..functions.vocab import STOPWORDS
from ..sources.scratch import written
from . import store

LISTS = ["palavras_chave", "entidades", "indicadores", "fontes_dados", "perguntas_atendidas"]
SCALARS = ["tipo_conteudo", "resumo", "intencao"]
MAX_TERMS = 25


def reply_json(reply: Column) -> Column:
    """The JSON object in a reply: without a code fence, else from the first ``{`` to the last ``}``; else null."""
    text = strip(reply)
    bare = F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(text)
    inner = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    valid = lambda c: F.get_json_object(c, "$").isNotNull() & c.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.when(valid(bare), bare).when(valid(inner), inner)


def _said(value: Column) -> Column:
    """A JSON value as text: names of constants as the jobs' replies are read, objects and lists as JSON."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def clean_metadata(text: Column) -> Column:
    """Metadata from a JSON object: lists (a scalar is a list of one) of trimmed texts, blank scalars null.

    The text is parsed once, as a variant, whatever the shapes of its fields: null, false,
    zero, empty texts, lists and objects count as missing, in a list only blank items do.
    Text that is no JSON gives no metadata.
    """

    def fields(v: Column) -> Column:
        def field(name: str) -> Column:
            return F.try_variant_get(v, f"$.{name}", "variant")

        def told(x: Column) -> Column:
            return F.coalesce(~_said(x).isin("None", "False", "0", "", "[]", "{}"), F.lit(False))

        def listed(name: str) -> Column:
            x = field(name)
            items = F.transform(F.try_variant_get(x, "$", "array<variant>"), _said)
            many = F.when(F.schema_of_variant(x).startswith("ARRAY"), items).when(told(x), F.array(_said(x)))
            return F.coalesce(F.filter(F.transform(many, lambda i: strip(i)), lambda i: i != ""), F.array().cast("array<string>")).alias(name)

        return F.struct(*[F.nullif(strip(F.when(told(field(s)), _said(field(s)))), F.lit("")).alias(s) for s in SCALARS], *[listed(x) for x in LISTS])

    return F.transform(F.array(F.try_parse_json(text)), fields)[0]


def metadata_json(metadata: Column) -> Column:
    """Metadata as JSON text with all fields."""
    return F.to_json(metadata, {"ignoreNullFields": "false"})


def list_text(items: Column) -> Column:
    """A list as text with commas, null if nothing is in it."""
    return F.nullif(F.array_join(F.filter(F.transform(items, lambda x: strip(x)), lambda x: x != ""), ", "), F.lit(""))


def metadata_terms(metadata: Column) -> Column:
    """Terms of a chunk in order: keywords, indicators, entities, sources, kind of content, intention."""
    lists = [metadata[x] for x in ("palavras_chave", "indicadores", "entidades", "fontes_dados")]
    return F.filter(F.transform(F.concat(*lists, F.array_compact(F.array(metadata["tipo_conteudo"], metadata["intencao"]))), lambda t: strip(t)), lambda t: t != "")


def idf(n: Column, df: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((1 + n) / (1 + df)) + 1


def document_frequency(chunks: DataFrame, keys: list[str], stopwords: list[str] = STOPWORDS) -> DataFrame:
    """``token, df, n``: chunks that hold each token, and all chunks (also those without terms).

    ``chunks`` has ``keys`` and ``termos``.  A chunk's tokens are made distinct within its row,
    so counting needs one shuffle and a token of all chunks is summed up before it.
    """
    distinct = F.array_distinct(F.flatten(F.transform("termos", lambda t: tokens(t, stopwords))))
    df = chunks.select(F.explode(distinct).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(chunks.agg(F.count(F.lit(1)).alias("n")))  # one row with the number of chunks


def counted_tokens(terms: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Distinct tokens of a chunk's terms as ``token, tf, pos``: how often each stands, and the first term that holds it."""
    each = F.transform(terms, lambda t, k: F.transform(tokens(t, stopwords), lambda x: F.struct(x.alias("token"), k.alias("pos"))))
    once = lambda value, then: F.transform(F.array(value), then)[0]

    def runs(found: Column) -> Column:
        new = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda k: (k == 0) | (F.get(found, k)["token"] != F.get(found, k - 1)["token"]))
        run = lambda heads: F.transform(heads, lambda i, k: F.struct(F.get(found, i)["token"].alias("token"), (F.coalesce(F.get(heads, k + 1), F.size(found)) - i).alias("tf"), F.get(found, i)["pos"].alias("pos")))
        return F.when(F.size(found) > 0, once(new, run)).otherwise(F.array().cast("array<struct<token:string,tf:int,pos:int>>"))

    return once(F.sort_array(F.flatten(each)), runs)


def weighted_terms(
    chunks: DataFrame, keys: list[str], limit: int = MAX_TERMS, stopwords: list[str] = STOPWORDS, corpus: DataFrame | None = None, frequencies: DataFrame | None = None
) -> DataFrame:
    """``keys, metadados_tfidf``: the terms of each chunk by falling weight, joined by commas.

    A token weighs its share of the chunk's tokens times its inverse document frequency over
    ``corpus`` (default: these chunks), or by ``frequencies`` (``token, df, n``) kept of it,
    and stands for the first term that holds it; terms that differ in case only count once,
    with their best weight.  Chunks (``keys``) are unique; one with null terms has none.

    Tokens are cut and counted inside their chunk's row, which is written once; its tokens
    meet their frequencies and go back to the chunk as weights and numbers of terms, where
    its terms, shuffled once, are put in order.  A chunk's tokens share a divisor, so it
    isn't needed.
    """
    terms = F.coalesce("termos", F.array().cast("array<string>"))
    counted = chunks.select(*keys, terms.alias("_terms"), counted_tokens(terms, stopwords).alias("_tokens"))
    counted = written(counted, "counted")
    rows = counted.select(*keys, F.explode("_tokens").alias("_t")).select(*keys, "_t.token", "_t.tf", "_t.pos")
    if frequencies is not None:
        df = frequencies
    elif corpus is not None:
        df = document_frequency(corpus, keys, stopwords)
    else:
        df = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(counted.agg(F.count(F.lit(1)).alias("n")))  # one row with the number of chunks
    weight = F.col("tf") * F.coalesce(idf(F.col("n"), F.col("df")), F.lit(1.0))
    weighed = rows.join(df, "token", "left").select(*keys, F.struct((-weight).alias("by"), "pos").alias("_w"), F.lit(None).cast("array<string>").alias("_terms"))
    both = weighed.unionByName(counted.select(*keys, "_terms", F.lit(None).cast(weighed.schema["_w"].dataType).alias("_w")))
    met = both.groupBy(*keys).agg(F.collect_list("_w").alias("_w"), F.first("_terms", ignorenulls=True).alias("_terms"))

    def distinct(ordered: Column) -> Column:
        # a fold would copy what it has found at every term; the few that are kept are looked up
        lowered = F.transform(ordered, lambda x: F.lower(x["term"]))
        kept = lambda low: F.transform(F.slice(F.array_distinct(low), 1, limit), lambda k: F.get(ordered, (F.array_position(low, k) - 1).cast("int"))["term"])
        return F.transform(F.array(lowered), kept)[0]

    ordered = F.sort_array(F.transform("_w", lambda w: F.struct(w["by"].alias("by"), F.get(F.col("_terms"), w["pos"]).alias("term"))))
    best = F.transform(F.array(ordered), distinct)[0]
    return met.select(*keys, F.array_join(best, ", ").alias("metadados_tfidf"))


#: In a table of frequencies the token that counts all chunks: no token is empty.
ALL = ""


def _signed(chunks: DataFrame, sign: int, stopwords: list[str]) -> DataFrame:
    """Each chunk's distinct tokens, and that of all chunks, with a sign."""
    found = F.array_distinct(F.flatten(F.transform(F.coalesce("termos", F.array().cast("array<string>")), lambda t: tokens(t, stopwords))))
    return chunks.select(F.explode(F.concat(F.array(F.lit(ALL)), found)).alias("token"), F.lit(sign).alias("_by"))


def store_frequencies(chunks: DataFrame, path: str, buckets: int = 1024, stopwords: list[str] = STOPWORDS) -> None:
    """Count the tokens of a corpus (``termos`` of its chunks) and keep the counts in buckets in a new folder."""
    store.create_table(_signed(chunks, 1, stopwords).groupBy("token").agg(F.sum("_by").alias("df")), path, buckets, key="token")


def update_frequencies(spark: SparkSession, path: str, gone: DataFrame, come: DataFrame, stopwords: list[str] = STOPWORDS) -> list[int]:
    """Bring kept counts up to date with chunks that left the corpus and came to it; replaced ones do both.

    Tokens of both are summed up with signs, so what a replaced chunk still holds cancels
    out; only buckets with a token whose count changes are written again.  Returns these.
    """
    signed = _signed(gone, -1, stopwords).unionByName(_signed(come, 1, stopwords))
    # written, as it tells the buckets first and changes them then
    delta = written(signed.groupBy("token").agg(F.sum("_by").alias("_by")).where("_by <> 0"), "frequency-delta")

    def change(old: DataFrame) -> DataFrame:
        joined = old.join(delta, "token", "full_outer")
        return joined.select("token", (F.coalesce("df", F.lit(0)) + F.coalesce("_by", F.lit(0))).alias("df")).where((F.col("df") > 0) | (F.col("token") == ALL))

    return store.rewrite_buckets(spark, path, delta, change)


def stored_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``token, df, n`` of a corpus by its kept counts."""
    counts = store.read_table(spark, path)
    return counts.where(F.col("token") != ALL).crossJoin(counts.where(F.col("token") == ALL).select(F.col("df").alias("n")))  # one row

"""Filters from questions, citations, context texts and ranking of rule notes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, note_tokens
from ..functions.vocab import REGIONS
from ..sources.scratch import written
from .headers import body, header_block, parse_yaml, stem, truthy

NOTHING_FOUND = "Desculpe, não encontrei essa informação nos estudos."
#: Fields of a note that give keywords.
KEY_FIELDS = ["indicador", "fonte", "dominio", "tags", "aliases"]


def question_year(text: Column) -> Column:
    """The latest year from 2000 on that a question names."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))


def question_region(text: Column, regions: list[str] = REGIONS) -> Column:
    """The longest region whose name occurs anywhere in the question, even inside a word."""
    found = normalise(text)
    names = sorted(regions, key=len, reverse=True)
    return F.coalesce(*[F.when(found.contains(normalise(F.lit(r))), r) for r in names])


def citation(title: Column, year: Column, heading: Column) -> Column:
    """Title, year and section, the section without the title in front and only if it says more."""
    lead = F.concat(title, F.lit(" > "))
    section = F.when(heading.startswith(lead), F.substr(heading, F.length(lead) + 1)).otherwise(heading)
    return F.concat_ws(" — ", title, F.when(year != 0, year.cast("string")), F.when((section != "") & (section != title), section))


def hits(found: DataFrame, *more: str) -> DataFrame:
    """What a search reports of a chunk, and ``more`` columns if asked for."""
    return found.select("question_id", "posicao", "chunk_id", "documento_titulo", "heading_path", "ano", F.round("distancia", 4).alias("distancia"), *more)


def context_texts(questions: DataFrame, found: DataFrame, nothing: str = NOTHING_FOUND) -> DataFrame:
    """Per question: ``contexto`` (numbered chunks), ``resposta`` (their texts under citations) and ``fontes``.

    ``found``: ``question_id, posicao, referencia, texto``, at most a few rows per question.
    """
    rows = F.array_sort(F.collect_list(F.struct("posicao", "referencia", "texto")))
    per = found.groupBy("question_id").agg(rows.alias("_r"))
    numbered = F.transform("_r", lambda r: F.concat(F.lit("["), r["posicao"], F.lit("] "), r["referencia"], F.lit("\n"), r["texto"]))
    shown = F.transform("_r", lambda r: F.concat(F.lit("**"), r["referencia"], F.lit("**\n\n"), r["texto"]))
    sources = F.transform("_r", lambda r: F.concat(F.lit("- "), r["referencia"]))
    joined = questions.select("question_id").join(per, "question_id", "left")
    return joined.select(
        "question_id",
        F.coalesce(F.array_join(numbered, "\n\n---\n\n"), F.lit("")).alias("contexto"),
        F.coalesce(F.array_join(shown, "\n\n"), F.lit(nothing)).alias("resposta"),
        F.coalesce(F.array_join(sources, "\n"), F.lit("")).alias("fontes"),
    )


def parse_notes(raw: DataFrame, stopwords: list[str]) -> DataFrame:
    """Rule notes ``path, title, body, metadata, keywords, body_tokens`` that are not deprecated."""
    split = raw.select("path", body(F.col("conteudo")).alias("body"), header_block(F.col("conteudo")).alias("_yaml"))
    parsed = parse_yaml(split)
    meta = F.col("metadata")
    title = F.coalesce(truthy(meta["title"]), truthy(meta["indicador"]), F.replace(stem(F.col("path")), F.lit("_"), F.lit(" ")))
    words = lambda c: F.coalesce(note_tokens(c, stopwords), F.array().cast("array<string>"))
    keywords = F.array_distinct(F.concat(words(title), words(stem(F.col("path"))), *[words(meta[k]) for k in KEY_FIELDS]))
    kept = parsed.where(F.coalesce(F.lower(meta["status"]), F.lit("approved")) != "deprecated")
    return kept.select("path", title.alias("title"), "body", "metadata", keywords.alias("keywords"), words(F.col("body")).alias("body_tokens"))


def _added(*parts: DataFrame) -> DataFrame:
    """Points of pairs of question and note, added up."""
    return functools.reduce(DataFrame.unionByName, parts).groupBy("question_id", "path").agg(F.sum("w").alias("pontos"))


def _least(scores: DataFrame, limit: int) -> DataFrame:
    """The ``limit``-th best points of each question that has as many notes."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("pontos")))
    best = scores.withColumn("_place", place).where(F.col("_place") <= limit)
    return best.groupBy("question_id").agg(F.min("pontos").alias("_least"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == limit).drop("_n")


def rank_notes(questions: DataFrame, notes: DataFrame, stopwords: list[str], limit: int = 5, met: list[DataFrame] | None = None) -> DataFrame:
    """The notes that share most tokens with each question: ``question_id, path, pontos, posicao``.

    A shared keyword counts 3, a shared word of the body 1.  Exact, but not every question
    meets every note that has one of its tokens.  Notes with a token as keyword and notes
    with it in the body are two lists; a question's lists are taken from the shortest to the
    longest: those with the shorter half of all places give points to beat, the
    ``limit``-th best so far.  Of the others, the longest that together can't reach these
    points bring no note of their own; they are looked up only for notes that may still be
    among the best, by note and token.  ``met`` receives the pairs that were joined, and
    looked up, for those who count them.
    """
    asked = questions.select("question_id", F.explode(note_tokens(F.col("text"), stopwords)).alias("token")).distinct()
    weighted = notes.select("path", F.explode("keywords").alias("token"), F.lit(3).alias("w")).unionByName(notes.select("path", F.explode("body_tokens").alias("token"), F.lit(1).alias("w")))
    weights = written(weighted.distinct(), "note-weights")
    lists = weights.groupBy("token", "w").agg(F.count(F.lit(1)).alias("_df"))

    rare = Window.partitionBy("question_id").orderBy("_df", F.desc("w"), "token")
    through = rare.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = rare.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    first = (F.row_number().over(rare) == 1) | (2 * F.sum("_df").over(through) <= F.sum("_df").over(Window.partitionBy("question_id")))
    asked = asked.join(lists, "token").select("question_id", "token", "w", first.alias("_first"), F.sum("w").over(onward).alias("_onward"))

    places = lambda tokens: tokens.select("question_id", "token", "w").join(weights, ["token", "w"]).select("question_id", "path", "w")
    begun = places(asked.where("_first"))
    beat = _least(_added(begun), limit)
    planned = written(asked.join(beat, "question_id", "left").withColumn("_joined", F.col("_first") | F.col("_least").isNull() | (F.col("_onward") >= F.col("_least"))), "planned-tokens")
    joined = places(planned.where("_joined"))
    scores = _added(joined)

    left = planned.where("NOT _joined").groupBy("question_id").agg(F.sum("w").alias("_left"))
    hopeful = scores.join(left, "question_id", "left").join(_least(scores, limit), "question_id", "left")
    hopeful = hopeful.where(F.col("pontos") + F.coalesce("_left", F.lit(0)) >= F.coalesce("_least", F.lit(0)))
    asked_of = hopeful.select("question_id", "path").join(planned.where("NOT _joined").select("question_id", "token", "w"), "question_id")
    more = asked_of.join(weights, ["path", "token", "w"]).select("question_id", "path", "w")
    if met is not None:
        met += [joined, asked_of]
    full = _added(hopeful.select("question_id", "path", F.col("pontos").alias("w")), more)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("pontos"), F.substring_index("path", "/", -1), "path"))
    return full.withColumn("posicao", rank).where(F.col("posicao") <= limit)


def note_context(note_title: Column, path: Column, metadata: Column, text: Column) -> Column:
    """A note as a block of context."""
    fields = F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")
    return F.concat(F.lit("### "), note_title, F.lit("\n(origem: "), F.substring_index(path, "/", -1), F.lit(")\n\nMetadados:\n"), fields, F.lit("\n\n"), F.trim(text))

"""Catalogue fields of documents, from their names and texts by controlled vocabularies."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import normalise, word_pattern
from ..functions.vocab import MONTHS, REGIONS, SECTORS, STATE_WIDE, THEMES
from .headers import body, first_heading, has_header, stem

FIELDS = ["title", "ano", "tema", "setor", "municipio", "regional", "fonte", "data_referencia"]
_YEAR = r"(?U)\b(?:19|20)\d{2}\b"
_MONTH = r"(?i)(?:(?<=[^\p{L}\p{N}_])|^)(jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez)[a-z]*[\s/-]*(20[0-9]{2})(?![\p{L}\p{N}_])"
_QUARTER = r"(?iU)\b(?:([1-4])\s*[ºo]?\s*(?:tri|trimestre)|t([1-4]))\b"


def catalog_title(name: Column, text: Column) -> Column:
    """The first heading, else the file's name with spaces, first letter upper."""
    words = F.trim(F.regexp_replace(name, "[-_]", " "))
    return F.coalesce(first_heading(text), F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substr(words, F.lit(2)))))


def catalog_year(*sources: Column) -> Column:
    """The latest plausible year (1990 to 2100) of the first source that names one."""

    def latest(source: Column) -> Column:
        years = F.transform(F.regexp_extract_all(source, F.lit(_YEAR), F.lit(0)), lambda y: y.cast("int"))
        return F.array_max(F.filter(years, lambda y: y.between(1990, 2100)))

    return F.coalesce(*map(latest, sources))


def reference_period(name: Column, title: Column, year: Column) -> Column:
    """Month as ``YYYY-MM``, else quarter as ``YYYY-Qn``, else year."""
    base = F.concat_ws(" ", name, title)
    month = F.lower(F.regexp_extract(base, _MONTH, 1))
    quarter = F.concat(F.regexp_extract(base, _QUARTER, 1), F.regexp_extract(base, _QUARTER, 2))
    number = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])[month]
    return (
        F.when(month != "", F.concat_ws("-", F.regexp_extract(base, _MONTH, 2), number))
        .when((quarter != "") & year.isNotNull(), F.concat(year.cast("string"), F.lit("-Q"), quarter))
        .otherwise(year.cast("string"))
    )


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@functools.cache
def _norm(term: str) -> str:
    kept = (c for c in unicodedata.normalize("NFD", term) if unicodedata.category(c) != "Mn")
    return " ".join("".join(kept).lower().split())


def _trie(terms: list[str]) -> str:
    """A pattern of any of the terms, the longest first, in which terms share what they begin with."""
    tree: dict = {}
    for term in terms:
        node = tree
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(c) + pattern(after) for c, after in sorted(node.items()) if c]
        if not ways:
            return ""
        return ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})" + "?" * ("" in node)

    return pattern(tree)


def find_terms(sample: Column, terms: list[str]) -> Column:
    """What a normalised text holds of a dictionary, in one pass: at each word the longest of the terms (normalised) that starts there.

    A shorter term that begins a found one with whole words is there too: see :func:`_held`.
    """
    if not terms:
        return F.array().cast("array<string>")
    first = "".join(sorted({re.escape(t[0]) for t in terms}))
    return F.regexp_extract_all(sample, F.lit(rf"(?U)(?=[{first}])\b(?=({_trie(terms)})\b)"), F.lit(1))


def _held(longer: str, term: str) -> bool:
    """Whether a term begins another with whole words, or is it."""
    return longer == term or (longer.startswith(term) and not (longer[len(term)].isalnum() or longer[len(term)] == "_"))


def _literal(value: object, kind: str) -> Column:
    """A constant map or array, by one call however large it is; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def _told(found: Column, terms: list[str], what: Callable[[str], list[int]]) -> Column:
    """For each found term the numbers that it stands for."""
    return F.transform(found, lambda m: _literal({t: what(t) for t in terms}, "map<string,array<int>>")[m])


def _terms(*vocabularies: dict[str, list[str]] | list[str]) -> list[str]:
    """All terms of vocabularies, normalised, in order."""
    flat = [t for v in vocabularies for t in (v if isinstance(v, list) else [x for terms in v.values() for x in terms])]
    return sorted({_norm(t) for t in flat})


def catalog_region(sample: Column, regions: list[str] = REGIONS, found: tuple[Column, list[str]] | None = None) -> Column:
    """The longest region that stands in a normalised text as whole words; ``found`` has terms found already, and all asked for."""
    if not regions:
        return F.lit(None).cast("string")
    ranked = sorted(regions, key=len, reverse=True)
    matches, terms = found or (find_terms(sample, _terms(regions)), _terms(regions))
    ranks = F.flatten(_told(matches, terms, lambda m: [k for k, r in enumerate(ranked) if _held(m, _norm(r))] or [len(ranked)]))
    return F.get(_literal(ranked, "array<string>"), F.array_min(ranks))


def _blanked(sample: Column, regions: list[str]) -> Column:
    """A normalised text without the names of regions, one after the other as they are listed.

    A name that holds an earlier one as words is never whole when its turn comes; the others
    go in one pass, if no two may share words.
    """
    norms = list(dict.fromkeys(map(_norm, regions)))
    within = lambda a, b: re.search(rf"\b{re.escape(a)}\b", b) is not None
    whole = [r for k, r in enumerate(norms) if not any(within(e, r) for e in norms[:k])]
    shared = any(a.split()[-k:] == b.split()[:k] for a in whole for b in whole for k in range(1, min(len(a.split()), len(b.split()))))
    if not shared:
        first = "".join(sorted({re.escape(r[0]) for r in whole}))
        return F.regexp_replace(sample, rf"(?U)(?=[{first}])\b{_trie(whole)}\b", " ") if whole else sample
    return functools.reduce(lambda s, r: F.regexp_replace(s, word_pattern(r), " "), whole, sample)


def catalog_places(sample: Column, places: list[str], regions: list[str] = REGIONS, limit: int = 5, found: tuple[Column, list[str]] | None = None) -> Column:
    """Places that stand in a normalised text, in the vocabulary's order, at most ``limit``.

    Names of regions are blanked first, so a place named like a region is not found; a place
    within another found one's name is dropped.  Texts without a region's name need no
    second search where ``found`` has all terms found already.
    """
    if not places:
        return F.array().cast("array<string>")
    own, norms = _terms(places), list(map(_norm, places))
    numbers = lambda matches, terms: F.array_sort(F.array_distinct(F.flatten(_told(matches, terms, lambda m: [k for k, p in enumerate(norms) if _held(m, p)] or [-1]))))
    again = numbers(find_terms(_blanked(sample, regions), own), own)
    if found is None:
        seen = again
    else:
        region = catalog_region(sample, regions, found)
        seen = F.when(region.isNotNull(), again).otherwise(numbers(*found))
    outer = _literal([[j for j, other in enumerate(places) if other != p and norms[k] in norms[j]] or [-2] for k, p in enumerate(places)], "array<array<int>>")
    kept = _once(seen, lambda ids: F.filter(ids, lambda k: (k >= 0) & ~F.arrays_overlap(ids, F.get(outer, k))))
    return F.slice(F.transform(kept, lambda k: F.get(_literal(places, "array<string>"), k)), 1, limit)


def _overlaps_itself(term: str) -> bool:
    """Whether two places of a term may share words, so that places would have to be counted one after the other."""
    words = term.split()
    return any(words[:k] == words[-k:] for k in range(1, len(words)))


def vocabulary_scores(sample: Column, vocabulary: dict[str, list[str]], found: tuple[Column, list[str]] | None = None) -> Column:
    """``label, pontos`` of labels whose terms occur as words, most often first, ties by label.

    The text is searched once for all terms, or not at all where ``found`` has them.
    """
    labels = list(vocabulary)
    norms = {label: [_norm(t) for t in terms] for label, terms in vocabulary.items()}
    matches, terms = found or (find_terms(sample, _terms(vocabulary)), _terms(vocabulary))
    weights = _told(matches, terms, lambda m: [sum(_held(m, t) for t in norms[label] if not _overlaps_itself(t)) for label in labels])
    odd = {label: [t for t in norms[label] if _overlaps_itself(t)] for label in labels}

    def scored(per: Column) -> Column:
        points = F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda k: F.aggregate(per, F.lit(0), lambda n, w: n + w[k]))
        if any(odd.values()):
            more = F.array(*[sum((F.regexp_count(sample, F.lit(word_pattern(t))) for t in odd[label]), F.lit(0)) for label in labels])
            points = F.zip_with(points, more, lambda a, b: a + b)
        both = F.arrays_zip(points.alias("pontos"), _literal(labels, "array<string>").alias("label"))
        order = F.array_sort(F.transform(F.filter(both, lambda s: s["pontos"] > 0), lambda s: F.struct((-s["pontos"]).alias("by"), s["label"].alias("label"))))
        return F.transform(order, lambda s: F.struct(s["label"].alias("label"), (-s["by"]).alias("pontos")))

    if not labels:
        return F.array().cast("array<struct<label:string,pontos:int>>")
    return _once(weights, scored)


def themes(sample: Column, vocabulary: dict[str, list[str]] = THEMES, limit: int = 3, found: tuple[Column, list[str]] | None = None) -> Column:
    """Best themes of a normalised text."""
    return F.slice(F.transform(vocabulary_scores(sample, vocabulary, found), lambda s: s["label"]), 1, limit)


def sectors(sample: Column, vocabulary: dict[str, list[str]] = SECTORS, limit: int = 3, least: int = 2, found: tuple[Column, list[str]] | None = None) -> Column:
    """Best sectors of a normalised text that it names at least twice."""
    often = F.filter(vocabulary_scores(sample, vocabulary, found), lambda s: s["pontos"] >= least)
    return F.slice(F.transform(often, lambda s: s["label"]), 1, limit)


def dictionary_fields(samples: DataFrame, sample: str, places: list[str]) -> DataFrame:
    """Add ``tema, setor, municipio, regional`` to rows with a normalised text, which is searched once for all vocabularies."""
    terms = _terms(THEMES, SECTORS, REGIONS, places)
    text, found = F.col(sample), (F.col("_found"), terms)
    rows = samples.withColumn("_found", find_terms(text, terms))
    fields = {"tema": themes(text, found=found), "setor": sectors(text, found=found), "municipio": catalog_places(text, places, found=found), "regional": catalog_region(text, found=found)}
    return rows.withColumns(fields).drop("_found")


def catalog_fields(documents: DataFrame, source: str, places: list[str], completed: DataFrame | None = None, sample: int | None = None, lead: int | None = None) -> DataFrame:
    """Catalogue fields of documents ``chave, conteudo``, with each field's origin, warnings and status.

    Themes, sectors, places and region are read from the whole text, or from its first
    ``sample`` characters (8000 gives short catalogues of long studies); the year from the whole text or its first ``lead`` characters.

    ``completed`` (``chave`` and any fields) fills what the text doesn't tell, as origin
    ``llm``.  Without a region the whole state is taken, as origin ``padrao``.
    """
    name, text = stem(F.col("chave")), body(F.col("conteudo"))
    rows = documents.select("chave", "conteudo", name.alias("_name"), text.alias("_body"), has_header(F.col("conteudo")).alias("_had"))
    rows = rows.withColumn("title", catalog_title(F.col("_name"), F.col("_body")))
    rows = rows.withColumn("_sample", normalise(F.concat_ws(" ", "_name", "title", (F.col("_body") if sample is None else F.substring("_body", 1, sample)))))
    rows = rows.withColumns({"ano": catalog_year(F.col("_name"), F.col("title"), (F.col("_body") if lead is None else F.substring("_body", 1, lead)))})
    rows = dictionary_fields(rows, "_sample", places).withColumn("fonte", F.lit(source))
    rows = rows.withColumn("data_referencia", reference_period(F.col("_name"), F.col("title"), F.col("ano")))
    empty = lambda f: F.size(f) == 0 if f in ("tema", "setor", "municipio") else F.coalesce(F.col(f).cast("string"), F.lit("")) == ""
    if completed is not None:
        more = completed.select("chave", *[F.col(c).alias(f"_{c}_2") for c in completed.columns if c in FIELDS])
        rows = rows.join(more, "chave", "left")
    filled = {f: F.lit(False) for f in FIELDS}
    if completed is not None:
        filled = {f: empty(f) & F.col(f"_{f}_2").isNotNull() if f in completed.columns else F.lit(False) for f in FIELDS}
    origin = {f: F.when(filled[f], "llm").when(empty(f), "ausente").otherwise("heuristica") for f in FIELDS}
    rows = rows.withColumns({f"_o_{f}": origin[f] for f in FIELDS})
    if completed is not None:
        rows = rows.withColumns({f: F.when(F.col(f"_o_{f}") == "llm", F.col(f"_{f}_2")).otherwise(F.col(f)) for f in FIELDS if f in completed.columns})
    no_region = F.coalesce("regional", F.lit("")) == ""
    origins = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.when(no_region, "padrao").otherwise(F.col("_o_regional")) if f == "regional" else F.col(f"_o_{f}"))])
    warnings = F.array_compact(
        F.array(F.when(F.col("ano").isNull(), "Ano não identificado; informe manualmente."), F.when(F.size("tema") == 0, "Tema não identificado pelo vocabulário controlado."))
    )
    return rows.select(
        "chave", "title", "ano", "tema", "setor", "municipio", F.when(no_region, STATE_WIDE[0]).otherwise(F.col("regional")).alias("regional"), "fonte", "data_referencia",
        origins.alias("origem_campos"), warnings.alias("avisos"), F.when(F.col("_had"), "ja_possui").otherwise("pronto").alias("status"),
    )


@F.pandas_udf(StringType())
def _block(fields: pd.Series) -> pd.Series:
    """The header of fields that come as JSON: those with a value, a list of one as that one."""

    def one(text: str) -> str:
        found = json.loads(text)
        kept = {}
        for f in FIELDS:
            value = found.get(f)
            if isinstance(value, list):
                value = [str(v).strip() for v in value if str(v).strip()]
                value = value[0] if len(value) == 1 else value
            if value not in (None, "", []):
                kept[f] = value
        return f"---\n{yaml.safe_dump(kept, allow_unicode=True, sort_keys=False).strip()}\n---\n\n"

    return fields.map(one)


def render_headers(documents: DataFrame, fields: DataFrame, overwrite: bool = False) -> DataFrame:
    """``chave, conteudo``: documents with a header of their fields; one that is there stays unless overwritten.  Texts stay in the JVM."""
    text = F.col("conteudo")
    joined = documents.select("chave", "conteudo").join(fields.select("chave", _block(F.to_json(F.struct(*FIELDS))).alias("_block")), "chave")
    fresh = F.concat("_block", F.regexp_replace(body(text), r"^\n+", ""))
    return joined.select("chave", (fresh if overwrite else F.when(has_header(text), text).otherwise(fresh)).alias("conteudo"))

"""Answers to batches of questions about company counts.

Questions (``question_id, text``) are the large side: places are found by an equality join
on the first word of a name, and totals by equality joins with sums per scope and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_any, has_word, normalise, percent, thousands, word_pattern
from ..functions.vocab import BREAKDOWN_TERMS, DEFAULT_LABEL, GENERIC_PLACES, QUANTITATIVE_TERMS, RANKING_TERMS, SIZE_ALIASES, SIZE_LABELS, STATE_WIDE
from ..sources.scratch import written

_NAME = r"[A-ZÁÂÃÀÉÊÍÓÔÕÚÇ][\wÁÂÃÀÉÊÍÓÔÕÚÇáâãàéêíóôõúç'-]+"
#: A run of capitalised words after a preposition, or after "regional".
_AFTER_PREPOSITION = rf"(?U)\b(?:em|de|do|da|no|na|para)\s+({_NAME}(?:\s+(?:d[aeo]s?\s+)?{_NAME})*)"
_AFTER_REGIONAL = rf"(?U)\bregion(?:al|ais)\s+(?:d[aeo]\s+)?({_NAME}(?:\s+(?:d[aeo]s?\s+)?{_NAME})*)"


def last_user_turn(conversations: DataFrame) -> DataFrame:
    """The question of each conversation: its last turn by a user."""
    users = conversations.where("role = 'user'")
    return users.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def intent(text: Column, terms: list[str] = QUANTITATIVE_TERMS) -> Column:
    """``quantitative`` if a term occurs, else ``qualitative``."""
    return F.when(has_any(text, terms), "quantitative").otherwise("qualitative")


def wants_ranking(text: Column) -> Column:
    """Whether a question asks for a ranking."""
    return has_any(text, RANKING_TERMS)


def wants_breakdown(text: Column) -> Column:
    """Whether a question asks for a breakdown by size."""
    return has_any(text, BREAKDOWN_TERMS)


def detect_size(text: Column, aliases: dict[str, str] = SIZE_ALIASES) -> Column:
    """Size of the first alias, in the vocabulary's order, that stands in the text as a word."""
    found = normalise(text)
    return F.coalesce(*[F.when(found.rlike(word_pattern(alias)), code) for alias, code in aliases.items()])


def detect_places(questions: DataFrame, names: DataFrame, kinds: list[str]) -> DataFrame:
    """``question_id`` and a column per kind: the longest name of each kind that stands in the question; ties by smallest ``ordem``, then name.

    ``names``: ``kind, name, ordem``.  A name stands in a text only if its first word does, so
    words are joined first and whole names checked after, once for all kinds.
    """
    words = lambda text: F.filter(F.split(text, r"(?U)\W+"), lambda w: w != "")
    known = names.where(F.col("name").isNotNull()).groupBy("kind", "name").agg(F.min("ordem").alias("ordem")).withColumn("_norm", normalise(F.col("name"))).where("_norm <> ''")
    known = known.withColumn("_word", words(F.col("_norm"))[0])
    asked = questions.select("question_id", normalise(F.col("text")).alias("_text")).withColumn("_word", F.explode(F.array_distinct(words(F.col("_text")))))
    hits = asked.join(known, "_word").where(has_word(F.col("_text"), F.col("_norm")))
    order = F.struct(F.length("name"), -F.col("ordem"), F.col("name"))
    return hits.groupBy("question_id").agg(*[F.max_by("name", F.when(F.col("kind") == k, order)).alias(k) for k in kinds])


def detect_place(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``question_id, name``: the longest name (of ``name, ordem``) that stands in each question."""
    return detect_places(questions, names.withColumn("kind", F.lit("name")), ["name"])


def _held(needles: DataFrame, texts: DataFrame, needle: str, text: str) -> DataFrame:
    """Pairs of needles and texts that hold them anywhere.

    A text that holds a needle holds its first three characters (all, if it has fewer), so
    these are joined with the texts' substrings of one to three characters, and what is
    joined is checked.
    """
    grams = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substr(text, k, n)))))
    keyed = needles.where(F.col(needle) != "").withColumn("_gram", F.left(needle, F.lit(3)))
    return keyed.join(texts.withColumn("_gram", F.explode(F.array_distinct(grams))), "_gram").where(F.col(text).contains(F.col(needle)))


def unknown_place(questions: DataFrame, places: DataFrame, generic: list[str] = GENERIC_PLACES, sizes: dict[str, str] = SIZE_ALIASES) -> DataFrame:
    """``question_id, desconhecido``: the first capitalised place of each question that is known in no way.

    ``places``: ``name``, all municipalities and regional offices.  A candidate counts as known if
    it is part of a known or generic name or the other way round; sizes are no places.
    """
    spark = questions.sparkSession
    known = places.select(normalise(F.col("name")).alias("_known")).where("_known <> ''")
    known = known.unionByName(spark.createDataFrame([(g,) for g in generic], "_known string")).distinct()
    found = F.concat(F.regexp_extract_all("text", F.lit(_AFTER_REGIONAL), F.lit(1)), F.regexp_extract_all("text", F.lit(_AFTER_PREPOSITION), F.lit(1)))
    asked = questions.select("question_id", F.posexplode(found).alias("_pos", "_raw")).withColumn("_cand", normalise(F.col("_raw")))
    open_ = asked.where((F.col("_cand") != "") & ~F.col("_cand").isin(list(sizes)))
    asked_for = open_.select("_cand").distinct()
    inside = _held(asked_for, known, "_cand", "_known").select("_cand").unionByName(_held(known, asked_for, "_known", "_cand").select("_cand"))
    loose = open_.join(inside.distinct(), "_cand", "left_anti")
    return loose.groupBy("question_id").agg(F.trim(F.min_by("_raw", "_pos")).alias("desconhecido"))


#: Scopes of an answer, and the column of the dataset that each goes by.
SCOPES = [("municipio", "municipio"), ("regional", "regional"), ("estado", None)]


def _views(dataset: DataFrame) -> DataFrame:
    """Every row once per scope it belongs to, for its own size and for all sizes (null): adds ``_scope, _key, _size``."""
    sizes = F.when(F.col("porte").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string"), F.col("porte")))
    scopes = F.array(*[F.struct(F.lit(scope).alias("scope"), (F.col(c) if c else F.lit("")).alias("key")) for scope, c in SCOPES])
    seen = dataset.select("*", F.explode(scopes).alias("_s"), sizes.alias("_sizes")).where("_s.key IS NOT NULL")
    return seen.select("*", F.col("_s.scope").alias("_scope"), F.col("_s.key").alias("_key"), F.explode("_sizes").alias("_size")).drop("_s", "_sizes")


def _sourced(dataset: DataFrame) -> DataFrame:
    """A dataset that names its source, as empty text if it has none."""
    return dataset if "fonte" in dataset.columns else dataset.withColumn("fonte", F.lit(""))


def scope_sums(dataset: DataFrame) -> DataFrame:
    """Sums of each scope, key and size (null: all): ``_scope, _key, _size, valor, linhas, municipios`` and the sets ``_datas, _fontes``.

    Rows are summed up by municipality, regional office and size first; only that table is
    spread over scopes and sizes.  Distinct municipalities are counted by bitmaps of their
    numbers, which merge: those of one scope, key and size are put together by parts of
    32,768 numbers and their bits added up.
    """
    names = written(dataset.where(F.col("municipio").isNotNull()).select("municipio").distinct().withColumn("_number", F.monotonically_increasing_id()), "place-numbers")
    finest = dataset.groupBy("municipio", "regional", "porte").agg(
        F.sum("total").alias("total"), F.count(F.lit(1)).alias("linhas"), F.collect_set("data_referencia").alias("_datas"), F.collect_set("fonte").alias("_fontes")
    )
    spread = _views(finest.join(names, "municipio", "left"))
    part, bit = F.bitmap_bucket_number("_number"), F.when(F.col("_number").isNotNull(), F.bitmap_bit_position("_number"))
    sets = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    parts = spread.groupBy("_scope", "_key", "_size", part.alias("_part")).agg(
        F.sum("total").alias("total"), F.sum("linhas").alias("linhas"), sets("_datas"), sets("_fontes"), F.bitmap_count(F.bitmap_construct_agg(bit)).alias("_places")
    )
    return parts.groupBy("_scope", "_key", "_size").agg(F.sum("total").alias("valor"), F.sum("linhas").alias("linhas"), sets("_datas"), sets("_fontes"), F.sum("_places").alias("municipios"))


def answer_questions(questions: DataFrame, dataset: DataFrame, state: str = STATE_WIDE[0], indicator: str = "empresas_por_municipio") -> DataFrame:
    """One answer per question (``question_id`` unique, ``text``).

    A municipality named in it wins over a regional office; a place that is not known, a
    slice without rows, or a dataset without any, is answered as not found, never as zero or
    as the state's total.  ``fonte`` names the distinct sources of the slice, if the dataset does.
    The dataset is worked out and written once, then its names and its sums are taken from that.
    """
    dataset = written(_sourced(dataset), "dataset")
    names = dataset.groupBy("municipio", "regional").agg(F.min("codigo_ibge").alias("ordem_"))
    both = written(names.select("ordem_", F.explode(F.array(F.struct(F.lit("_town").alias("kind"), F.col("municipio").alias("name")), F.struct(F.lit("_office").alias("kind"), F.col("regional").alias("name")))).alias("n")).select("n.kind", "n.name", "ordem_"), "place-names")
    ranked = both.groupBy("kind", "name").agg(F.min("ordem_").alias("ordem_")).select("kind", "name", F.rank().over(Window.partitionBy("kind").orderBy("ordem_", "name")).alias("ordem"))
    asked = (
        questions.select("question_id", "text", detect_size(F.col("text")).alias("porte"))
        .join(detect_places(questions, ranked, ["_town", "_office"]), "question_id", "left")
        .join(unknown_place(questions, both.select("name").where(F.col("name").isNotNull())), "question_id", "left")
        .crossJoin(dataset.agg((F.count(F.lit(1)) > 0).alias("_some")))  # one row
    )
    place = F.coalesce("_town", "_office")
    scope = F.when(F.col("_town").isNotNull(), "municipio").when(F.col("_office").isNotNull(), "regional").when(F.col("desconhecido").isNull() & F.col("_some"), "estado")
    asked = asked.withColumns({"escopo": scope, "_place": F.when(scope != "estado", place).otherwise("")})
    sums = scope_sums(dataset)
    joined = asked.join(sums, (F.col("escopo") == F.col("_scope")) & (F.col("_place") == F.col("_key")) & F.col("porte").eqNullSafe(F.col("_size")), "left")
    label = F.when(F.col("escopo") == "estado", state).when(F.col("escopo") == "regional", F.concat(F.lit("Regional "), F.col("_place"))).when(F.col("escopo") == "municipio", F.col("_place"))
    found = F.col("linhas").isNotNull()
    target = F.when(F.col("porte").isNull(), label).otherwise(F.concat(label, F.lit(" / porte "), F.col("porte")))
    message = (
        F.when(~F.col("_some"), f"A fonte estática '{indicator}' não está disponível ou está vazia.")
        .when(
            F.col("escopo").isNull(),
            F.concat(F.lit("Não encontrei '"), F.col("desconhecido"), F.lit("' na fonte estática. Confirme a grafia do município ou da regional. Ausência de registro não deve ser interpretada como valor zero.")),
        )
        .when(~found, F.concat(F.lit("Não há registros na fonte para o recorte solicitado ("), target, F.lit("). Ausência de registro não deve ser interpretada como valor zero.")))
    )
    return joined.select(
        "question_id",
        "text",
        found.alias("encontrado"),
        "valor",
        F.lit(indicator).alias("indicador"),
        "escopo",
        label.alias("escopo_label"),
        F.when(F.col("_some"), F.col("porte")).alias("porte"),
        F.coalesce("linhas", F.lit(0)).alias("linhas"),
        F.col("municipios"),
        F.array_join(F.array_sort("_datas"), ", ").alias("data_referencia"),
        F.when(found, F.array_join(F.array_sort("_fontes"), ", ")).alias("fonte"),
        F.coalesce(message, F.lit("")).alias("mensagem"),
    )


def _slice_of() -> Column:
    place = F.when(F.col("escopo") == "estado", "").when(F.col("escopo") == "regional", F.regexp_replace("escopo_label", "^Regional ", "")).otherwise(F.col("escopo_label"))
    return F.struct(F.col("escopo").alias("_scope"), place.alias("_key"), F.col("porte").alias("_size"))


def answer_slices(answers: DataFrame) -> DataFrame:
    """Which slice of the dataset each answer sums up: ``question_id, escopo, lugar, porte``; the state's place is empty."""
    return answers.where("encontrado").select("question_id", _slice_of().alias("_s")).select("question_id", F.col("_s._scope").alias("escopo"), F.col("_s._key").alias("lugar"), F.col("_s._size").alias("porte"))


def slice_details(answers: DataFrame, dataset: DataFrame) -> DataFrame:
    """The rows of each slice that some answer sums up, once however many ask for it: ``_scope, _key, _size`` and all columns of ``dataset``.

    Answers meet them by :func:`answer_slices`.
    """
    asked = answers.where("encontrado").select(_slice_of().alias("_s")).select("_s.*").distinct()
    rows = _views(dataset).withColumnsRenamed({c: f"_of{c}" for c in ("_scope", "_key", "_size")})
    same = (F.col("_scope") == F.col("_of_scope")) & (F.col("_key") == F.col("_of_key")) & F.col("_size").eqNullSafe(F.col("_of_size"))
    return asked.join(rows, same).select("_scope", "_key", "_size", *[f"`{c}`" for c in dataset.columns])


def answer_details(answers: DataFrame, dataset: DataFrame) -> DataFrame:
    """The rows of the dataset that each answer sums up: ``question_id`` and all columns of ``dataset``.

    As many rows as questions times those of their slices: for many questions take
    :func:`slice_details`, which has each slice once.
    """
    members = answers.where("encontrado").select("question_id", _slice_of().alias("_s")).select("question_id", F.col("_s._scope").alias("_m_scope"), F.col("_s._key").alias("_m_key"), F.col("_s._size").alias("_m_size"))
    same = (F.col("_scope") == F.col("_m_scope")) & (F.col("_key") == F.col("_m_key")) & F.col("_size").eqNullSafe(F.col("_m_size"))
    return slice_details(answers, dataset).join(members, same).select("question_id", *[f"`{c}`" for c in dataset.columns])


def size_label(size: Column, labels: dict[str, str] = SIZE_LABELS, default: str = DEFAULT_LABEL) -> Column:
    """What companies of a size are called."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[size], F.lit(default))


def render_answers(answers: DataFrame, dataset: DataFrame) -> DataFrame:
    """``question_id, resposta``: the answer's text, with blocks for a breakdown or a ranking if asked for.

    A ranking covers the state, or the regional office of the answer, even if a municipality was asked for.
    """
    dataset = written(dataset, "dataset")
    shares = _breakdown_blocks(dataset)
    ranks = _ranking_blocks(dataset)
    office = F.when(F.col("escopo") == "regional", F.regexp_replace("escopo_label", "^Regional ", "")).otherwise("")
    joined = (
        answers.withColumns({"_office": office, "_spot": F.when(F.col("escopo") == "municipio", F.col("escopo_label")).otherwise(office)})
        .join(shares, (F.col("escopo") == F.col("_b_scope")) & (F.col("_spot") == F.col("_b_key")), "left")
        .join(ranks, (F.col("_office") == F.col("_r_key")) & F.col("porte").eqNullSafe(F.col("_r_size")), "left")
    )
    lines = F.array(
        F.concat(F.lit("**"), size_label(F.col("porte")), F.lit(" — "), F.col("escopo_label"), F.lit("**")),
        F.lit(""),
        F.concat(F.lit("- Valor apurado: "), thousands(F.col("valor"))),
        F.concat(F.lit("- Recorte territorial: "), F.col("escopo_label")),
        F.concat(F.lit("- Data de referência: "), F.coalesce(F.nullif("data_referencia", F.lit("")), F.lit("não informada"))),
        F.when(F.col("escopo") != "municipio", F.concat(F.lit("- Municípios considerados: "), F.col("municipios"))),
        F.when(F.col("fonte") != "", F.concat(F.lit("- Fonte: "), F.col("fonte"))),
        F.when(wants_breakdown(F.col("text")) & F.col("porte").isNull(), F.col("_shares")),
        F.when(wants_ranking(F.col("text")), F.col("_ranks")),
        F.lit(""),
        F.lit("_Resultado calculado sobre fonte estática, conforme regras de negócio vigentes._"),
    )
    text = F.when(F.col("encontrado"), F.array_join(F.array_compact(lines), "\n")).otherwise(F.col("mensagem"))
    return joined.select("question_id", text.alias("resposta"))


def _per_scope(dataset: DataFrame) -> DataFrame:
    """Totals per size for each municipality, each regional office and the state."""
    scopes = F.array(
        F.struct(F.lit("municipio").alias("scope"), F.col("municipio").alias("key")),
        F.struct(F.lit("regional").alias("scope"), F.col("regional").alias("key")),
        F.struct(F.lit("estado").alias("scope"), F.lit("").alias("key")),
    )
    once = dataset.where(F.col("porte").isNotNull()).groupBy("municipio", "regional", "porte").agg(F.sum("total").alias("total"))
    return once.select(F.explode(scopes).alias("s"), "porte", "total").where("s.key IS NOT NULL").groupBy("s.scope", "s.key", "porte").agg(F.sum("total").alias("total"))


def _breakdown_blocks(dataset: DataFrame) -> DataFrame:
    whole = F.sum("total").over(Window.partitionBy("scope", "key"))
    line = F.concat(F.lit("- "), F.col("porte"), F.lit(": "), thousands(F.col("total")), F.lit(" ("), percent(F.col("total") / F.when(whole == 0, 1).otherwise(whole)), F.lit(")"))
    sized = _per_scope(dataset).withColumn("_line", line)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("a"), F.col("porte").alias("b"), "_line"))), lambda x: x["_line"])
    block = F.array_join(F.concat(F.array(F.lit(""), F.lit("**Distribuição por porte**"), F.lit("")), ordered), "\n")
    return sized.groupBy(F.col("scope").alias("_b_scope"), F.col("key").alias("_b_key")).agg(block.alias("_shares"))


def _ranking_blocks(dataset: DataFrame, limit: int = 10) -> DataFrame:
    kept = dataset.where(F.col("municipio").isNotNull() & F.col("regional").isNotNull()).groupBy("municipio", "regional", "porte").agg(F.sum("total").alias("total"))
    views = F.explode(
        F.flatten(F.array(*[F.array(*[F.struct(k.alias("key"), s.alias("size")) for s in (F.lit(None).cast("string"), F.col("porte"))]) for k in (F.lit(""), F.col("regional"))]))
    )
    # distinct, since a row without a size would else count twice in the view of all sizes
    spread = kept.select("municipio", "regional", "porte", "total", views.alias("v")).distinct().select("municipio", "regional", F.col("v.key").alias("_r_key"), F.col("v.size").alias("_r_size"), "total")
    sums = spread.groupBy("_r_key", "_r_size", "municipio", "regional").agg(F.sum("total").alias("total"))
    rank = F.row_number().over(Window.partitionBy("_r_key", "_r_size").orderBy(F.desc("total"), "municipio", "regional"))
    top = sums.withColumn("_rank", rank).where(F.col("_rank") <= limit)
    line = F.concat(F.col("_rank"), F.lit(". "), F.col("municipio"), F.lit(" ("), F.col("regional"), F.lit("): "), thousands(F.col("total")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_rank", line.alias("line")))), lambda x: x["line"])
    block = F.array_join(F.concat(F.array(F.lit(""), F.lit("**Municípios com maiores volumes**"), F.lit("")), ordered), "\n")
    return top.groupBy("_r_key", "_r_size").agg(block.alias("_ranks"))

"""One query per job, over whole tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vocab import GENERIC_PLACES, REGIONS, SECTORS, STATE_WIDE, THEMES
from ..operators import answers as A
from ..operators import catalog as C
from ..operators import chunking, headers, index, retrieval, store, tfidf, validate, vectors
from ..operators import indicators as I
from ..sources import documents as S
from ..sources import registry as R
from ..sources.scratch import shared_dir, written
from ..sources.writer import write_documents
from .roles import KEY, SQL, dataset, documents, questions, registry, regions, sourced, table, tidy, turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the rest of its SQL (after the common tables)."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = SQL.rstrip() + (",\n" if sql.lstrip().startswith("+") else "\n") + sql.lstrip().removeprefix("+")
        return f

    return add


def strip_accents(text: str) -> str:
    """Letters without their accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


NORM = "trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g'))"

# Company indicators


@query('SELECT municipio, regional, total, row_number() OVER (ORDER BY total DESC, municipio, regional) AS posicao FROM (SELECT municipio, regional, sum(total)::BIGINT AS total FROM dataset WHERE municipio IS NOT NULL AND regional IS NOT NULL GROUP BY 1, 2) ORDER BY total DESC, municipio, regional LIMIT 10')
def place_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten places with most companies."""
    return I.place_ranking(dataset(spark, sf_dir))


@query("SELECT nr_cnpj, cd_municipio, nm_municipio, regional, territorio FROM joined")
def indicator_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company with its regional office."""
    return I.with_regions(registry(spark, sf_dir), regions(spark, sf_dir)).select("nr_cnpj", "cd_municipio", "nm_municipio", "regional", "territorio")


@query("SELECT * FROM counts")
def indicator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies per place and category of three types."""
    return I.count_by_category(I.with_regions(registry(spark, sf_dir), regions(spark, sf_dir)))


@query("SELECT * FROM tidy")
def size_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tidy indicator table."""
    return tidy(spark, sf_dir)


@query("SELECT * FROM dataset")
def query_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies per place and size."""
    return dataset(spark, sf_dir)


@query("SELECT sum(total)::BIGINT AS valor, count(*) AS linhas, count(DISTINCT municipio) AS municipios, 'set-2026' AS data_referencia FROM dataset WHERE regional = 'ASIA' AND porte = 'ME'")
def scope_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of one regional office and size."""
    return I.slice_total(I.scoped(dataset(spark, sf_dir), regional="ASIA", size="ME"))


@query("SELECT porte, sum(total)::BIGINT AS total, sum(total) / sum(sum(total)) OVER () AS participacao FROM dataset WHERE porte IS NOT NULL AND regional = 'EUROPE' GROUP BY porte")
def size_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of a regional office by size, with shares."""
    return I.size_breakdown(I.scoped(dataset(spark, sf_dir), regional="EUROPE"))


@query("SELECT c_nationkey::VARCHAR AS cod_ibge, count(*) AS linhas FROM customer GROUP BY 1 HAVING count(*) > 1")
def repeated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that a region table (here customers' nations) repeats."""
    return I.repeated_codes(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("cod_ibge")))


# Questions

_PLACES = r"""+
names AS (SELECT name, min(codigo_ibge) AS code FROM (SELECT municipio AS name, codigo_ibge FROM dataset UNION ALL SELECT regional, codigo_ibge FROM dataset) WHERE name IS NOT NULL GROUP BY 1),
hits AS (SELECT question_id, name, row_number() OVER (PARTITION BY question_id ORDER BY length(name) DESC, code, name) AS r
  FROM sized JOIN names ON regexp_matches(norm, '\b' || lower(name) || '\b'))
"""


@query(_PLACES + "SELECT question_id, name FROM hits WHERE r = 1")
def place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place that each question names."""
    data = dataset(spark, sf_dir)
    both = data.select(F.col("municipio").alias("name"), "codigo_ibge").unionByName(data.select(F.col("regional").alias("name"), "codigo_ibge"))
    names = both.groupBy("name").agg(F.min("codigo_ibge").alias("code"))
    return A.detect_place(questions(spark, sf_dir), names.select("name", F.ascii("code").alias("ordem")))


@query("SELECT question_id, porte FROM sized")
def size_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company size that each question names."""
    return questions(spark, sf_dir).select("question_id", A.detect_size(F.col("text")).alias("porte"))


_UNKNOWN = r"""+
known AS (SELECT DISTINCT lower(strip_accents(name)) AS k FROM (SELECT municipio AS name FROM dataset UNION ALL SELECT regional FROM dataset) WHERE name IS NOT NULL
  UNION SELECT unnest(['santa catarina', 'sc', 'estado', 'brasil'])),
found AS (SELECT question_id, list_concat(
    regexp_extract_all(text, '\bregion(?:al|ais)\s+(?:d[aeo]\s+)?([A-ZÁÇ][\wÁÂÃÇáâãçíóéú''-]+(?:\s+(?:d[aeo]s?\s+)?[A-ZÁÇ][\wÁÂÃÇáâãçíóéú''-]+)*)', 1),
    regexp_extract_all(text, '\b(?:em|de|do|da|no|na|para)\s+([A-ZÁÇ][\wÁÂÃÇáâãçíóéú''-]+(?:\s+(?:d[aeo]s?\s+)?[A-ZÁÇ][\wÁÂÃÇáâãçíóéú''-]+)*)', 1)) AS c FROM questions),
candidates AS (SELECT question_id, unnest(c) AS raw, generate_subscripts(c, 1) AS pos FROM found),
strange AS (SELECT * FROM candidates WHERE NOT EXISTS (SELECT 1 FROM known WHERE contains(k, lower(strip_accents(raw))) OR contains(lower(strip_accents(raw)), k))),
unknown AS (SELECT question_id, arg_min(raw, pos) AS desconhecido FROM strange GROUP BY 1)
"""


@query(_UNKNOWN + "SELECT * FROM unknown")
def unknown_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that questions name and the data don't have."""
    data = dataset(spark, sf_dir)
    places = data.select(F.col("municipio").alias("name")).unionByName(data.select(F.col("regional").alias("name")))
    return A.unknown_place(questions(spark, sf_dir), places, GENERIC_PLACES)


_ANSWERS = (
    _UNKNOWN.rstrip()
    + r""",
towns AS (SELECT question_id, arg_max(municipio, length(municipio)) AS town FROM sized JOIN (SELECT DISTINCT municipio FROM dataset) ON regexp_matches(norm, '\b' || lower(municipio) || '\b') GROUP BY 1),
offices AS (SELECT question_id, arg_max(regional, length(regional)) AS office FROM sized JOIN (SELECT DISTINCT regional FROM dataset WHERE regional IS NOT NULL) ON regexp_matches(norm, '\b' || lower(regional) || '\b') GROUP BY 1),
scoped AS (SELECT *, CASE WHEN town IS NOT NULL THEN 'municipio' WHEN office IS NOT NULL THEN 'regional' WHEN desconhecido IS NULL THEN 'estado' END AS escopo
  FROM sized LEFT JOIN towns USING (question_id) LEFT JOIN offices USING (question_id) LEFT JOIN unknown USING (question_id)),
sourced AS (SELECT *, 'registro ' || length(municipio) AS fonte FROM dataset),
slices AS (SELECT s.question_id, d.* FROM scoped s JOIN sourced d ON (s.escopo = 'estado' OR (s.escopo = 'municipio' AND d.municipio = town) OR (s.escopo = 'regional' AND d.regional = office))
  AND (s.porte IS NULL OR s.porte = d.porte)),
answers AS (SELECT s.question_id, any_value(s.text) AS text, any_value(s.escopo) AS escopo, any_value(s.porte) AS porte,
    any_value(CASE s.escopo WHEN 'municipio' THEN town WHEN 'regional' THEN 'Regional ' || office WHEN 'estado' THEN 'Santa Catarina' END) AS escopo_label,
    sum(total)::BIGINT AS valor, count(d.municipio) AS linhas, nullif(count(DISTINCT d.municipio), 0) AS municipios, any_value(desconhecido) AS desconhecido,
    string_agg(DISTINCT d.fonte, ', ' ORDER BY d.fonte) AS fonte
  FROM scoped s LEFT JOIN sourced d ON (s.escopo = 'estado' OR (s.escopo = 'municipio' AND d.municipio = town) OR (s.escopo = 'regional' AND d.regional = office))
    AND (s.porte IS NULL OR s.porte = d.porte) GROUP BY s.question_id)
"""
)


@query(
    _ANSWERS
    + """SELECT question_id, linhas > 0 AS encontrado, valor, escopo, escopo_label, porte, linhas, municipios, CASE WHEN linhas > 0 THEN 'set-2026' END AS data_referencia, fonte,
  CASE WHEN escopo IS NULL THEN 'Não encontrei ''' || desconhecido || ''' na fonte estática. Confirme a grafia do município ou da regional. Ausência de registro não deve ser interpretada como valor zero.'
    WHEN linhas = 0 THEN 'Não há registros na fonte para o recorte solicitado (' || escopo_label || coalesce(' / porte ' || porte, '') || '). Ausência de registro não deve ser interpretada como valor zero.' ELSE '' END AS mensagem
FROM answers"""
)
def question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to each question."""
    return A.answer_questions(questions(spark, sf_dir), sourced(spark, sf_dir)).drop("text", "indicador")


@query(_ANSWERS + "SELECT question_id, codigo_ibge, municipio, regional, porte, data_referencia, total, fonte FROM slices")
def answer_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each answer sums up."""
    data = sourced(spark, sf_dir)
    return A.answer_details(A.answer_questions(questions(spark, sf_dir), data), data)


@query(_ANSWERS + "SELECT a.question_id, a.escopo, CASE a.escopo WHEN 'estado' THEN '' ELSE regexp_replace(escopo_label, '^Regional ', '') END AS lugar, a.porte FROM answers a WHERE linhas > 0")
def answer_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which slice of the dataset each answer sums up."""
    return A.answer_slices(A.answer_questions(questions(spark, sf_dir), sourced(spark, sf_dir)))


@query(
    _ANSWERS
    + """SELECT DISTINCT a.escopo AS _scope, CASE a.escopo WHEN 'estado' THEN '' ELSE regexp_replace(escopo_label, '^Regional ', '') END AS _key, a.porte AS _size, codigo_ibge, municipio, regional, s.porte, data_referencia, total, s.fonte
FROM answers a JOIN slices s USING (question_id)"""
)
def slice_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each slice that answers sum up, each slice once."""
    data = sourced(spark, sf_dir)
    return A.slice_details(A.answer_questions(questions(spark, sf_dir), data), data)


_TEXTS = (
    _ANSWERS.rstrip()
    + r""",
dots AS (SELECT question_id, replace(format('{:,}', valor), ',', '.') AS valor FROM answers WHERE linhas > 0),
places AS (SELECT question_id, escopo, CASE escopo WHEN 'estado' THEN '' ELSE regexp_replace(escopo_label, '^Regional ', '') END AS lugar FROM answers WHERE linhas > 0),
spread AS (SELECT question_id, d.porte, sum(total)::BIGINT AS t, sum(sum(total)) OVER (PARTITION BY question_id) AS whole FROM places p JOIN dataset d
  ON p.escopo = 'estado' OR (p.escopo = 'municipio' AND d.municipio = lugar) OR (p.escopo = 'regional' AND d.regional = lugar) WHERE d.porte IS NOT NULL GROUP BY 1, 2),
shares AS (SELECT question_id, string_agg('- ' || porte || ': ' || replace(format('{:,}', t), ',', '.') || ' (' || format('{:.1f}', 100.0 * t / CASE whole WHEN 0 THEN 1 ELSE whole END) || '%)', chr(10) ORDER BY t DESC, porte) AS b FROM spread GROUP BY 1),
sums AS (SELECT a.question_id, d.municipio, d.regional, sum(total)::BIGINT AS t, row_number() OVER (PARTITION BY a.question_id ORDER BY sum(total) DESC, d.municipio, d.regional) AS r
  FROM answers a JOIN places p USING (question_id) JOIN dataset d ON (a.porte IS NULL OR a.porte = d.porte) AND (p.escopo <> 'regional' OR d.regional = lugar)
  WHERE d.municipio IS NOT NULL AND d.regional IS NOT NULL GROUP BY 1, 2, 3),
ranks AS (SELECT question_id, string_agg(r || '. ' || municipio || ' (' || regional || '): ' || replace(format('{:,}', t), ',', '.'), chr(10) ORDER BY r) AS b FROM sums WHERE r <= 10 GROUP BY 1),
said AS (SELECT question_id, CASE WHEN escopo IS NULL THEN 'Não encontrei ''' || desconhecido || ''' na fonte estática. Confirme a grafia do município ou da regional. Ausência de registro não deve ser interpretada como valor zero.'
  ELSE 'Não há registros na fonte para o recorte solicitado (' || escopo_label || coalesce(' / porte ' || porte, '') || '). Ausência de registro não deve ser interpretada como valor zero.' END AS mensagem FROM answers WHERE linhas = 0)
SELECT a.question_id, coalesce(said.mensagem, array_to_string(list_filter([
  '**' || CASE a.porte WHEN 'MEI' THEN 'MEIs ativos' WHEN 'ME' THEN 'Microempresas ativas' WHEN 'EPP' THEN 'Empresas de pequeno porte ativas' ELSE 'Empresas ativas' END || ' — ' || escopo_label || '**', '',
  '- Valor apurado: ' || dots.valor, '- Recorte territorial: ' || escopo_label, '- Data de referência: set-2026', CASE WHEN a.escopo <> 'municipio' THEN '- Municípios considerados: ' || municipios END, '- Fonte: ' || fonte,
  CASE WHEN contains(text, 'por porte') AND a.porte IS NULL THEN chr(10) || '**Distribuição por porte**' || chr(10) || chr(10) || shares.b END,
  CASE WHEN contains(text, 'ranking') THEN chr(10) || '**Municípios com maiores volumes**' || chr(10) || chr(10) || ranks.b END,
  '', '_Resultado calculado sobre fonte estática, conforme regras de negócio vigentes._'], lambda x: x IS NOT NULL), chr(10))) AS resposta
FROM answers a LEFT JOIN dots USING (question_id) LEFT JOIN shares USING (question_id) LEFT JOIN ranks USING (question_id) LEFT JOIN said USING (question_id)"""
)


@query(_TEXTS)
def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to each question as text, with the blocks it asks for."""
    data = sourced(spark, sf_dir)
    return A.render_answers(A.answer_questions(questions(spark, sf_dir), data), data)


@query("SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1")
def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation's user said last."""
    return A.last_user_turn(table(spark, sf_dir, "conversations"))


@query(
    """SELECT question_id, CASE WHEN regexp_matches(lower(text), 'quantos|quantidade|total|número|valor|quantas|top') THEN 'quantitative' ELSE 'qualitative' END AS intencao,
  regexp_matches(lower(text), 'ranking|top |maiores|principais munic[ií]pios|quais munic[ií]pios') AS ranking, regexp_matches(lower(text), 'por porte|distribuicao|distribuição|composicao|composição') AS composicao
FROM (SELECT * FROM questions UNION ALL SELECT -question_id, text FROM turns)"""
)
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question and turn asks for."""
    both = questions(spark, sf_dir).unionByName(turns(spark, sf_dir).selectExpr("-question_id AS question_id", "text"))
    return both.select("question_id", A.intent(F.col("text")).alias("intencao"), A.wants_ranking(F.col("text")).alias("ranking"), A.wants_breakdown(F.col("text")).alias("composicao"))


_REGION_CASES = " ".join(f"WHEN contains({NORM.format('text')}, {NORM.format(chr(39) + r + chr(39))}) THEN '{r}'" for r in sorted(REGIONS, key=len, reverse=True))
_ASKED = "concat(text, ' ', CASE question_id % 4 WHEN 0 THEN 'em 2024 e 2031' WHEN 1 THEN 'no Extremo oeste' WHEN 2 THEN 'consultoria 1999' ELSE '' END)"


@query(f"SELECT question_id, list_max([x::INTEGER FOR x IN regexp_extract_all(text, '\\b20\\d\\d\\b')]) AS ano, CASE {_REGION_CASES} END AS regional FROM (SELECT question_id, {_ASKED} AS text FROM turns)")
def question_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and region that each turn names."""
    asked = turns(spark, sf_dir).selectExpr("question_id", f"{_ASKED} AS text")
    return asked.select("question_id", retrieval.question_year(F.col("text")).alias("ano"), retrieval.question_region(F.col("text")).alias("regional"))


# Text functions


@query(f"SELECT doc_id, sha256({NORM.format('text')}) AS resumo, length({NORM.format('text')}) AS tamanho FROM documents")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document normalised."""
    return table(spark, sf_dir, "documents").select("doc_id", X.normalise(F.col("text")).alias("t")).select("doc_id", F.sha2("t", 256).alias("resumo"), F.length("t").alias("tamanho"))


@query("SELECT doc_id, sha256(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')) AS resumo FROM documents")
def ascii_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in ASCII."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.ascii_name(F.col("text")), 256).alias("resumo"))


@query("SELECT doc_id, sha256(text) AS conteudo_hash, sha256(source || '|' || doc_id || '|' || text) AS chunk_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of every document."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", X.content_hash(F.col("text")).alias("conteudo_hash"), X.content_hash(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_hash"))


@query("SELECT o_orderkey, replace(format('{:,}', o_totalprice::BIGINT), ',', '.') AS valor, regexp_replace(trim(o_custkey || '.0 '), '\\.0$', '') AS codigo FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice, o_custkey FROM orders)")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and codes as text."""
    code = F.concat(F.col("o_custkey").cast("string"), F.lit(".0 "))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.thousands(F.floor("o_totalprice")).alias("valor"), X.municipality_code(code).alias("codigo"))


# Sources and the index

_LISTING = "SELECT 'd' || doc_id AS chave, nullif(sha256(text), '') AS etag FROM documents"
_STATE = "SELECT 'd' || CASE WHEN lang = 'de' THEN doc_id + 1000000000 ELSE doc_id END AS documento_chave, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN sha256(text) ELSE sha256(text || 'x') END AS origem_etag FROM documents"
# in the index state, documents in one language have other keys: as if renamed since
_OLD_KEY = "concat('d', CASE WHEN lang = 'de' THEN doc_id + 1000000000 ELSE doc_id END)"


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) AS chave", "sha2(text, 256) AS etag")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN sha2(text, 256) ELSE sha2(concat(text, 'x'), 256) END"
    return table(spark, sf_dir, "documents").selectExpr(f"{_OLD_KEY} AS documento_chave", f"{tag} AS origem_etag")


@query(f"+ listing AS ({_LISTING}), state AS ({_STATE}) SELECT chave, etag, etag IS NULL OR etag IS DISTINCT FROM origem_etag AS pendente FROM listing LEFT JOIN state ON chave = documento_chave")
def pending_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that must be indexed again."""
    return S.split_pending(_listing(spark, sf_dir), _state(spark, sf_dir))


@query(f"+ listing AS ({_LISTING}), state AS ({_STATE}) SELECT documento_chave FROM state WHERE documento_chave NOT IN (SELECT chave FROM listing)")
def orphan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are listed no more."""
    return S.removed_documents(_listing(spark, sf_dir), _state(spark, sf_dir))


_SYNC = """+ mine AS (SELECT 'd' || doc_id AS chave, sha256(text) AS h, sha256(source) AS b FROM documents),
theirs AS (SELECT 'd' || CASE WHEN lang = 'de' THEN doc_id + 1000000000 ELSE doc_id END AS chave, CASE doc_id % 4 WHEN 0 THEN sha256(source) WHEN 1 THEN sha256(text) END AS r FROM documents),
plan AS (SELECT coalesce(mine.chave, theirs.chave) AS chave, CASE WHEN mine.chave IS NULL THEN 'removido' WHEN theirs.chave IS NULL THEN 'enviado' WHEN r IN (h, b) THEN 'inalterado' ELSE 'atualizado' END AS status
  FROM mine FULL JOIN theirs ON mine.chave = theirs.chave) """


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mine = docs.selectExpr("concat('d', doc_id) AS chave", "sha2(source, 256) AS hash_bruto", "sha2(text, 256) AS conteudo_hash")
    theirs = docs.selectExpr(f"{_OLD_KEY} AS chave", "CASE doc_id % 4 WHEN 0 THEN sha2(source, 256) WHEN 1 THEN sha2(text, 256) END AS remoto_hash")
    return S.sync_plan(mine, theirs, remove=True)


@query(_SYNC + "SELECT * FROM plan")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What publishing does with each document."""
    return _plan(spark, sf_dir)


@query(
    """+ mine AS (SELECT 'd' || doc_id AS chave, sha256(text) AS h, sha256(source) AS b FROM documents),
theirs AS (SELECT 'd' || CASE WHEN source = 'src7' AND lang = 'de' THEN doc_id + 1000000000 ELSE doc_id END AS chave, CASE WHEN source = 'src3' THEN NULL ELSE sha256(text) END AS r FROM documents)
SELECT coalesce(mine.chave, theirs.chave) AS chave, CASE WHEN mine.chave IS NULL THEN 'removido' WHEN theirs.chave IS NULL THEN 'enviado' ELSE 'atualizado' END AS status
FROM mine FULL JOIN theirs ON mine.chave = theirs.chave WHERE r IS NULL OR mine.chave IS NULL OR r NOT IN (h, b)"""
)
def sync_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What publishing must do where few documents changed, by trees of digests."""
    docs = table(spark, sf_dir, "documents")
    local = docs.selectExpr("concat('d', doc_id) AS chave", "sha2(source, 256) AS hash_bruto", "sha2(text, 256) AS conteudo_hash")
    moved = "concat('d', CASE WHEN source = 'src7' AND lang = 'de' THEN doc_id + 1000000000 ELSE doc_id END)"
    remote = docs.selectExpr(f"{moved} AS chave", "CASE WHEN source = 'src3' THEN NULL ELSE sha2(text, 256) END AS remoto_hash")
    trees = [written(S.digest_tree(d, c, leaves=4096), "digests") for d, c in ((local, "hash_bruto"), (local, "conteudo_hash"), (remote, "remoto_hash"))]
    return S.sync_changes(local, remote, trees[:2], trees[2], remove=True, leaves=4096)


@query(_SYNC + "SELECT status, count(*) AS quantidade FROM plan GROUP BY 1")
def sync_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents publishing sends, updates, leaves and removes."""
    return index.status_totals(_plan(spark, sf_dir))


def _docs_table(spark: SparkSession, sf_dir: str, key: str, suffix: str) -> DataFrame:
    columns = [f"{key} AS documento_chave", f"concat(source, '{suffix}') AS titulo", "sha2(text, 256) AS conteudo_hash", "CAST(2000 + doc_id % 30 AS INT) AS ano"]
    return table(spark, sf_dir, "documents").selectExpr(*columns)


@query(
    """SELECT 'd' || doc_id AS documento_chave, source || '-novo' AS titulo, sha256(text) AS conteudo_hash, (2000 + doc_id % 30)::INTEGER AS ano,
  CASE WHEN lang = 'de' THEN '2026' ELSE '2025' END AS criado_em, '2026' AS atualizado_em, '2026' AS ingerido_em FROM documents
UNION ALL SELECT 'd' || (doc_id + 1000000000), source, sha256(text), (2000 + doc_id % 30)::INTEGER, '2025', '2025', '2025' FROM documents WHERE lang = 'de'"""
)
def doc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table after new and changed ones."""
    stamps = {c: F.lit("2025") for c in ("criado_em", "atualizado_em", "ingerido_em")}
    return index.upsert_documents(_docs_table(spark, sf_dir, _OLD_KEY, "").withColumns(stamps), _docs_table(spark, sf_dir, "concat('d', doc_id)", "-novo"), F.lit("2026"))


def _lines(spark: SparkSession, sf_dir: str, key: str, mark: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.expr(key).alias("documento_chave"), F.posexplode(F.split("text", "\n")).alias("chunk_indice", "chunk_texto"), F.lit(mark).alias("lote"))
    return lines.withColumn("chunk_hash", X.content_hash(F.col("documento_chave"), F.col("chunk_indice"), F.col("chunk_texto"))).drop("chunk_texto")


def _lines_sql(key: str, mark: str) -> str:
    return f"""SELECT documento_chave, chunk_indice, '{mark}' AS lote, sha256(documento_chave || '|' || chunk_indice || '|' || t) AS chunk_hash FROM (
  SELECT {key} AS documento_chave, unnest(string_split(text, chr(10))) AS t, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS chunk_indice FROM documents)"""


_NEW_KEY = "concat('d', doc_id)"


@query(f"+ old AS ({_lines_sql(_OLD_KEY, 'a')}), new AS ({_lines_sql(_NEW_KEY, 'b')}) SELECT * FROM new UNION ALL SELECT * FROM old WHERE documento_chave NOT IN (SELECT documento_chave FROM new)")
def chunk_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks table after documents were processed again."""
    new = _lines(spark, sf_dir, _NEW_KEY, "b")
    return index.replace_chunks(_lines(spark, sf_dir, _OLD_KEY, "a"), new, new)


@query(f"+ old AS ({_lines_sql(_NEW_KEY, 'a')}) SELECT * FROM old WHERE documento_chave NOT IN (SELECT 'd' || doc_id FROM documents WHERE source = 'src7')")
def doc_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks table without the documents of a source."""
    gone = table(spark, sf_dir, "documents").where("source = 'src7'").selectExpr("concat('d', doc_id) AS documento_chave")
    return index.remove_documents(_lines(spark, sf_dir, _NEW_KEY, "a"), gone)


def _stored(rows: DataFrame, name: str) -> str:
    """A table in buckets, in a new folder."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    store.create_table(rows, path, buckets=64)
    return path


@query(
    """SELECT 'd' || doc_id AS documento_chave, source || CASE WHEN source = 'src7' THEN '-novo' ELSE '' END AS titulo, sha256(text) AS conteudo_hash, (2000 + doc_id % 30)::INTEGER AS ano,
  CASE WHEN source = 'src7' AND lang = 'de' THEN '2026' ELSE '2025' END AS criado_em, CASE WHEN source = 'src7' THEN '2026' ELSE '2025' END AS atualizado_em, CASE WHEN source = 'src7' THEN '2026' ELSE '2025' END AS ingerido_em
FROM documents WHERE source = 'src7' OR lang <> 'de'
UNION ALL SELECT 'd' || (doc_id + 1000000000), source, sha256(text), (2000 + doc_id % 30)::INTEGER, '2025', '2025', '2025' FROM documents WHERE lang = 'de'"""
)
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored documents table after those of a source came in, new and changed: only their buckets are written again."""
    stamps = {c: F.lit("2025") for c in ("criado_em", "atualizado_em", "ingerido_em")}
    path = _stored(_docs_table(spark, sf_dir, _OLD_KEY, "").withColumns(stamps), "stored-documents")
    store.upsert_stored(spark, path, _docs_table(spark, sf_dir, "concat('d', doc_id)", "-novo").where("titulo = 'src7-novo'"), F.lit("2026"))
    return store.read_table(spark, path)


_SOURCE_KEYS = "SELECT 'd' || doc_id FROM documents WHERE source = 'src7'"


@query(
    f"""+ old AS ({_lines_sql(_OLD_KEY, 'a')}), new AS ({_lines_sql(_NEW_KEY, 'b')})
SELECT * FROM new WHERE documento_chave IN ({_SOURCE_KEYS}) UNION ALL SELECT * FROM old WHERE documento_chave NOT IN ({_SOURCE_KEYS})"""
)
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored chunks table after the documents of a source were processed again."""
    path = _stored(_lines(spark, sf_dir, _OLD_KEY, "a"), "stored-chunks")
    done = table(spark, sf_dir, "documents").where("source = 'src7'").selectExpr("concat('d', doc_id) AS documento_chave")
    store.replace_stored_chunks(spark, path, _lines(spark, sf_dir, _NEW_KEY, "b").join(done, "documento_chave", "left_semi"), done)
    return store.read_table(spark, path)


@query(f"+ old AS ({_lines_sql(_NEW_KEY, 'a')}) SELECT * FROM old WHERE documento_chave NOT IN ({_SOURCE_KEYS})")
def stored_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored chunks table without the documents of a source."""
    path = _stored(_lines(spark, sf_dir, _NEW_KEY, "a"), "stored-chunks")
    store.remove_stored(spark, path, table(spark, sf_dir, "documents").where("source = 'src7'").selectExpr("concat('d', doc_id) AS documento_chave"))
    return store.read_table(spark, path)


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with text as chunks: documents without any have none."""
    lines = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("documento_chave"), F.explode(F.split("text", "\n")).alias("t"), "lang").where("t <> ''")
    return lines.select(
        "documento_chave", F.length("t").alias("n_caracteres"), F.when(F.length("t") % 2 == 0, F.col("lang")).alias("palavras_chave"), F.col("lang").alias("modelo_llm"), F.lit("m").alias("modelo_embedding")
    )


_CHUNKS = "c AS (SELECT * FROM (SELECT 'd' || doc_id AS documento_chave, unnest(string_split(text, chr(10))) AS t, lang FROM documents) WHERE t <> '')"


@query(
    f"""+ {_CHUNKS}
SELECT 'd' || d.doc_id AS documento_chave, d.source AS titulo, count(t) AS total_chunks, count(*) FILTER (length(t) % 2 = 0) AS chunks_enriquecidos, avg(length(t)) AS media_caracteres,
  max(c.lang) AS modelo_llm, max(CASE WHEN t IS NOT NULL THEN 'm' END) AS modelo_embedding FROM documents d LEFT JOIN c ON documento_chave = 'd' || d.doc_id GROUP BY d.doc_id, d.source"""
)
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document is indexed."""
    docs = table(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) AS documento_chave", "source AS titulo")
    return index.ingest_status(docs, _chunk_rows(spark, sf_dir))


@query(
    f"""+ listing AS ({_LISTING}), state AS ({_STATE}), {_CHUNKS}, j AS (SELECT etag IS DISTINCT FROM origem_etag AS p FROM listing LEFT JOIN state ON chave = documento_chave)
SELECT (SELECT count(*) FROM j WHERE p) AS documentos, (SELECT count(*) FROM j WHERE NOT p) AS inalterados, (SELECT count(*) FROM c) AS chunks,
  (SELECT count(*) FROM state WHERE documento_chave NOT IN (SELECT chave FROM listing)) AS removidos"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an indexing run."""
    listing, state = _listing(spark, sf_dir), _state(spark, sf_dir)
    return index.run_summary(S.split_pending(listing, state), _chunk_rows(spark, sf_dir), S.removed_documents(listing, state))


@query(
    f"""+ new AS ({_lines_sql(_NEW_KEY, 'b')})
SELECT new.*, o.source AS documento_titulo, (o.doc_id % 40)::INTEGER AS ano, o.lang AS tema, 'R' AS regional, 'f' AS fonte FROM new JOIN documents o ON documento_chave = 'd' || o.doc_id"""
)
def search_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks (here lines) with their documents' fields."""
    docs = table(spark, sf_dir, "documents").selectExpr(f"{_NEW_KEY} AS documento_chave", "source AS titulo", "CAST(doc_id % 40 AS INT) AS ano", "lang AS tema", "'R' AS regional", "'f' AS fonte")
    return index.search_view(docs, _lines(spark, sf_dir, _NEW_KEY, "b"))


@query(
    """+ q AS (SELECT vec_id AS question_id, [x::DOUBLE FOR x IN embedding] AS qv FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT question_id, vec_id, label, embedding, list_cosine_distance(qv, [x::DOUBLE FOR x IN embedding]) AS distancia FROM q JOIN embeddings ON vec_id <> question_id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distancia, vec_id) AS posicao FROM d)
SELECT question_id, posicao::INTEGER AS posicao, vec_id AS chunk_id, 'v' || label AS documento_titulo, 'v' || label || ' > ' || vec_id AS heading_path, (2000 + label % 7)::INTEGER AS ano, round(distancia, 4) AS distancia,
  '[' || array_to_string([format('{:.8f}', x::DOUBLE) FOR x IN embedding], ',') || ']' AS vetor FROM r WHERE posicao <= 6"""
)
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search reports of the nearest vectors of every hundredth, without itself, and those vectors as text; their dimension is checked."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").selectExpr("vec_id AS question_id", "embedding AS vetor")
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), vectors.check_dimension(F.col("embedding"), 64).alias("embedding"))
    found = vectors.nearest_chunks(asked, chunks, k=7, max_distance=None).where("question_id <> chunk_id")
    ranked = found.withColumn("posicao", F.row_number().over(Window.partitionBy("question_id").orderBy("posicao"))).where("posicao <= 6")
    title = F.concat(F.lit("v"), "label")
    of = rows.select(F.col("vec_id").alias("chunk_id"), title.alias("documento_titulo"), F.concat(title, F.lit(" > "), "vec_id").alias("heading_path"), (2000 + F.col("label") % 7).cast("int").alias("ano"), index.vector_text(F.col("embedding")).alias("vetor"))
    return retrieval.hits(ranked.join(of, "chunk_id"), "vetor")


# Documents


@query("SELECT chave, regexp_matches(conteudo, '(?s)\\A---\\s*\\n.*?\\n---\\s*\\n?') AS tem, sha256(regexp_extract(conteudo, '(?s)\\A---\\s*\\n(.*?)\\n---\\s*\\n?(.*)\\z', 1)) AS bloco, sha256(regexp_replace(conteudo, '(?s)\\A---\\s*\\n.*?\\n---\\s*\\n?', '')) AS corpo FROM studies")
def header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and body of every document."""
    text = F.col("conteudo")
    return documents(spark, sf_dir).select("chave", headers.has_header(text).alias("tem"), F.sha2(headers.header_block(text), 256).alias("bloco"), F.sha2(headers.body(text), 256).alias("corpo"))


_FIELD = r"nullif(trim(regexp_extract(bloco, '(?m)^{0}:[ \t]*(.*)$', 1)), '')"


@query(
    rf"""+ b AS (SELECT chave, regexp_extract(conteudo, '(?s)\A---\s*\n(.*?)\n---\s*\n?(.*)\z', 1) AS bloco, regexp_replace(conteudo, '(?s)\A---\s*\n.*?\n---\s*\n?', '') AS corpo, regexp_extract(chave, '([^/]*)\.md$', 1) AS nome FROM studies),
t AS (SELECT *, coalesce({_FIELD.format('title')}, {_FIELD.format('titulo')}, nullif(trim(regexp_extract(corpo, '(?m)^[ \t]*#[ \t]+(.+?)[ \t]*#*[ \t]*$', 1)), ''), replace(nome, '_', ' ')) AS titulo FROM b)
SELECT chave, titulo, try_cast(coalesce({_FIELD.format('ano')}, {_FIELD.format('year')}, nullif(regexp_extract(nome, '\b(?:19|20)\d\d\b'), ''), nullif(regexp_extract(titulo, '\b(?:19|20)\d\d\b'), '')) AS INTEGER) AS ano FROM t"""
)
def doc_title_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and year of every document."""
    return headers.parse_documents(documents(spark, sf_dir)).select("chave", "titulo", "ano")


@query(
    """SELECT doc_id, w - 1 AS indice, sha256(trim(substr(text, (w - 1)::BIGINT * 1000 + 1, 1200))) AS resumo FROM (SELECT doc_id, text, unnest(range(1, 2 + greatest(0, ceil((length(text) - 1200) / 1000))::BIGINT)) AS w FROM documents)
WHERE trim(substr(text, (w - 1)::BIGINT * 1000 + 1, 1200)) <> ''"""
)
def fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in overlapping windows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.fixed_windows(F.col("text"))).alias("indice", "w"))
    return rows.select("doc_id", F.col("indice").cast("long").alias("indice"), F.sha2("w", 256).alias("resumo"))


# each fourth study, with headings, blank lines, no spaces, or as it is: texts that reach every level of splitting
_DEEP = """CASE length(chave) % 4 WHEN 1 THEN replace(replace(conteudo, '. ', concat('.', chr(10), '## Parte', chr(10))), ', ', concat(chr(10), chr(10), '### Item #', chr(10), chr(10)))
  WHEN 2 THEN concat(replace(conteudo, '. ', concat('.', chr(10), chr(10))), chr(10), '# Fim', chr(10), '```', chr(10), '# nada', chr(10), '```', chr(10), 'fim')
  WHEN 3 THEN replace(replace(conteudo, ' ', ''), chr(10), '_') ELSE conteudo END"""
_WHITE = chunking.SPACE


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


def _chunks_sql(size: int = 1200, overlap: int = 200) -> str:
    """One pair of tables a level: long parts as blocks, and their parts after a fold over the blocks' lengths."""
    out = f"""+ corpos AS (SELECT chave, coalesce(conteudo, '') AS t FROM (SELECT chave, {_DEEP} AS conteudo FROM studies)),
p0 AS (SELECT chave, []::INTEGER[] AS nth, {_stripped('t')} AS p FROM corpos WHERE {_stripped('t')} <> ''),
"""
    for k, separator in enumerate(chunking.SEPARATORS):
        mark = separator.replace("\n", "' || chr(10) || '")
        cost = f"y.n + {len(separator)}"
        full = f"(x.ix > x.first AND x.used + {cost} > {size})"
        again = f"x.last <= {overlap}"
        out += f"""b{k} AS (SELECT chave, nth, p, list_filter(string_split(p, '{mark}'), lambda b: regexp_matches(b, '[^{_WHITE}]')) AS b FROM p{k} WHERE length(p) > {size}),
f{k} AS (SELECT chave, nth, b, list_reduce(list_transform(b, lambda b: {{'runs': []::STRUCT(s INTEGER, e INTEGER)[], 'first': 0, 'ix': 0, 'used': 0, 'last': 0, 'n': length(b)::INTEGER}}), lambda x, y: {{
    'runs': CASE WHEN {full} THEN list_append(x.runs, {{'s': x.first, 'e': x.ix}}) ELSE x.runs END, 'first': CASE WHEN NOT {full} THEN x.first WHEN {again} THEN x.ix - 1 ELSE x.ix END, 'ix': x.ix + 1,
    'used': CASE WHEN NOT {full} THEN x.used + {cost} WHEN {again} THEN x.last + {cost} ELSE {cost} END, 'last': y.n, 'n': 0}},
    {{'runs': []::STRUCT(s INTEGER, e INTEGER)[], 'first': 0, 'ix': 0, 'used': 0, 'last': 0, 'n': 0}}) AS g FROM b{k} WHERE len(b) > 1),
r{k} AS (SELECT chave, nth, b, unnest(list_append(g.runs, {{'s': g.first, 'e': g.ix}})) AS r, generate_subscripts(list_append(g.runs, {{'s': g.first, 'e': g.ix}}), 1) AS i FROM f{k}),
p{k + 1} AS (SELECT chave, nth, p FROM p{k} WHERE length(p) <= {size} UNION ALL SELECT chave, nth, p FROM b{k} WHERE len(b) < 2
  UNION ALL SELECT chave, list_append(nth, i::INTEGER), {_stripped(f"array_to_string(b[r.s + 1 : r.e], '{mark}')")} FROM r{k}),
"""
    step, last = size - overlap, len(chunking.SEPARATORS)
    out += f"""w AS (SELECT chave, nth, p, unnest(range(0, 1 + ceil((length(p) - {size}) / {step}.0)::BIGINT)) AS i FROM p{last} WHERE length(p) > {size}),
z AS (SELECT chave, nth, p FROM p{last} WHERE length(p) <= {size} UNION ALL SELECT chave, list_append(nth, i::INTEGER), {_stripped(f'substr(p, i * {step} + 1, {size})')} FROM w),
chunks AS (SELECT chave, row_number() OVER (PARTITION BY chave ORDER BY nth) - 1 AS i, p FROM z WHERE p <> ''),
places AS (SELECT chave, list_reduce(list_transform(list(p ORDER BY i), lambda p: {{'ix': []::BIGINT[], 'p': p[:80], 't': ''}}),
    lambda x, y: {{'ix': list_append(x.ix, CASE WHEN instr(x.t[coalesce(x.ix[-1], 0) + 1 :], y.p) > 0 THEN coalesce(x.ix[-1], 0) + instr(x.t[coalesce(x.ix[-1], 0) + 1 :], y.p) - 1 ELSE coalesce(x.ix[-1], 0) END), 'p': '', 't': x.t}},
    {{'ix': []::BIGINT[], 'p': '', 't': any_value(t)}}).ix AS ats FROM chunks JOIN corpos USING (chave) GROUP BY chave),
lines AS (SELECT chave, unnest(regexp_extract_all(t, '[^{chunking.BREAK}]*(?:\\r\\n|[{chunking.BREAK}])|[^{chunking.BREAK}]+$')) AS l, generate_subscripts(regexp_extract_all(t, '[^{chunking.BREAK}]*(?:\\r\\n|[{chunking.BREAK}])|[^{chunking.BREAK}]+$'), 1) AS n FROM corpos),
fences AS (SELECT *, {_stripped('l')} AS bare, sum(length(l)) OVER w - length(l) AS pos, sum(starts_with({_stripped('l')}, '```')::INTEGER) OVER w AS f FROM lines WINDOW w AS (PARTITION BY chave ORDER BY n)),
heads AS (SELECT chave, n, pos, length(regexp_extract(bare, '^(#{{1,6}})[{_WHITE}]+(.+?)[{_WHITE}]*#*$', 1)) AS d, {_stripped(f"regexp_extract(bare, '^(#{{1,6}})[{_WHITE}]+(.+?)[{_WHITE}]*#*$', 2)")} AS title
  FROM fences WHERE f % 2 = 0 AND regexp_matches(bare, '^(#{{1,6}})[{_WHITE}]+(.+?)[{_WHITE}]*#*$')),
levels AS (SELECT chave, pos, {', '.join(f"max(CASE WHEN d = {u} THEN n END) OVER w AS j{u}, max_by(CASE WHEN d = {u} THEN title END, CASE WHEN d = {u} THEN n END) OVER w AS t{u}" for u in range(1, 7))}
  FROM heads WINDOW w AS (PARTITION BY chave ORDER BY n)),
paths AS (SELECT chave, pos, array_to_string(list_filter([{', '.join(f"CASE WHEN j{u} > greatest(0, {', '.join(f'coalesce(j{v}, 0)' for v in range(1, u)) or '0'}) THEN t{u} END" for u in range(1, 7))}], lambda t: t <> ''), ' > ') AS caminho FROM levels)
SELECT c.chave AS documento_chave, c.i::INTEGER AS chunk_indice, sha256(p) AS resumo, coalesce((SELECT arg_max(caminho, h.pos) FROM paths h WHERE h.chave = c.chave AND h.pos <= places.ats[c.i + 1]), '') AS heading_path,
  sha256(c.chave || '|' || c.i || '|' || p) AS chunk_hash, length(p)::INTEGER AS n_caracteres FROM chunks c JOIN places USING (chave)"""
    return out


@query(_chunks_sql())
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in chunks with heading paths."""
    bodies = documents(spark, sf_dir).selectExpr("chave", "'' AS titulo", f"{_DEEP} AS body")
    return chunking.chunk_documents(bodies).drop("documento_titulo").withColumn("chunk_texto", F.sha2("chunk_texto", 256)).withColumnRenamed("chunk_texto", "resumo")


_ASOF = "p AS (SELECT o_custkey AS doc, o_orderkey AS posicao FROM orders), h AS (SELECT o_custkey AS doc, o_orderkey AS inicio, o_orderpriority AS caminho FROM orders WHERE o_orderstatus = 'F')"


@query(f"+ {_ASOF} SELECT p.doc, posicao, coalesce(arg_max(caminho, inicio), '') AS caminho FROM p LEFT JOIN h ON p.doc = h.doc AND inicio <= posicao GROUP BY 1, 2")
def heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading (here a finished order) at or before each position (order) of a document (customer)."""
    orders = table(spark, sf_dir, "orders")
    positions = orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("posicao"))
    heads = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("inicio"), F.col("o_orderpriority").alias("caminho"))
    return chunking.heading_asof(positions, heads)


# Terms

_TERMS_SQL = """+ chunks AS (SELECT doc_id, regexp_split_to_array(text, '[.,]') AS termos FROM documents),
terms AS (SELECT doc_id, regexp_replace(unnest(termos), '^\\s+|\\s+$', '', 'g') AS term, generate_subscripts(termos, 1) AS pos FROM chunks),
toks AS (SELECT doc_id, term, pos, unnest(regexp_extract_all(lower(strip_accents(term)), '[a-z0-9_]{3,}')) AS token FROM terms WHERE term <> ''),
kept AS (SELECT * FROM toks WHERE token NOT IN ('para','com','por','dos','das','nos','nas','que','uma','sobre','como','mais','seus','suas','pelo','pela','entre','ser','foi','sao','tem','pode','deve','essa','esse','isso','the','and','for','are','this','that','from','with')),
df AS (SELECT token, count(DISTINCT doc_id) AS df, (SELECT count(*) FROM chunks) AS n FROM kept GROUP BY 1) """


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.filter(F.transform(F.split("text", "[.,]"), lambda t: X.strip(t)), lambda t: t != "")
    return table(spark, sf_dir, "documents").select("doc_id", terms.alias("termos"))


@query(_TERMS_SQL + "SELECT * FROM df")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each token of their terms."""
    return tfidf.document_frequency(_terms(spark, sf_dir), ["doc_id"])


@query(
    _TERMS_SQL.rstrip()
    + """, tf AS (SELECT doc_id, token, count(*) AS tf, arg_min(term, pos) AS term FROM kept GROUP BY 1, 2),
scored AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) * (ln((1 + n) / (1 + df)) + 1) AS score FROM tf JOIN df USING (token)),
once AS (SELECT doc_id, lower(term) AS k, arg_min(term, (-round(score, 12), term)) AS term, max(round(score, 12)) AS score FROM scored GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS r FROM once)
SELECT doc_id, coalesce(string_agg(term, ', ' ORDER BY r) FILTER (r <= 25), '') AS metadados_tfidf FROM (SELECT doc_id FROM chunks) LEFT JOIN best USING (doc_id) GROUP BY 1"""
)
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weighted terms."""
    return tfidf.weighted_terms(_terms(spark, sf_dir), ["doc_id"])


# a corpus of which a source left, another one's texts were replaced, and documents in a language came
_OLD_CHUNKS = "lang <> 'de'"
_NEW_CHUNKS = "lang = 'de' OR source = 'src3'"
_NEW_TEXT = "CASE WHEN source = 'src3' THEN concat('Novo texto, ', substr(text, 1 + CAST(length(text) / 2 AS INT)), '. Fim') ELSE text END"
_CORPUS_SQL = f"""+ final AS (SELECT doc_id, text FROM documents WHERE {_OLD_CHUNKS} AND source NOT IN ('src7', 'src3') UNION ALL SELECT doc_id, {_NEW_TEXT.replace('CAST(length(text) / 2 AS INT)', '(length(text) // 2)')} FROM documents WHERE {_NEW_CHUNKS}), """ + _TERMS_SQL.lstrip("+ ").replace("FROM documents", "FROM final")


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A stored table of frequencies after a run of indexing, and the chunks that came in it."""
    docs = table(spark, sf_dir, "documents")
    terms = F.filter(F.transform(F.split("text", "[.,]"), lambda t: X.strip(t)), lambda t: t != "")
    old = docs.where(_OLD_CHUNKS)
    come = docs.where(_NEW_CHUNKS).selectExpr("doc_id", f"{_NEW_TEXT} AS text").select("doc_id", terms.alias("termos"))
    path = f"{shared_dir(spark)}/frequencies-{uuid.uuid4().hex}"
    tfidf.store_frequencies(old.select(terms.alias("termos")), path, buckets=64)
    tfidf.update_frequencies(spark, path, old.where("source IN ('src7', 'src3')").select(terms.alias("termos")), come)
    return path, come


@query(_CORPUS_SQL + "SELECT * FROM df")
def corpus_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks hold each token, kept up with what left and came."""
    return tfidf.stored_frequencies(spark, _corpus(spark, sf_dir)[0])


@query(
    _CORPUS_SQL.rstrip()
    + f""", mine AS (SELECT doc_id FROM documents WHERE {_NEW_CHUNKS}), tf AS (SELECT doc_id, token, count(*) AS tf, arg_min(term, pos) AS term FROM kept WHERE doc_id IN (SELECT doc_id FROM mine) GROUP BY 1, 2),
scored AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) * (ln((1 + n) / (1 + df)) + 1) AS score FROM tf JOIN df USING (token)),
once AS (SELECT doc_id, lower(term) AS k, arg_min(term, (-round(score, 12), term)) AS term, max(round(score, 12)) AS score FROM scored GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS r FROM once)
SELECT doc_id, coalesce(string_agg(term, ', ' ORDER BY r) FILTER (r <= 25), '') AS metadados_tfidf FROM mine LEFT JOIN best USING (doc_id) GROUP BY 1"""
)
def corpus_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted terms of the chunks of a run, by the frequencies of the whole corpus."""
    path, come = _corpus(spark, sf_dir)
    return tfidf.weighted_terms(come, ["doc_id"], frequencies=tfidf.stored_frequencies(spark, path))


_REPLY = """concat(CASE doc_id % 4 WHEN 1 THEN concat('```json', chr(10)) WHEN 2 THEN 'Segue: ' WHEN 3 THEN 'nada ' ELSE '' END,
  CASE WHEN doc_id % 4 = 3 THEN '' ELSE concat('{"tipo_conteudo": " ', lang, ' ", "palavras_chave": ["', source, '", " "], "indicadores": "', source, '"}') END, CASE doc_id % 4 WHEN 1 THEN concat(chr(10), '```') WHEN 2 THEN ' fim' ELSE '' END)"""


_REPLIED = f"""+ r AS (SELECT doc_id, nullif(regexp_extract({_REPLY}, '(?s)\\{{.*\\}}'), '') AS j FROM documents),
m AS (SELECT doc_id, nullif(trim(json_extract_string(j, '$.tipo_conteudo')), '') AS tipo_conteudo,
    list_filter([trim(x) FOR x IN coalesce(from_json(json_extract(j, '$.palavras_chave'), '["VARCHAR"]'), [])], lambda x: x <> '') AS p, list_filter([trim(json_extract_string(j, '$.indicadores'))], lambda x: x <> '') AS i FROM r)
"""


@query(_REPLIED + "SELECT doc_id, tipo_conteudo, array_to_string(p, '|') AS palavras_chave, array_to_string(i, '|') AS indicadores, array_to_string(p || i || list_filter([tipo_conteudo], lambda x: x IS NOT NULL), '|') AS termos FROM m")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata read from replies that hold JSON in several ways."""
    read = _metadata(spark, sf_dir)
    return read.select(
        "doc_id", "m.tipo_conteudo", F.array_join("m.palavras_chave", "|").alias("palavras_chave"), F.array_join("m.indicadores", "|").alias("indicadores"), F.array_join(tfidf.metadata_terms(F.col("m")), "|").alias("termos")
    )


# replies of every shape: fenced, within talk, nested, with constants and numbers, cut short, none
_SHAPED = """CASE doc_id % 8 WHEN 0 THEN concat('{"tipo_conteudo": "', lang, '", "palavras_chave": ["', source, '", null, true, 3, 2.5, ["', lang, '"], " "], "resumo": false}')
  WHEN 1 THEN concat('```json', chr(10), '{"tipo_conteudo": ["', lang, '"], "indicadores": {"', source, '": 1}, "entidades": 0, "fontes_dados": ""}', chr(10), '```')
  WHEN 2 THEN concat('Segue: {"intencao": ', doc_id, ', "perguntas_atendidas": "  ', source, '? ", "entidades": []} fim') WHEN 3 THEN concat('{"tipo_conteudo": "', lang)
  WHEN 4 THEN '' WHEN 5 THEN concat('{"resumo": "', source, '", "resumo2": {"resumo": 1}, "indicadores": [{"a": "', lang, '"}, false]}') WHEN 6 THEN concat('["', lang, '"]') ELSE 'nada {a: b}' END"""
_ITEM = "CASE json_type({0}) WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN CASE {0}::VARCHAR WHEN 'true' THEN 'True' ELSE 'False' END ELSE json_extract_string({0}, '$') END"


def _shape_sql(name: str, many: bool) -> str:
    x = f"json_extract(j, '$.{name}')"
    item = _ITEM.format(x)
    told = f"{x} IS NOT NULL AND {item} NOT IN ('None', 'False', '0', '', '[]', '{{}}')"
    if not many:
        return f"CASE WHEN {told} THEN nullif(trim({item}), '') END AS {name}"
    return f"array_to_string(list_filter([trim(i) FOR i IN CASE WHEN json_type({x}) = 'ARRAY' THEN [coalesce({_ITEM.format('i')}, 'None') FOR i IN from_json({x}, '[\"JSON\"]')] WHEN {told} THEN [{item}] ELSE [] END], lambda i: i <> ''), '|') AS {name}"


@query(
    f"""+ r AS (SELECT doc_id, CASE WHEN json_valid(x) AND json_type(x) = 'OBJECT' THEN x WHEN json_valid(y) THEN y END AS j FROM (SELECT doc_id, x, nullif(regexp_extract(x, '(?s)\\{{.*\\}}'), '') AS y FROM
  (SELECT doc_id, regexp_replace(regexp_replace(trim({_SHAPED}), '^```(?:json)?\\s*', ''), '\\s*```$', '') AS x FROM documents)))
SELECT doc_id, {', '.join([_shape_sql(n, False) for n in tfidf.SCALARS] + [_shape_sql(n, True) for n in tfidf.LISTS])} FROM r"""
)
def metadata_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata from replies of every shape."""
    replies = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_SHAPED} AS reply")
    read = replies.select("doc_id", tfidf.clean_metadata(tfidf.reply_json(F.col("reply"))).alias("m"))
    return read.select("doc_id", *[F.col(f"m.{c}") for c in tfidf.SCALARS], *[F.coalesce(F.array_join(F.col(f"m.{c}"), "|"), F.lit("")).alias(c) for c in tfidf.LISTS])


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_REPLY} AS reply")
    return replies.select("doc_id", tfidf.clean_metadata(tfidf.reply_json(F.col("reply"))).alias("m"))


@query(
    _REPLIED
    + """SELECT doc_id, nullif(array_to_string(p, ', '), '') AS palavras_chave, nullif(array_to_string(i, ', '), '') AS indicadores,
  concat('{"tipo_conteudo":', coalesce('"' || tipo_conteudo || '"', 'null'), ',"resumo":null,"intencao":null,"palavras_chave":[', array_to_string(['"' || x || '"' FOR x IN p], ','), '],"entidades":[],"indicadores":[', array_to_string(['"' || x || '"' FOR x IN i], ','), '],"fontes_dados":[],"perguntas_atendidas":[]}') AS metadados_json FROM m"""
)
def metadata_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as the index stores it: lists as text, and all of it as JSON."""
    read = _metadata(spark, sf_dir)
    return read.select("doc_id", tfidf.list_text(F.col("m.palavras_chave")).alias("palavras_chave"), tfidf.list_text(F.col("m.indicadores")).alias("indicadores"), tfidf.metadata_json(F.col("m")).alias("metadados_json"))


# Vectors


@query("SELECT vec_id, round(list_sum([round(x / n, 9) FOR x IN v]), 6) AS soma, round(n, 6) AS norma FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS n FROM embeddings)")
def vector_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector normalised."""
    total = F.aggregate(vectors.l2_normalised(F.col("embedding")), F.lit(0.0), lambda acc, x: acc + F.round(x, 9))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 6).alias("soma"), F.round(vectors.l2_norm(F.col("embedding")), 6).alias("norma"))


@query(
    """+ m AS (SELECT vec_id - 1 AS vec_id, embedding AS e FROM embeddings),
b AS (SELECT a.vec_id, CASE WHEN e IS NULL THEN [x::DOUBLE FOR x IN embedding] ELSE [0.9 * embedding[i]::DOUBLE + 0.1 * e[i]::DOUBLE FOR i IN range(1, len(embedding) + 1)] END AS v FROM embeddings a LEFT JOIN m USING (vec_id))
SELECT vec_id, round(v[1] / n, 6) AS primeiro, round(v[-1] / n, 6) AS ultimo FROM (SELECT *, sqrt(list_sum([x * x FOR x IN v])) AS n FROM b)"""
)
def vector_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector blended with its neighbour's, where there is one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vetor"))
    meta = rows.withColumn("vec_id", F.col("vec_id") - 1)
    both = vectors.blend_tables(rows, meta, ["vec_id"])
    return both.select("vec_id", F.round(F.element_at("embedding", 1), 6).alias("primeiro"), F.round(F.element_at("embedding", -1), 6).alias("ultimo"))


_SEARCH = """+ q AS (SELECT vec_id AS question_id, embedding AS qv, CASE WHEN vec_id % 3 = 0 THEN 2003 END AS ano_min, CASE WHEN vec_id % 200 = 0 THEN 'r2' END AS regional FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS chunk_id, embedding AS cv, (2000 + label % 7)::INTEGER AS ano, CASE WHEN label % 4 <> 3 THEN 'r' || label % 4 END AS regiao FROM embeddings),
d AS (SELECT question_id, chunk_id, list_cosine_distance([x::DOUBLE FOR x IN qv], [x::DOUBLE FOR x IN cv]) AS distancia FROM q JOIN c ON (ano_min IS NULL OR ano >= ano_min) AND (regional IS NULL OR regiao = regional OR regiao IS NULL))
SELECT question_id, chunk_id, round(distancia, 6) AS distancia, r::INTEGER AS posicao FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distancia, chunk_id) AS r FROM d WHERE distancia <= 0.9) WHERE r <= 6"""


@query(_SEARCH)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every hundredth, with filters on year and region."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").selectExpr("vec_id AS question_id", "embedding AS vetor", "CASE WHEN vec_id % 3 = 0 THEN 2003 END AS ano_min", "CASE WHEN vec_id % 200 = 0 THEN 'r2' END AS regional")
    chunks = rows.selectExpr("vec_id AS chunk_id", "embedding", "CAST(2000 + label % 7 AS INT) AS ano", "CASE WHEN label % 4 <> 3 THEN concat('r', label % 4) END AS regional")
    found = vectors.nearest_chunks(asked, chunks, max_distance=0.9)
    return found.withColumn("distancia", F.round("distancia", 6))


@query(_SEARCH)
def vector_topk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with groups of vectors passed over that can't hold any of the nearest."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").selectExpr("vec_id AS question_id", "embedding AS vetor", "CASE WHEN vec_id % 3 = 0 THEN 2003 END AS ano_min", "CASE WHEN vec_id % 200 = 0 THEN 'r2' END AS regional")
    chunks = rows.selectExpr("vec_id AS chunk_id", "embedding", "CAST(2000 + label % 7 AS INT) AS ano", "CASE WHEN label % 4 <> 3 THEN concat('r', label % 4) END AS regional")
    return vectors.nearest_chunks_by_group(asked, chunks, max_distance=0.9).withColumn("distancia", F.round("distancia", 6))


@query("SELECT a.vec_id, round(list_cosine_distance([x::DOUBLE FOR x IN a.embedding], [x::DOUBLE FOR x IN b.embedding]), 6) AS distancia FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine distance of every vector to the one after it."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return rows.join(after, "vec_id").select("vec_id", F.round(vectors.cosine_distance(F.col("a"), F.col("b")), 6).alias("distancia"))


# Retrieval


@query(
    """SELECT doc_id, source || CASE WHEN doc_id % 3 <> 0 THEN ' — ' || (2000 + doc_id % 30) ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN ' — ' || lang WHEN doc_id % 4 = 3 THEN ' — ' || lang ELSE '' END AS referencia FROM documents"""
)
def citation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document's section is cited."""
    year = F.when(F.col("doc_id") % 3 != 0, (2000 + F.col("doc_id") % 30).cast("int")).otherwise(0)
    rest = F.col("doc_id") % 4
    heading = F.when(rest == 0, F.concat("source", F.lit(" > "), "lang")).when(rest == 1, F.col("source")).when(rest == 2, F.lit("")).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.citation(F.col("source"), year, heading).alias("referencia"))


@query(
    """SELECT conv_id AS question_id, coalesce(string_agg('[' || turn || '] ' || role || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) FILTER (turn > 0), '') AS contexto,
  coalesce(string_agg('**' || role || '**' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (turn > 0), 'Desculpe, não encontrei essa informação nos estudos.') AS resposta,
  coalesce(string_agg('- ' || role, chr(10) ORDER BY turn) FILTER (turn > 0), '') AS fontes FROM conversations GROUP BY 1"""
)
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context texts from ranked chunks (here the turns after a conversation's first)."""
    rows = table(spark, sf_dir, "conversations")
    found = rows.where("turn > 0").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("posicao"), F.col("role").alias("referencia"), F.col("text").alias("texto"))
    return retrieval.context_texts(rows.select(F.col("conv_id").alias("question_id")).distinct(), found)


_FORMS = "list_distinct([f FOR f IN flatten([[t, CASE WHEN length(t) > 3 AND t LIKE '%es' THEN t[:-3] END, CASE WHEN length(t) > 3 AND t LIKE '%s' THEN t[:-2] END, CASE WHEN length(t) > 3 AND t LIKE '%is' THEN t[:-3] || 'l' END] FOR t IN regexp_extract_all(strip_accents(lower({0})), '[a-z0-9_]{{3,}}') IF t NOT IN ('the', 'and')]) IF f IS NOT NULL AND length(f) >= 3])"


@query(
    f"""+ q AS (SELECT question_id, unnest({_FORMS.format("text")}) AS token FROM turns),
n AS (SELECT item_id, 'n' || item_id || '.md' AS path, text FROM benchmark),
k AS (SELECT path, unnest({_FORMS.format("'n' || item_id || ' caderno'")}) AS token, 3 AS w FROM n UNION ALL SELECT path, unnest({_FORMS.format("text")}), 1 FROM n),
s AS (SELECT question_id, path, sum(w)::BIGINT AS pontos FROM q JOIN k USING (token) GROUP BY 1, 2)
SELECT question_id, path, pontos, r::INTEGER AS posicao FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pontos DESC, path) AS r FROM s) WHERE r <= 5"""
)
def note_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes (here benchmark texts) that share most words with each turn."""
    stop = ["the", "and"]
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("n"), "item_id").alias("stem"), "text")
    keywords = X.note_tokens(F.concat_ws(" ", "stem", F.lit("caderno")), stop)
    notes = rows.select(F.concat("stem", F.lit(".md")).alias("path"), keywords.alias("keywords"), X.note_tokens(F.col("text"), stop).alias("body_tokens"))
    return retrieval.rank_notes(turns(spark, sf_dir), notes, stop)


_NOTE = "concat('---', chr(10), 'status: ', CASE lang WHEN 'es' THEN 'Deprecated' WHEN 'fr' THEN 'draft' ELSE 'approved' END, chr(10), 'fonte: ', source, chr(10), 'dominio: regras gerais', chr(10), '---', chr(10), text)"


@query(
    f"""+ n AS (SELECT 'regras/nota_' || doc_id || '.md' AS path, 'nota ' || doc_id AS title, text, source, CASE lang WHEN 'fr' THEN 'draft' ELSE 'approved' END AS status FROM documents WHERE lang IS NULL OR lang <> 'es')
SELECT path, title, array_to_string(list_sort({_FORMS.format("concat_ws(' ', title, replace(title, ' ', '_'), source, 'regras gerais')")}), ',') AS keywords, len({_FORMS.format("text")}) AS palavras,
  sha256(concat('### ', title, chr(10), '(origem: ', path[8:], ')', chr(10), chr(10), 'Metadados:', chr(10), '- status: ', status, chr(10), '- fonte: ', source, chr(10), '- dominio: regras gerais', chr(10), chr(10), trim(text))) AS contexto FROM n"""
)
def note_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule notes (here documents under a header) that are not deprecated, and each as a block of context."""
    raw = table(spark, sf_dir, "documents").selectExpr("concat('regras/nota_', doc_id, '.md') AS path", f"{_NOTE} AS conteudo")
    notes = retrieval.parse_notes(raw, ["the", "and"])
    ordered = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col("metadata")[k].alias("value")) for k in ("status", "fonte", "dominio")]), lambda e: e["value"].isNotNull()))
    context = retrieval.note_context(F.col("title"), F.col("path"), ordered, F.col("body"))
    return notes.select("path", "title", F.array_join(F.array_sort("keywords"), ",").alias("keywords"), F.size("body_tokens").cast("long").alias("palavras"), F.sha2(context, 256).alias("contexto"))


# Catalogue

_PERIOD_NAME = "concat('boletim-', CASE doc_id % 5 WHEN 0 THEN 'set-2026' WHEN 1 THEN 'T2 ' WHEN 2 THEN '3º trimestre ' WHEN 3 THEN 'março 2024' ELSE '' END, ' x')"


@query(
    f"""+ n AS (SELECT doc_id, concat({_PERIOD_NAME}, ' titulo') AS s FROM documents),
p AS (SELECT doc_id, regexp_extract(lower(s), '(?:^|[^\\p{{L}}\\p{{N}}_])(jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez)[a-z]*[\\s/-]*(20[0-9][0-9])(?:[^\\p{{L}}\\p{{N}}_]|$)', ['m', 'y']) AS month, regexp_extract(lower(s), '([1-4])\\s*[ºo]?\\s*tri|\\bt([1-4])\\b', ['a', 'b']) AS q FROM n)
SELECT doc_id, CASE WHEN month.m <> '' THEN month.y || '-' || lpad((list_position(['jan', 'fev', 'mar', 'abr', 'mai', 'jun', 'jul', 'ago', 'set', 'out', 'nov', 'dez'], month.m))::VARCHAR, 2, '0')
  WHEN q.a || q.b <> '' THEN '2020-Q' || q.a || q.b ELSE '2020' END AS periodo FROM p"""
)
def ref_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period that each document's name refers to."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PERIOD_NAME} AS nome")
    return rows.select("doc_id", C.reference_period(F.col("nome"), F.lit("titulo"), F.lit(2020)).alias("periodo"))


#: Texts with words of the vocabularies after them, by the number of the document.
_THEMED = "concat(text, CASE doc_id % 6 WHEN 0 THEN ' Abertura de empresas ativas, empresas ativas e CNPJ; comércio varejista' WHEN 1 THEN ' construção civil e construção; turismo: hotelaria e eventos' WHEN 2 THEN ' o perfil do empreendedor e o MEI; serviços, serviços' WHEN 3 THEN ' Inovação, startup, crédito, juros; indústria industrial' WHEN 4 THEN ' pib' ELSE '' END)"


def _labels_sql(vocabulary: dict[str, list[str]], least: int, texts: str, key: str) -> str:
    """Best labels of normalised texts ``s``, by one count of each term."""
    norm = lambda t: " ".join(strip_accents(t).lower().split())
    counted = " UNION ALL ".join(f"SELECT {key}, '{label}' AS label, " + " + ".join(f"len(regexp_extract_all(s, '\\b{norm(t)}\\b'))" for t in terms) + f" AS pontos FROM {texts}" for label, terms in vocabulary.items())
    return f"SELECT {key}, coalesce(list_slice(list(label ORDER BY pontos DESC, label) FILTER (pontos >= {least}), 1, 3), []) AS labels FROM ({counted}) GROUP BY 1"


@query(
    f"""+ s AS (SELECT doc_id, {NORM.format(_THEMED)} AS s FROM documents), t AS ({_labels_sql(THEMES, 1, 's', 'doc_id')}), u AS ({_labels_sql(SECTORS, 2, 's', 'doc_id')})
SELECT doc_id, array_to_string(t.labels, ',') AS temas, array_to_string(u.labels, ',') AS setores FROM t JOIN u USING (doc_id)"""
)
def catalog_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best themes and sectors of every document."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_THEMED} AS t").select("doc_id", X.normalise(F.col("t")).alias("s"))
    found = C.dictionary_fields(rows, "s", PLACES)
    return found.select("doc_id", F.array_join("tema", ",").alias("temas"), F.array_join("setor", ",").alias("setores"))


_PLACED = "concat(text, CASE doc_id % 5 WHEN 0 THEN ' Extremo Oeste e Sul' WHEN 1 THEN ' consultoria em Itajaí' WHEN 2 THEN ' Vale do Itajaí' WHEN 3 THEN ' Balneário Camboriú, Camboriú e Lages' ELSE '' END)"
PLACES = ["Itajaí", "Lages", "Camboriú", "Balneário Camboriú"]
#: As many names as a state has municipalities: five of each stem, some within others, some with a region's name in them.
_STEMS = [a + b for b in ("dó", "ruçu", "tinga", "vaí", "quara", "mirim") for a in ("Ara", "Ita", "Pira", "Gua", "Tapa", "Uru", "Ca", "Jara", "Bo", "Sã")][:59]
MANY_PLACES = [n for s in _STEMS for n in (s, f"Balneário {s}", f"São {s} do Sul", f"Alto {s}", f"{s} d'Oeste")]
_MANY = "['" + "', '".join(n.replace("'", "''") for n in MANY_PLACES) + "']"


def _region_sql(s: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({s}, '\\b{strip_accents(r).lower()}\\b') THEN '{r}'" for r in sorted(REGIONS, key=len, reverse=True)) + " END"


def _places_sql(s: str, places: list[str]) -> str:
    blank = s
    for r in REGIONS:
        blank = f"regexp_replace({blank}, '\\b{strip_accents(r).lower()}\\b', ' ', 'g')"
    found = "[" + ", ".join(f"CASE WHEN regexp_matches({blank}, '\\b{strip_accents(p).lower()}\\b') THEN '{p}' END" for p in places) + "]"
    return f"list_slice(list_filter({found}, lambda x: x IS NOT NULL AND len(list_filter({found}, lambda y: y <> x AND contains(lower(strip_accents(y)), lower(strip_accents(x))))) = 0), 1, 5)"


@query(f"SELECT doc_id, {_region_sql('s')} AS regional, array_to_string({_places_sql('s', PLACES)}, ',') AS municipio FROM (SELECT doc_id, {NORM.format(_PLACED)} AS s FROM documents)")
def catalog_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region and places that each document names."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PLACED} AS t").select("doc_id", X.normalise(F.col("t")).alias("s"))
    return rows.select("doc_id", C.catalog_region(F.col("s")).alias("regional"), F.array_join(C.catalog_places(F.col("s"), PLACES), ",").alias("municipio"))


def _many_sql() -> str:
    """All places of a text ``s`` with regions blanked, then those within no other one."""
    pattern = lambda p: strip_accents(p).lower().replace("'", "''")
    blank = "s"
    for r in REGIONS:
        blank = f"regexp_replace({blank}, '\\b{strip_accents(r).lower()}\\b', ' ', 'g')"
    found = ", ".join(f"CASE WHEN contains(b, '{pattern(p)}') AND regexp_matches(b, '\\b{pattern(p)}\\b') THEN '{p.replace(chr(39), chr(39) * 2)}' END" for p in MANY_PLACES)
    return f"""+ texts AS (SELECT doc_id, {NORM.format(f"concat(text, ' ', {_MANY}[1 + doc_id * 7 % 295], ', ', {_MANY}[1 + (doc_id * 3 + 1) % 295], CASE WHEN doc_id % 3 = 0 THEN ' na Serra; Extremo Oeste' ELSE '' END, ' e ', {_MANY}[1 + doc_id % 295])")} AS s FROM documents),
bare AS (SELECT doc_id, s, {blank} AS b FROM texts), f AS (SELECT doc_id, s, list_filter([{found}], lambda x: x IS NOT NULL) AS f FROM bare)
SELECT doc_id, {_region_sql('s')} AS regional, array_to_string(list_slice(list_filter(f, lambda x: len(list_filter(f, lambda y: y <> x AND contains(lower(strip_accents(y)), lower(strip_accents(x))))) = 0), 1, 5), ',') AS municipio FROM f"""


@query(_many_sql())
def catalog_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region and places of every document, by a vocabulary as long as a state's."""
    name = lambda k: F.get(F.lit(MANY_PLACES), k.cast("int"))
    n = F.col("doc_id")
    text = F.concat("text", F.lit(" "), name(n * 7 % 295), F.lit(", "), name((n * 3 + 1) % 295), F.when(n % 3 == 0, " na Serra; Extremo Oeste").otherwise(""), F.lit(" e "), name(n % 295))
    rows = table(spark, sf_dir, "documents").select("doc_id", X.normalise(text).alias("s"))
    found = C.dictionary_fields(rows, "s", MANY_PLACES)
    return found.select("doc_id", "regional", F.array_join("municipio", ",").alias("municipio"))


_STEM = r"regexp_extract(chave, '([^/]*)\.md$', 1)"
_HAD = r"regexp_matches(conteudo, '(?s)\A---\s*\n.*?\n---\s*\n?')"
_BODY = r"regexp_replace(conteudo, '(?s)\A---\s*\n.*?\n---\s*\n?', '')"
_YEARS = r"list_max(list_filter([x::INTEGER FOR x IN regexp_extract_all({0}, '\b(?:19|20)\d\d\b')], lambda y: y BETWEEN 1990 AND 2100))"
_FIELDS = f"""+ b AS (SELECT doc_id, chave, conteudo, {_STEM} AS nome, {_HAD} AS had, {_BODY} AS corpo, lang FROM studies),
h AS (SELECT *, trim(regexp_extract(corpo, '(?m)^[ \\t]*#[ \\t]+(.+?)[ \\t]*#*[ \\t]*$', 1)) AS h1, trim(regexp_replace(nome, '[-_]', ' ', 'g')) AS limpo FROM b),
f AS (SELECT *, CASE WHEN h1 <> '' THEN h1 ELSE upper(limpo[1]) || lower(limpo[2:]) END AS title FROM h),
g AS (SELECT *, {NORM.format("concat_ws(' ', nome, title, corpo)")} AS s, coalesce({_YEARS.format('nome')}, {_YEARS.format('title')}, {_YEARS.format('corpo')}) AS ano FROM f),
t AS ({_labels_sql(THEMES, 1, 'g', 'chave')}), u AS ({_labels_sql(SECTORS, 2, 'g', 'chave')}),
c AS (SELECT chave, conteudo, corpo, had, lang, title, ano, t.labels AS tema, u.labels AS setor, {_places_sql('s', ["Itajaí", "Lages"])} AS municipio, {_region_sql('s')} AS regiao,
  CASE WHEN q.a || q.b <> '' AND ano IS NOT NULL THEN ano || '-Q' || q.a || q.b ELSE ano::VARCHAR END AS data_referencia
  FROM (SELECT *, regexp_extract(lower(concat_ws(' ', nome, title)), '([1-4])\\s*[ºo]?\\s*tri|\\bt([1-4])\\b', ['a', 'b']) AS q FROM g) JOIN t USING (chave) JOIN u USING (chave))
"""


@query(
    _FIELDS
    + """SELECT chave, title, ano, array_to_string(CASE WHEN len(tema) = 0 THEN [lang] ELSE tema END, ',') AS tema, array_to_string(setor, ',') AS setor, array_to_string(municipio, ',') AS municipio, coalesce(regiao, 'Santa Catarina') AS regional,
  'fonte própria' AS fonte, data_referencia, concat('{"title":"heuristica","ano":"', CASE WHEN ano IS NULL THEN 'ausente' ELSE 'heuristica' END, '","tema":"', CASE WHEN len(tema) = 0 THEN 'llm' ELSE 'heuristica' END,
    '","setor":"', CASE WHEN len(setor) = 0 THEN 'ausente' ELSE 'heuristica' END, '","municipio":"', CASE WHEN len(municipio) = 0 THEN 'ausente' ELSE 'heuristica' END, '","regional":"', CASE WHEN regiao IS NULL THEN 'padrao' ELSE 'heuristica' END,
    '","fonte":"heuristica","data_referencia":"', CASE WHEN data_referencia IS NULL THEN 'ausente' ELSE 'heuristica' END, '"}') AS origem_campos,
  CASE WHEN ano IS NULL THEN 'Ano não identificado; informe manualmente.' ELSE '' END AS avisos, CASE WHEN had THEN 'ja_possui' ELSE 'pronto' END AS status FROM c"""
)
def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue fields of every document, from whole texts; themes that these don't tell come from a second table."""
    more = table(spark, sf_dir, "documents").selectExpr(f"{KEY} AS chave", "array(lang) AS tema")
    found = C.catalog_fields(documents(spark, sf_dir), "fonte própria", ["Itajaí", "Lages"], more)
    return found.withColumns({"origem_campos": F.to_json("origem_campos")} | {c: F.array_join(c, ",") for c in ("tema", "setor", "municipio", "avisos")})


_RENDERED = (
    _FIELDS
    + r"""SELECT chave, sha256(CASE WHEN had THEN conteudo ELSE concat('---', chr(10), 'title: ', title, chr(10), CASE WHEN ano IS NOT NULL THEN concat('ano: ', ano, chr(10)) ELSE '' END,
  CASE len(tema) WHEN 0 THEN '' WHEN 1 THEN concat('tema: ', tema[1], chr(10)) ELSE concat('tema:', chr(10), '- ', array_to_string(tema, chr(10) || '- '), chr(10)) END,
  CASE len(setor) WHEN 0 THEN '' WHEN 1 THEN concat('setor: ', setor[1], chr(10)) ELSE concat('setor:', chr(10), '- ', array_to_string(setor, chr(10) || '- '), chr(10)) END,
  CASE len(municipio) WHEN 0 THEN '' WHEN 1 THEN concat('municipio: ', municipio[1], chr(10)) ELSE concat('municipio:', chr(10), '- ', array_to_string(municipio, chr(10) || '- '), chr(10)) END,
  'regional: ', coalesce(regiao, 'Santa Catarina'), chr(10), 'fonte: fonte própria', chr(10),
  CASE WHEN data_referencia IS NULL THEN '' WHEN regexp_matches(data_referencia, '^\d+$') THEN concat('data_referencia: ''', data_referencia, '''', chr(10)) ELSE concat('data_referencia: ', data_referencia, chr(10)) END,
  '---', chr(10), chr(10), regexp_replace(corpo, '^\n+', '')) END) AS resumo FROM c"""
)


@query(_RENDERED)
def header_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a header of its catalogue fields."""
    docs = documents(spark, sf_dir)
    return C.render_headers(docs, C.catalog_fields(docs, "fonte própria", ["Itajaí", "Lages"])).select("chave", F.sha2("conteudo", 256).alias("resumo"))


# Validation


def _rules_sql(name: str, source: str) -> str:
    """Header rules of texts ``t`` of a table: ``chave, t, had, ausentes, avisos, status``."""
    field = lambda f: rf"nullif(trim(regexp_extract(bloco, '(?m)^{f}:[ \t]*(.*)$', 1)), '')"
    known = ", ".join(f"'{r.lower()}'" for r in [*REGIONS, *STATE_WIDE])
    return rf"""{name}_b AS (SELECT *, regexp_matches(t, '(?s)\A---\s*\n.*?\n---\s*\n?') AS had, regexp_extract(t, '(?s)\A---\s*\n(.*?)\n---\s*\n?(.*)\z', 1) AS bloco, regexp_replace(t, '(?s)\A---\s*\n.*?\n---\s*\n?', '') AS corpo FROM {source}),
{name}_f AS (SELECT *, coalesce({field('title')}, {field('titulo')}) AS titulo, coalesce({field('ano')}, {field('year')}) AS ano, {field('tema')} AS tema, {field('regional')} AS regional, {field('fonte')} AS fonte, {field('data_referencia')} AS data FROM {name}_b),
{name}_w AS (SELECT *, list_filter([CASE WHEN titulo IS NULL THEN 'title' END, CASE WHEN ano IS NULL THEN 'ano' END], lambda x: x IS NOT NULL) AS faltam,
    list_filter([CASE WHEN tema IS NULL THEN 'Campo recomendado ausente: tema' END, CASE WHEN regional IS NULL THEN 'Campo recomendado ausente: regional' END,
      CASE WHEN fonte IS NULL THEN 'Campo recomendado ausente: fonte' END, CASE WHEN data IS NULL THEN 'Campo recomendado ausente: data_referencia' END,
      CASE WHEN try_cast(ano AS INTEGER) IS NULL AND ano IS NOT NULL THEN 'Ano não numérico: ' || chr(39) || ano || chr(39) END, CASE WHEN try_cast(ano AS INTEGER) NOT BETWEEN 1990 AND 2100 THEN 'Ano fora de faixa plausível: ' || ano END,
      CASE WHEN lower(regional) NOT IN ({known}) THEN 'Regional ' || chr(39) || regional || chr(39) || ' não está entre as oficiais nem indica abrangência estadual.' END, CASE WHEN starts_with(t, chr(65279)) THEN 'Arquivo contém BOM; prefira UTF-8 sem BOM.' END,
      CASE WHEN NOT regexp_matches(corpo, '\S') THEN 'Documento sem conteúdo após o frontmatter.' END,
      CASE WHEN NOT regexp_matches(corpo, '(?m)^[ \t]*#{{1,6}}[ \t]+\S') THEN 'Nenhum heading (#) no corpo: o chunking recursivo perde a hierarquia de seções.' END], lambda x: x IS NOT NULL) AS ditos FROM {name}_f),
{name} AS (SELECT chave, t, had, CASE WHEN had THEN array_to_string(faltam, ',') ELSE '' END AS ausentes, CASE WHEN had THEN array_to_string(ditos, '|') ELSE '' END AS avisos,
    CASE WHEN NOT had THEN 'sem_frontmatter' WHEN len(faltam) > 0 THEN 'erro' WHEN len(ditos) > 0 THEN 'aviso' ELSE 'ok' END AS status FROM {name}_w)"""


_RULES = "+ given AS (SELECT chave, conteudo AS t FROM studies), " + _rules_sql("rules", "given")


@query(_RULES + " SELECT chave AS arquivo, status, ausentes, avisos FROM rules")
def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every document's header."""
    found = validate.diagnose(documents(spark, sf_dir))
    return found.select("arquivo", "status", F.array_join("campos_ausentes", ",").alias("ausentes"), F.array_join("avisos", "|").alias("avisos"))


@query(
    rf"""SELECT chave AS arquivo, CASE WHEN starts_with(conteudo, chr(65279)) THEN 'Arquivo começa com BOM antes do ''---''. Salve como UTF-8 sem BOM.'
  WHEN regexp_matches(conteudo, '\A\s+---') THEN 'Há linha em branco ou espaço antes do ''---''. O bloco deve começar no primeiro caractere do arquivo.'
  WHEN starts_with(conteudo, '--') AND NOT starts_with(conteudo, '---') THEN concat('Delimitador incorreto: ''', trim(regexp_extract(conteudo, '\A([^\n\r]*)', 1)), '''. Use exatamente ''---''.')
  WHEN starts_with(conteudo, '---') AND NOT contains(substr(conteudo, 4), chr(10) || '---') THEN 'Bloco não foi fechado com ''---''. Verifique se o fechamento usa ''---'' e não ''...''.'
  WHEN NOT starts_with(conteudo, '---') THEN 'Arquivo não possui frontmatter.' ELSE 'Frontmatter malformado (delimitadores não reconhecidos).' END AS erro FROM studies WHERE NOT {_HAD}"""
)
def header_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why documents have no readable header."""
    docs = documents(spark, sf_dir).where(~headers.has_header(F.col("conteudo")))
    return docs.select(F.col("chave").alias("arquivo"), validate.missing_header_reason(F.col("conteudo")).alias("erro"))


@query(
    rf"""+ bare AS (SELECT chave, conteudo, NOT {_HAD} AND regexp_matches(regexp_replace(conteudo, '\A\s+', ''), '(?s)\A---\s*\n.*?\n---\s*\n?') AS corrigido FROM studies),
given AS (SELECT chave, CASE WHEN corrigido THEN regexp_replace(conteudo, '\A\s+', '') ELSE conteudo END AS t FROM bare), """
    + _rules_sql("rules", "given")
    + " SELECT chave AS arquivo, status, corrigido, sha256(t) AS resumo FROM rules JOIN bare USING (chave)"
)
def header_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis of every document after repair."""
    return validate.diagnose(documents(spark, sf_dir), repair=True).select("arquivo", "status", "corrigido", F.sha2("conteudo", 256).alias("resumo"))


# studies whose headers a parser refuses, each in one of seven ways, or not
_FAULTY = """concat('---', chr(10), CASE doc_id % 8 WHEN 0 THEN concat('title: Panorama: ', source, chr(10), 'ano: 2020') WHEN 1 THEN concat('title: X', chr(10), 'lista:', chr(10), chr(9), '- ', lang)
  WHEN 2 THEN concat('title: "Panorama ', doc_id, chr(10), 'ano: 2020') WHEN 3 THEN concat('fonte: @', source, chr(10), 'ano: 2020') WHEN 4 THEN concat('title: A', chr(10), 'sem dois pontos', chr(10), 'tema: ', lang)
  WHEN 5 THEN concat('- ', lang, chr(10), '- b') WHEN 6 THEN concat('title: ', source, chr(10), 'ano: 2020') ELSE concat('title: *', source) END, chr(10), '---', chr(10), text)"""
_CAUSE = """CASE doc_id % 8 WHEN 0 THEN 'Valor contém '':'' sem aspas. Envolva em aspas duplas, ex.: title: "Panorama: abertura de empresas" | linha 1: ''title: Panorama: ' || source || chr(39)
  WHEN 1 THEN 'Indentação com TAB. YAML aceita apenas espaços. | linha 3: ''- ' || lang || chr(39) WHEN 2 THEN 'Aspas abertas e não fechadas. | linha 2: ''ano: 2020'''
  WHEN 3 THEN 'while scanning for the next token found character ''@'' that cannot start any token | linha 1: ''fonte: @' || source || chr(39)
  WHEN 4 THEN 'Linha sem '':'' ou valor iniciando com caractere reservado (@, `, %, *, &). Use aspas. | linha 3: ''tema: ' || lang || chr(39)
  WHEN 5 THEN 'O bloco não é um mapa de chave/valor (tipo: list).' WHEN 7 THEN 'found undefined alias ''' || source || ''' found undefined alias ''' || source || ''' | linha 1: ''title: *' || source || chr(39) END"""


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(f"{KEY} AS chave", f"{_FAULTY} AS conteudo")


@query(f"SELECT {KEY} AS arquivo, CASE WHEN doc_id % 8 = 6 THEN 'aviso' ELSE 'yaml_invalido' END AS status, {_CAUSE} AS erro, CASE WHEN doc_id % 8 = 6 THEN 4 ELSE 2 END AS severidade FROM documents")
def yaml_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the headers of documents can't be read, with how bad that is."""
    found = validate.diagnose(_faulty(spark, sf_dir))
    return found.select("arquivo", "status", "erro", validate.severity(F.col("status")).alias("severidade"))


@query(
    f"""SELECT {KEY} AS arquivo, CASE doc_id % 8 WHEN 0 THEN 'aviso' WHEN 1 THEN 'erro' WHEN 6 THEN 'aviso' ELSE 'yaml_invalido' END AS status, doc_id % 8 < 2 AS corrigido,
  sha256(CASE doc_id % 8 WHEN 0 THEN replace({_FAULTY}, 'Panorama: ' || source, '"Panorama: ' || source || '"') WHEN 1 THEN replace({_FAULTY}, chr(9) || '- ' || lang, '  - ' || lang) ELSE {_FAULTY} END) AS resumo FROM documents"""
)
def yaml_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that can't be read, after repair."""
    return validate.diagnose(_faulty(spark, sf_dir), repair=True).select("arquivo", "status", "corrigido", F.sha2("conteudo", 256).alias("resumo"))


@query(_RULES + " SELECT count(*) AS documentos, count(*) FILTER (avisos <> '') AS com_avisos, 0::BIGINT AS corrigidos, count(*) FILTER (status IN ('sem_frontmatter', 'erro')) AS bloqueantes FROM rules")
def diagnosis_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a diagnosis."""
    return validate.diagnosis_totals(validate.diagnose(documents(spark, sf_dir)))


# Folders of documents, written from the tables and read back

_PLACE = """CASE doc_id % 9 WHEN 0 THEN concat('notas/', source, '/n', doc_id, '.md') WHEN 1 THEN concat('estudos/', lang, '/', doc_id, '.MD') WHEN 2 THEN concat('/estudos/', doc_id, '.Markdown')
  WHEN 3 THEN concat('estudos/', doc_id, '.txt') WHEN 4 THEN concat('notas/.oculta/', doc_id, '.md') WHEN 5 THEN concat('a b', chr(92), 'é%20', doc_id, '.md') ELSE concat(source, '/', lang, '/d', doc_id, '.md') END"""
_BYTES = "CASE doc_id % 4 WHEN 1 THEN concat(X'EFBBBF', encode(text, 'UTF-8')) WHEN 2 THEN concat(encode(text, 'UTF-8'), X'FF') ELSE encode(text, 'UTF-8') END"
_FOLDER = rf"""+ arquivos AS (SELECT doc_id, regexp_replace(replace({_PLACE}, chr(92), '/'), '^/+', '') AS k, doc_id % 9 AS kind,
  CASE doc_id % 4 WHEN 1 THEN '\xEF\xBB\xBF'::BLOB || encode(text) WHEN 2 THEN encode(text) || '\xFF'::BLOB ELSE encode(text) END AS b, CASE WHEN doc_id % 4 = 2 THEN text || chr(65533) ELSE text END AS t FROM documents) """


def _folder(spark: SparkSession, sf_dir: str) -> str:
    root = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    write_documents(table(spark, sf_dir, "documents").selectExpr(f"{_PLACE} AS chave", f"{_BYTES} AS conteudo"), root)
    return root


@query(_FOLDER + "SELECT regexp_replace(k, '^notas/', '') AS chave, 'https://exemplo.test/base/notas/' || regexp_replace(k, '^notas/', '') AS origem_uri, true AS com_etag, octet_length(b) AS tamanho FROM arquivos WHERE kind NOT IN (3, 4)")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown files of a folder, without their contents."""
    found = S.list_documents(spark, _folder(spark, sf_dir), base="https://exemplo.test/base/", prefix="/notas/", empty=True)
    return found.select("chave", "origem_uri", F.col("etag").rlike("^mtime-[0-9]+$").alias("com_etag"), "tamanho")


@query(_FOLDER + "SELECT k AS chave, sha256(t) AS conteudo_hash, sha256(b) AS hash_bruto, length(t) AS tamanho FROM arquivos WHERE kind NOT IN (3, 4)")
def folder_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of the Markdown files of a folder, with byte order marks and bad bytes."""
    return S.read_documents(spark, _folder(spark, sf_dir), empty=True).select("chave", "conteudo_hash", "hash_bruto", F.length("conteudo").alias("tamanho"))


@query(_FOLDER + "SELECT k AS path, sha256(b) AS resumo FROM arquivos WHERE kind NOT IN (1, 2, 3, 4) AND doc_id % 4 <> 2")
def folder_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule notes of a folder: no hidden paths, none that can't be decoded."""
    return S.read_notes(spark, _folder(spark, sf_dir), empty=True).select("path", F.sha2("conteudo", 256).alias("resumo"))


@query(_RENDERED)
def folder_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headers of their catalogue fields, written as files and read back."""
    docs, root = documents(spark, sf_dir), f"{shared_dir(spark)}/rendered-{uuid.uuid4().hex}"
    write_documents(C.render_headers(docs, C.catalog_fields(docs, "fonte própria", ["Itajaí", "Lages"])), root)
    return S.read_documents(spark, root).select("chave", F.col("conteudo_hash").alias("resumo"))


# Files that Spark writes from the tables, and reads back as the jobs' sources


def _written(frame: DataFrame, name: str, kind: str) -> str:
    """A new folder below the shared one, with a frame written under a name as CSV, JSON or Parquet."""
    folder = f"{shared_dir(frame.sparkSession)}/sources-{uuid.uuid4().hex}"
    frame.write.option("header", True).option("nullValue", "").format(kind).save(f"{folder}/{name}.{kind}")
    return folder


@query("SELECT o_orderkey::VARCHAR AS nr_cnpj, c_nationkey::VARCHAR AS cd_municipio, o_orderpriority AS ds_porte FROM orders JOIN customer ON o_custkey = c_custkey")
def registry_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as CSV with a header of other names and codes that end in ``.0``, read by position."""
    of = {"nr_cnpj": "o_orderkey", "cd_municipio": "concat(c_nationkey, '.0')", "ds_porte": "o_orderpriority"}
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    folder = _written(rows.selectExpr(*[f"{of.get(c, 'o_orderstatus')} AS coluna_{n}" for n, c in enumerate(R.REGISTRY_COLUMNS)]), "registro", "csv")
    return R.read_registry(spark, f"{folder}/registro.csv").select("nr_cnpj", "cd_municipio", "ds_porte")


@query("SELECT n_nationkey::VARCHAR AS cod_ibge, r_name AS regional, n_name AS territorio FROM nation JOIN region ON n_regionkey = r_regionkey")
def region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region table as CSV under its own names."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folder = _written(rows.selectExpr("concat(n_nationkey, '.0') AS codigo", "r_name AS `Gerência`", "n_name AS `Território`"), "regioes", "csv")
    return R.read_regions(spark, f"{folder}/regioes.csv", "codigo", "Gerência", "Território")


@query("SELECT codigo_ibge, porte, sum(total)::BIGINT AS total FROM dataset WHERE porte IS NOT NULL GROUP BY 1, 2")
def dataset_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset as Parquet by name, its totals read as numbers."""
    folder = _written(dataset(spark, sf_dir).withColumn("total", F.col("total").cast("string")), "empresas", "parquet")
    read = I.whole_totals(R.read_dataset(spark, folder, "empresas"))
    return read.where("porte IS NOT NULL").groupBy("codigo_ibge", "porte").agg(F.sum("total").alias("total"))


@query(_RULES + " SELECT status, count(*) AS quantidade FROM rules GROUP BY 1")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diagnosis report written as JSON and read back: documents per status."""
    report = validate.diagnose(documents(spark, sf_dir)).select("arquivo", "status", "erro", "campos_ausentes", "avisos", "corrigido")
    folder = _written(report, "relatorio", "json")
    return index.status_totals(spark.read.json(f"{folder}/relatorio.json"))

"""Tables of the star schema in the roles that the jobs expect; each also as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators as I


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REGISTRY = [
    "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR(20)) END AS nr_cnpj",
    "CASE WHEN o_custkey % 23 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR(20)) END AS cd_municipio",
    "concat('NAÇÃO_', c_nationkey) AS nm_municipio",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'MICROEMPREENDEDOR INDIVIDUAL' WHEN '2-HIGH' THEN 'MICRO EMPRESA' "
    "WHEN '3-MEDIUM' THEN 'EMPRESA DE PEQUENO PORTE' WHEN '5-LOW' THEN 'DEMAIS' END AS ds_porte",
    "o_orderstatus AS ds_setor",
    "c_mktsegment AS ds_segmento",
]
REGIONS = ["CAST(n_nationkey AS VARCHAR(20)) AS cod_ibge", "r_name AS regional", "concat('T', n_nationkey % 4) AS territorio"]
QUESTION = """
concat('Quantos ', CASE question_id % 5 WHEN 0 THEN 'MEIs' WHEN 1 THEN 'microempresas' WHEN 2 THEN 'negócios de pequeno porte' ELSE 'negócios' END,
  CASE question_id % 6 WHEN 0 THEN concat(' em Nação_', question_id % 27) WHEN 1 THEN ' na regional Asia' WHEN 2 THEN ' em Zubrowka' WHEN 3 THEN ' em Santa Catarina' ELSE '' END,
  CASE question_id % 7 WHEN 0 THEN ' por porte' WHEN 1 THEN ' ranking' WHEN 2 THEN ' por porte e ranking' ELSE '' END)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as companies, their customers' nations as municipalities."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(*REGISTRY)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations but one as municipalities with regional offices."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey <> 24").selectExpr(*REGIONS)


def tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tidy indicator table."""
    return I.label_indicators(I.count_by_category(I.with_regions(registry(spark, sf_dir), regions(spark, sf_dir))))


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by size, under the names of questions."""
    return I.whole_totals(I.query_dataset(tidy(spark, sf_dir)))


def sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset with the source of each row."""
    return dataset(spark, sf_dir).withColumn("fonte", F.concat(F.lit("registro "), F.length("municipio")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns of conversations as ``question_id, text``."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("conv_id * 100 + turn AS question_id", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about companies for each user's turn."""
    return turns(spark, sf_dir).select("question_id").selectExpr("question_id", f"{QUESTION} AS text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a header, or a faulty one, by the rest of their number: ``chave, conteudo``."""
    return table(spark, sf_dir, "documents").selectExpr(f"{KEY} AS chave", f"{STUDY} AS conteudo")


KEY = "concat('estudos/', source, '/panorama_', CASE WHEN doc_id % 3 = 0 THEN concat(2000 + doc_id % 30, '_') ELSE '' END, doc_id, '.md')"
STUDY = r"""
concat(CASE doc_id % 6
  WHEN 0 THEN concat('---', chr(10), 'title: Panorama ', doc_id, chr(10), 'ano: ', 1985 + doc_id % 50, chr(10), 'regional: Oeste', chr(10), '---', chr(10))
  WHEN 1 THEN concat('---', chr(10), 'titulo: Perfil ', doc_id, chr(10), 'fonte: ', source, chr(10), 'tema: emprego', chr(10), '---', chr(10), '# Perfil', chr(10))
  WHEN 2 THEN concat('---', chr(10), 'title: Aberto', chr(10))
  WHEN 3 THEN concat(chr(10), '---', chr(10), 'ano: 2020', chr(10), '---', chr(10))
  WHEN 4 THEN concat('# Boletim ', doc_id, ' de 2021', chr(10))
  ELSE '' END, text)"""

SQL = f"""
WITH registry AS (SELECT {', '.join(REGISTRY)} FROM orders JOIN customer ON o_custkey = c_custkey),
regions AS (SELECT {', '.join(REGIONS)} FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24),
joined AS (SELECT registry.*, regional, territorio FROM registry LEFT JOIN regions ON cd_municipio = cod_ibge),
counts AS (
  SELECT cd_municipio AS cod_ibge, nm_municipio AS "Municipio", territorio AS "Territorio", regional AS "Regional", ds_porte AS categoria,
    count(nr_cnpj) AS "contagem por cnpj", 'Porte' AS tipo_categoria, 'cnpjPorte' AS "nmIndicador" FROM joined GROUP BY 1, 2, 3, 4, 5
  UNION ALL SELECT cd_municipio, nm_municipio, territorio, regional, ds_setor, count(nr_cnpj), 'Setor', 'cnpjSetor' FROM joined GROUP BY 1, 2, 3, 4, 5
  UNION ALL SELECT cd_municipio, nm_municipio, territorio, regional, ds_segmento, count(nr_cnpj), 'Segmento', 'cnpjSegmento' FROM joined GROUP BY 1, 2, 3, 4, 5),
tidy AS (
  SELECT cod_ibge, strip_accents("Municipio") AS "Municipio", "Territorio", "Regional",
    CASE categoria WHEN 'EMPRESA DE PEQUENO PORTE' THEN 'EPP' WHEN 'MICRO EMPRESA' THEN 'ME' WHEN 'MICROEMPREENDEDOR INDIVIDUAL' THEN 'MEI' ELSE categoria END AS categoria,
    "contagem por cnpj", tipo_categoria, "nmIndicador", 'quantidade_cnpjs' AS "métrica", 'empresas' AS unidade, 'set-2026' AS periodo,
    'integer' AS "tipoIndicador", 'quantidade de empresas por categoria' AS definicao FROM counts),
dataset AS (
  SELECT cod_ibge AS codigo_ibge, "Municipio" AS municipio, "Regional" AS regional, categoria AS porte, periodo AS data_referencia,
    "contagem por cnpj" AS total FROM tidy WHERE tipo_categoria = 'Porte'),
turns AS (SELECT conv_id * 100 + turn AS question_id, text FROM conversations WHERE role = 'user'),
questions AS (SELECT question_id, {QUESTION} AS text FROM turns),
sized AS (
  SELECT question_id, text, lower(strip_accents(text)) AS norm,
    CASE WHEN regexp_matches(lower(strip_accents(text)), '\\bmeis?\\b|\\bmicroempreendedor(es)?\\b') THEN 'MEI'
      WHEN regexp_matches(lower(strip_accents(text)), '\\bme\\b|\\bmicroempresas?\\b') THEN 'ME'
      WHEN regexp_matches(lower(strip_accents(text)), '\\bepp\\b|\\bpequeno porte\\b') THEN 'EPP' END AS porte FROM questions),
studies AS (SELECT doc_id, {KEY} AS chave, {STUDY} AS conteudo, text, source, lang FROM documents)
"""

"""Company registry, region table and prepared datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import municipality_code

#: Names given to the registry's columns by position, whatever its header says.
REGISTRY_COLUMNS = (
    "nr_cnpj nr_cnpj_raiz ds_tipo_estabelecimento dt_cadastro ds_situacao_cadastral ds_porte ds_natureza_juridica dt_situacao_cadastral "
    "sg_uf nm_uf cd_municipio nm_municipio cd_cnae_num cd_cnae cd_cnae_completa ds_cnae ds_setor ds_segmento ds_subsegmento"
).split()

DATASET_SCHEMA = "codigo_ibge string, municipio string, regional string, porte string, data_referencia string, total string, fonte string"


def read_registry(spark: SparkSession, path: str, columns: list[str] = REGISTRY_COLUMNS) -> DataFrame:
    """The registry's CSV: columns named by position, all text, blank municipality codes as empty text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return rows.withColumn("cd_municipio", F.coalesce(municipality_code(F.col("cd_municipio")), F.lit("")))


def read_regions(spark: SparkSession, path: str, code: str, regional: str, territory: str) -> DataFrame:
    """Municipality to regional office and territory, from CSV or Parquet, under our names."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    return rows.select(municipality_code(F.col(f"`{code}`")).alias("cod_ibge"), F.col(f"`{regional}`").alias("regional"), F.col(f"`{territory}`").alias("territorio"))


def read_dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A dataset by name: the first of Parquet, CSV and JSON that exists; missing ones are empty.

    Existence is asked of the folder's own file system, so remote stores work too.
    """
    jvm = spark.sparkContext._jvm
    for kind in ("parquet", "csv", "json"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{kind}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            reader = spark.read.option("header", True).option("multiLine", kind == "json")
            found = reader.format(kind).load(f"{folder}/{name}.{kind}")
            return found.withColumn("codigo_ibge", F.col("codigo_ibge").cast("string"))
    return spark.createDataFrame([], DATASET_SCHEMA)

"""Company counts per place and category, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_name
from ..functions.vocab import SIZE_CODES

#: Category column, its type and its indicator.
CATEGORIES = [("ds_porte", "Porte", "cnpjPorte"), ("ds_setor", "Setor", "cnpjSetor"), ("ds_segmento", "Segmento", "cnpjSegmento")]

#: Constant columns of the indicator table.
LABELS = {
    "métrica": "quantidade_cnpjs",
    "unidade": "empresas",
    "periodo": "set-2026",
    "tipoIndicador": "integer",
    "definicao": "quantidade de empresas por categoria",
}

_PLACE = ["cod_ibge", "Municipio", "Territorio", "Regional"]


def with_regions(registry: DataFrame, regions: DataFrame) -> DataFrame:
    """Each registry row with its regional office and territory; without a match these are null.

    ``regions``: ``cod_ibge, regional, territorio``, one row per municipality.  Spark
    broadcasts it by its measured size.  A blank code matches nothing; a repeated code
    multiplies rows, see :func:`repeated_codes`.
    """
    region = regions.select(F.col("cod_ibge").alias("_cod"), "regional", "territorio")
    return registry.join(region, F.col("cd_municipio") == F.col("_cod"), "left").drop("_cod")


def repeated_codes(regions: DataFrame) -> DataFrame:
    """Codes that stand more than once in the region table."""
    return regions.groupBy("cod_ibge").count().where("count > 1").select("cod_ibge", F.col("count").alias("linhas"))


def count_by_category(joined: DataFrame, categories: list[tuple[str, str, str]] = CATEGORIES) -> DataFrame:
    """Registry numbers (not distinct) per place and category, one stacked row set per category type.

    Null places and categories keep rows of their own.  Rows are aggregated once, by place
    and all category columns; only that small table is unpivoted and summed, so the registry
    is scanned and shuffled once for all types, after partial counts in each task.
    """
    place = {"cod_ibge": "cd_municipio", "Municipio": "nm_municipio", "Territorio": "territorio", "Regional": "regional"}
    columns = [c for c, _, _ in categories]
    finest = joined.groupBy(*[F.col(v).alias(k) for k, v in place.items()], *columns).agg(F.count("nr_cnpj").alias("_n"))
    tall = finest.unpivot([*_PLACE, "_n"], columns, "_column", "categoria")
    counted = tall.groupBy(*_PLACE, "categoria", "_column").agg(F.sum("_n").alias("contagem por cnpj"))
    kind = lambda at: F.create_map(*[F.lit(x) for c in categories for x in (c[0], c[at])])[F.col("_column")]
    return counted.select(*_PLACE, "categoria", "contagem por cnpj", kind(1).alias("tipo_categoria"), kind(2).alias("nmIndicador"))


def label_indicators(counts: DataFrame, labels: dict[str, str] = LABELS, codes: dict[str, str] = SIZE_CODES) -> DataFrame:
    """The tidy table: constant columns, short size codes, municipality names in ASCII (rows are not merged again)."""
    return counts.withColumns({k: F.lit(v) for k, v in labels.items()}).replace(codes, subset=["categoria"]).withColumn("Municipio", ascii_name(F.col("Municipio")))


def query_dataset(tidy: DataFrame) -> DataFrame:
    """The size indicator under the names that questions use."""
    return tidy.where("tipo_categoria = 'Porte'").select(
        F.col("cod_ibge").alias("codigo_ibge"),
        F.col("Municipio").alias("municipio"),
        F.col("Regional").alias("regional"),
        F.col("categoria").alias("porte"),
        F.col("periodo").alias("data_referencia"),
        F.col("contagem por cnpj").alias("total"),
    )


def whole_totals(dataset: DataFrame) -> DataFrame:
    """Rows whose total is a number, cut to whole."""
    return dataset.withColumn("total", F.expr("try_cast(total AS DOUBLE)")).where(F.col("total").isNotNull()).withColumn("total", F.col("total").cast("long"))


def scoped(dataset: DataFrame, municipality: str | None = None, regional: str | None = None, size: str | None = None) -> DataFrame:
    """The slice of a municipality, else of a regional office, else of all; of one size if given."""
    if municipality:
        dataset = dataset.where(F.col("municipio") == municipality)
    elif regional:
        dataset = dataset.where(F.col("regional") == regional)
    return dataset.where(F.col("porte") == size) if size else dataset


def slice_total(dataset: DataFrame) -> DataFrame:
    """One row: total, rows, municipalities and sorted reference dates of a slice."""
    dates = F.array_join(F.array_sort(F.collect_set("data_referencia")), ", ")
    return dataset.agg(F.sum("total").alias("valor"), F.count(F.lit(1)).alias("linhas"), F.countDistinct("municipio").alias("municipios"), dates.alias("data_referencia"))


def size_breakdown(dataset: DataFrame) -> DataFrame:
    """Total and share per size, largest first; rows without a size don't count."""
    sums = dataset.where(F.col("porte").isNotNull()).groupBy("porte").agg(F.sum("total").alias("total"))
    whole = F.sum("total").over(Window.partitionBy(F.lit(1)))
    return sums.withColumn("participacao", F.col("total") / F.when(whole == 0, 1).otherwise(whole)).orderBy(F.desc("total"), "porte")


def place_ranking(dataset: DataFrame, limit: int = 10, size: str | None = None, regional: str | None = None) -> DataFrame:
    """The municipalities of highest total, numbered; ties by name.  Rows without a municipality or regional office don't count."""
    kept = scoped(dataset, regional=regional, size=size).where(F.col("municipio").isNotNull() & F.col("regional").isNotNull())
    top = kept.groupBy("municipio", "regional").agg(F.sum("total").alias("total")).orderBy(F.desc("total"), "municipio", "regional").limit(limit)
    return top.withColumn("posicao", F.row_number().over(Window.orderBy(F.desc("total"), "municipio", "regional")))

"""Document headers: a YAML block between ``---`` lines, and what is read from it.

Splitting is a column expression; YAML itself is read by one vectorised helper.
"""

from __future__ import annotations

import json
import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

_BLOCK = r"(?s)(?U)\A---\s*\n(.*?)\n---\s*\n?(.*)\z"
_YEAR = r"(?U)\b(?:19|20)\d{2}\b"
_H1 = r"(?m)^[ \t]*#[ \t]+(.+?)[ \t]*#*[ \t]*$"


def has_header(text: Column) -> Column:
    """Whether a text starts with a complete header."""
    return text.rlike(_BLOCK)


def header_block(text: Column) -> Column:
    """The header's YAML, empty without a header."""
    return F.regexp_extract(text, _BLOCK, 1)


def body(text: Column) -> Column:
    """The text after its header, or all of it."""
    return F.when(has_header(text), F.regexp_extract(text, _BLOCK, 2)).otherwise(text)


def stem(key: Column) -> Column:
    """A file's name without folder and last extension."""
    return F.regexp_replace(F.substring_index(key, "/", -1), r"(?<=.)\.[^.]*$", "")


def first_heading(text: Column) -> Column:
    """Text of the first heading of level 1, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, _H1, 1)), F.lit(""))


@F.pandas_udf(MapType(StringType(), StringType()))
def _fields(blocks: pd.Series) -> pd.Series:
    def one(block: str | None) -> dict[str, str]:
        try:
            found = yaml.safe_load(block) if block else {}
        except yaml.YAMLError:
            found = {}
        if not isinstance(found, dict):
            return {}
        return {str(k): json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (list, dict)) else str(v) for k, v in found.items() if v is not None}

    return blocks.map(one)


def parse_yaml(documents: DataFrame) -> DataFrame:
    """Add ``metadata`` to documents with ``_yaml``: a map of texts, lists as JSON; invalid or other YAML gives none.

    Only the block goes through Python.
    """
    return documents.withColumn("metadata", _fields("_yaml"))


def truthy(value: Column) -> Column:
    """A field, or null if it is empty, zero, false or an empty list or map."""
    return F.when(~value.isin("", "0", "False", "[]", "{}"), value)


def title_and_year(key: Column, text: Column, metadata: Column) -> tuple[Column, Column]:
    """Title from the header, else the first heading, else the file's name; year from the header, else that name, else the title."""
    name = stem(key)
    title = F.coalesce(truthy(metadata["title"]), truthy(metadata["titulo"]), first_heading(text), F.replace(name, F.lit("_"), F.lit(" ")))
    given = F.coalesce(truthy(metadata["ano"]), metadata["year"])
    found = F.coalesce(given, F.nullif(F.regexp_extract(name, _YEAR, 0), F.lit("")), F.nullif(F.regexp_extract(title, _YEAR, 0), F.lit("")))
    return title, found.try_cast("int")


def parse_documents(raw: DataFrame) -> DataFrame:
    """``chave, titulo, markdown, body, ano, metadata, conteudo_hash`` of documents ``chave, conteudo``."""
    split = raw.select("chave", F.col("conteudo").alias("markdown"), body(F.col("conteudo")).alias("body"), header_block(F.col("conteudo")).alias("_yaml"))
    parsed = parse_yaml(split)
    title, year = title_and_year(F.col("chave"), F.col("body"), F.col("metadata"))
    return parsed.select("chave", title.alias("titulo"), "markdown", "body", year.alias("ano"), "metadata", F.sha2("markdown", 256).alias("conteudo_hash"))

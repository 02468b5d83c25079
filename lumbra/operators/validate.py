"""Diagnosis and conservative repair of document headers."""

from __future__ import annotations

import json
import re
import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from ..functions.vocab import REGIONS, STATE_WIDE
from .headers import body, has_header, header_block, truthy

REQUIRED = {"title": "titulo", "ano": "year"}
RECOMMENDED = ["tema", "regional", "fonte", "data_referencia"]
#: From the worst to the best status.
SEVERITY = ["sem_frontmatter", "yaml_invalido", "erro", "aviso", "ok"]
BLOCKING = ["sem_frontmatter", "yaml_invalido", "erro"]

#: What the parser says, and the cause to act on; a tab may also be named or stand in the message.
TAB = "'\\t'"
CAUSES = [
    ("mapping values are not allowed", "Valor contém ':' sem aspas. Envolva em aspas duplas, ex.: title: \"Panorama: abertura de empresas\""),
    (TAB, "Indentação com TAB. YAML aceita apenas espaços."),
    ("scanning a quoted scalar", "Aspas abertas e não fechadas."),
    ("special characters are not allowed", "Caractere especial não escapado."),
    ("could not find expected ':'", "Linha sem ':' ou valor iniciando com caractere reservado (@, `, %, *, &). Use aspas."),
]
_FIELD = re.compile(r"(\s*)([A-Za-z_][\w-]*):\s+(.+)")
_SPECIAL = re.compile(r"[:@`|>{}\[\]#&*!%]")


def missing_header_reason(text: Column) -> Column:
    """Why a text has no header that can be read, the first reason that applies."""
    mark = "\ufeff"
    first = F.trim(F.regexp_extract(text, r"\A([^\n\r]*)", 1))
    return (
        F.when(text.startswith(mark), "Arquivo começa com BOM antes do '---'. Salve como UTF-8 sem BOM.")
        .when(text.rlike(r"(?U)\A\s+---"), "Há linha em branco ou espaço antes do '---'. O bloco deve começar no primeiro caractere do arquivo.")
        .when(first.startswith("--") & ~first.startswith("---"), F.concat(F.lit("Delimitador incorreto: '"), first, F.lit("'. Use exatamente '---'.")))
        .when(text.startswith("---") & ~F.substr(text, F.lit(4)).contains("\n---"), "Bloco não foi fechado com '---'. Verifique se o fechamento usa '---' e não '...'.")
        .when(~text.startswith("---"), "Arquivo não possui frontmatter.")
        .otherwise("Frontmatter malformado (delimitadores não reconhecidos).")
    )


def yaml_cause(error: yaml.YAMLError, block: str) -> str:
    """The cause of a parser's error, with the line it is in."""
    said = f"{str(error).splitlines()[0]} {getattr(error, 'problem', '') or ''}".strip()
    tab = "\t" in said or "tab" in said.lower()
    cause = next((text for sign, text in CAUSES if sign in said or (tab and sign == TAB)), said)
    lines = block.splitlines()
    mark = getattr(error, "problem_mark", None)
    return f"{cause} | linha {mark.line + 1}: {lines[mark.line].strip()!r}" if mark and mark.line < len(lines) else cause


def repaired_block(block: str) -> str | None:
    """A header with leading tabs as spaces and special values in quotes, or None if there is nothing to repair."""
    out = []
    for line in block.splitlines():
        indent = line[: len(line) - len(line.lstrip())]
        fixed = line.replace("\t", "  ") if "\t" in indent else line
        if m := _FIELD.fullmatch(fixed):
            value = m[3].strip()
            if value[:1] not in "\"'[#" and _SPECIAL.search(value[1:]):
                fixed = '{}{}: "{}"'.format(m[1], m[2], value.replace('"', '\\"'))
        out.append(fixed)
    return "\n".join(out) if out != block.splitlines() else None


def _load(block: str) -> tuple[str, str | None, dict[str, str]]:
    """State (``map``, ``outro``, ``invalido``), cause and fields of a block."""
    try:
        found = yaml.safe_load(block)
    except yaml.YAMLError as error:
        return "invalido", yaml_cause(error, block), {}
    if not isinstance(found, dict):
        return "outro", f"O bloco não é um mapa de chave/valor (tipo: {type(found).__name__}).", {}
    text = lambda v: json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (list, dict)) else str(v)
    return "map", None, {str(k): text(v) for k, v in found.items() if v is not None}


def _read(documents: DataFrame, repair: bool) -> DataFrame:
    """``chave, conteudo, corrigido, _state, _cause, metadata``: each document's header read, after repair if it helps."""
    bare = F.regexp_replace("conteudo", r"(?U)\A\x{FEFF}*\s*", "")
    rows = documents.select("chave", "conteudo")
    if repair:
        lifted = ~has_header(F.col("conteudo")) & has_header(bare)
        rows = rows.select("chave", F.when(lifted, bare).otherwise(F.col("conteudo")).alias("conteudo"), lifted.alias("corrigido"))
    else:
        rows = rows.withColumn("corrigido", F.lit(False))
    rows = rows.withColumns({"_had": has_header(F.col("conteudo")), "_yaml": header_block(F.col("conteudo")), "_body": body(F.col("conteudo"))})

    read = rows.withColumn("_r", _loaded(F.when(F.col("_had"), F.col("_yaml")), F.lit(repair)))
    mended = F.concat(F.lit("---\n"), "_r.better", F.lit("\n---\n"), "_body")
    text = F.when(F.col("_r.better").isNull(), F.col("conteudo")).otherwise(mended)
    return read.select("chave", text.alias("conteudo"), (F.col("corrigido") | F.col("_r.better").isNotNull()).alias("corrigido"), "_r.state", "_r.cause", "_r.metadata").withColumnsRenamed({"state": "_state", "cause": "_cause"})


_LOADED = StructType().add("state", StringType()).add("cause", StringType()).add("metadata", MapType(StringType(), StringType())).add("better", StringType())


@F.pandas_udf(_LOADED)
def _loaded(blocks: pd.Series, repair: pd.Series) -> pd.DataFrame:
    """Header blocks read, null ones as none; with repair, what is invalid is read again as mended, if that helps.  Only blocks go through Python."""
    out = []
    for block, mend in zip(blocks, repair, strict=True):
        state, cause, fields, better = *(_load(block) if block is not None else ("nenhum", None, {})), None
        if mend and state == "invalido" and (fixed := repaired_block(block)) is not None and (again := _load(fixed))[0] != "invalido":
            (state, cause, fields), better = again, fixed
        out.append((state, cause, fields, better))
    return pd.DataFrame(out, columns=["state", "cause", "metadata", "better"])


def field_rules(metadata: Column, text: Column, regions: list[str] = REGIONS, state: list[str] = STATE_WIDE) -> tuple[Column, Column]:
    """Missing required fields and warnings of a document with a readable header."""
    blank = lambda v: v.isNull() | v.isin("", "[]", "{}")
    missing = F.array_compact(F.array(*[F.when(blank(F.coalesce(truthy(metadata[f]), metadata[alias])), f) for f, alias in REQUIRED.items()]))
    year = F.coalesce(truthy(metadata["ano"]), metadata["year"])
    number = year.try_cast("int")
    region = F.trim(metadata["regional"])
    known = [r.lower() for r in regions + state]
    after = body(text)
    warnings = F.array_compact(
        F.array(
            *[F.when(blank(metadata[f]), f"Campo recomendado ausente: {f}") for f in RECOMMENDED],
            F.when(number.isNull() & year.isNotNull(), F.concat(F.lit("Ano não numérico: '"), year, F.lit("'"))),
            F.when(~number.between(1990, 2100), F.concat(F.lit("Ano fora de faixa plausível: "), year)),
            F.when((region != "") & ~F.lower(region).isin(known), F.concat(F.lit("Regional '"), metadata["regional"], F.lit("' não está entre as oficiais nem indica abrangência estadual."))),
            F.when(text.startswith("\ufeff"), "Arquivo contém BOM; prefira UTF-8 sem BOM."),
            F.when(~after.rlike(r"(?U)\S"), "Documento sem conteúdo após o frontmatter."),
            F.when(~after.rlike(r"(?m)^[ \t]*#{1,6}[ \t]+\S"), "Nenhum heading (#) no corpo: o chunking recursivo perde a hierarquia de seções."),
        )
    )
    return missing, warnings


def diagnose(documents: DataFrame, repair: bool = False) -> DataFrame:
    """One row per document ``chave, conteudo``: status, cause, missing fields, warnings, and whether it was repaired.

    With ``repair`` the repaired text is in ``conteudo``.  Rows are in no order: see :func:`worst_first`.
    """
    read = _read(documents, repair)
    missing, warnings = field_rules(F.col("metadata"), F.col("conteudo"))
    none = F.array().cast("array<string>")
    fine = F.col("_state") == "map"
    rows = read.withColumns({"campos_ausentes": F.when(fine, missing).otherwise(none), "avisos": F.when(fine, warnings).otherwise(none)})
    status = (
        F.when(F.col("_state") == "nenhum", "sem_frontmatter")
        .when(~fine, "yaml_invalido")
        .when(F.size("campos_ausentes") > 0, "erro")
        .when(F.size("avisos") > 0, "aviso")
        .otherwise("ok")
    )
    error = F.when(F.col("_state") == "nenhum", missing_header_reason(F.col("conteudo"))).otherwise(F.col("_cause"))
    return rows.select(F.col("chave").alias("arquivo"), status.alias("status"), error.alias("erro"), "campos_ausentes", "avisos", "corrigido", "conteudo")


def severity(status: Column) -> Column:
    """The rank of a status, 1 the worst."""
    return F.array_position(F.array(*map(F.lit, SEVERITY)), status).cast("int")


def worst_first(diagnosis: DataFrame) -> DataFrame:
    """A report's rows, the worst first, then by file.

    Texts are left out: what is sorted, and read twice to find ranges, are a few fields; give
    it a written diagnosis where reading headers again costs more than writing those fields.
    """
    return diagnosis.drop("conteudo").withColumn("severidade", severity(F.col("status"))).orderBy("severidade", "arquivo")


def diagnosis_totals(diagnosis: DataFrame) -> DataFrame:
    """One row: documents, with warnings, repaired, and blocking ones."""
    return diagnosis.agg(
        F.count(F.lit(1)).alias("documentos"),
        F.count_if(F.size("avisos") > 0).alias("com_avisos"),
        F.count_if("corrigido").alias("corrigidos"),
        F.count_if(F.col("status").isin(BLOCKING)).alias("bloqueantes"),
    )

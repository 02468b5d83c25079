"""Splitting documents into chunks, each with the headings above it, by column expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: From the strongest to the weakest place to split at, target length and overlap in characters.
SEPARATORS = ["\n## ", "\n### ", "\n\n", "\n", ". ", " "]
SIZE, OVERLAP = 1200, 200

#: White space of any kind, and ends of lines, as in Python's ``str.strip`` and ``str.splitlines``.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BREAK = r"\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}"
_WHITE = " " + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")
#: Where a line begins that may be a heading or a fence.
_MARKED = rf"(?<=[{BREAK}])(?!(?<=\r)\n)(?=[{SPACE}&&[^{BREAK}]]*(?:#|```))"
_HEADING = rf"\A(#{{1,6}})[{SPACE}]+(.+?)[{SPACE}]*#*\z"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value found once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(_WHITE))


def _windows(part: Column, size: int, overlap: int) -> Column:
    step = max(size - overlap, 1)
    last = F.greatest(F.lit(0), F.ceil((F.length(part) - size) / step)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), last), lambda k: strip(F.substr(part, k * step + 1, F.lit(size)))), lambda w: w != "")


def _groups(lengths: Column, gap: int, size: int, overlap: int) -> Column:
    """Runs ``first, after`` of neighbouring blocks that fit together; a short last one is repeated in the next run.

    One fold over the blocks' lengths: the run in hand starts at ``first``, has ``used``
    characters, and ``last`` is the length of its last block, the one before number ``at``.
    """
    fields = ("runs", "first", "at", "used", "last")
    state = lambda *values: F.struct(*[v.alias(f) for v, f in zip(values, fields, strict=True)])
    run = lambda s: F.concat(s["runs"], F.array(F.struct(s["first"].alias("first"), s["at"].alias("after"))))
    start = state(F.array().cast("array<struct<first:int,after:int>>"), *[F.lit(0)] * 4)

    def add(s: Column, n: Column) -> Column:
        again = state(run(s), s["at"] - 1, s["at"] + 1, s["last"] + n + gap, n)
        alone = state(run(s), s["at"], s["at"] + 1, n + gap, n)
        fits = state(s["runs"], s["first"], s["at"] + 1, s["used"] + n + gap, n)
        return F.when((s["used"] + n <= size - gap) | (s["at"] == s["first"]), fits).when(s["last"] <= overlap, again).otherwise(alone)

    return F.aggregate(lengths, start, add, run)


def _level(part: Column, separator: str, size: int, overlap: int) -> Column:
    """A part split at one separator and put together again as far as it fits; whole where there are no two blocks."""
    blocks = F.filter(F.split(part, rf"\Q{separator}\E"), lambda b: strip(b) != "")

    def joined(blocks: Column) -> Column:
        runs = _groups(F.transform(blocks, F.length), len(separator), size, overlap)
        return F.transform(runs, lambda r: strip(F.array_join(F.slice(blocks, r["first"] + 1, r["after"] - r["first"]), separator)))

    return _once(blocks, lambda b: F.when(F.size(b) < 2, F.array(part)).otherwise(joined(b)))


def split_text(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of a text as an array; separators at which it is split are lost, and null and blank texts have none.

    One array goes through all levels: of its parts those that are too long are split at the
    level's separator, and what is too long without any is cut into windows.
    """
    parts = F.filter(F.array(strip(F.coalesce(text, F.lit("")))), lambda p: p != "")
    deeper = lambda split: F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(split(p))))
    for separator in SEPARATORS:
        parts = deeper(lambda p: _level(p, separator, size, overlap))  # noqa: B023
    return deeper(lambda p: _windows(p, size, overlap))


def heading_paths(text: Column) -> Column:
    """Headings outside fenced code as ``inicio, caminho``: where each starts, and the path of headings in force from there.

    The text is cut before lines that may be headings or fences, and one fold goes over
    these parts; texts without a heading mark are not cut.
    """
    none = F.array().cast("array<struct<inicio:int,caminho:string>>")
    fields = ("found", "levels", "at", "fenced")
    state = lambda *values: F.struct(*[v.alias(f) for v, f in zip(values, fields, strict=True)])
    start = state(none, F.array_repeat(F.lit(""), 6), F.lit(0), F.lit(False))

    def add(s: Column, part: Column) -> Column:
        after = s["at"] + F.length(part)

        def step(bare: Column) -> Column:
            depth = F.length(F.regexp_extract(bare, _HEADING, 1))
            title = strip(F.regexp_extract(bare, _HEADING, 2))
            levels = F.transform(s["levels"], lambda t, k: F.when(k < depth - 1, t).when(k == depth - 1, title).otherwise(""))
            path = lambda now: F.struct(s["at"].alias("inicio"), F.array_join(F.filter(now, lambda t: t != ""), " > ").alias("caminho"))
            heads = _once(levels, lambda now: state(F.concat(s["found"], F.array(path(now))), now, after, F.lit(False)))
            passed = state(s["found"], s["levels"], after, s["fenced"])
            fence = state(s["found"], s["levels"], after, ~s["fenced"])
            return F.when(bare.startswith("```"), fence).when(s["fenced"] | ~bare.rlike(_HEADING), passed).otherwise(heads)

        return _once(strip(F.regexp_extract(part, rf"\A[^{BREAK}]*", 0)), step)

    return F.when(text.contains("#"), F.aggregate(F.split(text, _MARKED), start, add, lambda s: s["found"])).otherwise(none)


def locate(text: Column, chunks: Column) -> Column:
    """Where each chunk starts: its first 80 characters, searched from the place before; never going back."""

    def add(s: Column, chunk: Column) -> Column:
        found = F.call_function("locate", F.left(chunk, F.lit(80)), text, s["at"] + 1) - 1
        return _once(F.greatest(s["at"], found), lambda at: F.struct(F.concat(s["places"], F.array(at)).alias("places"), at.alias("at")))

    start = F.struct(F.array().cast("array<int>").alias("places"), F.lit(0).alias("at"))
    return F.aggregate(chunks, start, add, lambda s: s["places"])


def chunk_documents(parsed: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of documents ``chave, titulo, body``, in one pass inside the JVM without a shuffle.

    Each has its number, text, the heading path at its start and a hash of key, number and
    text.  A document without text has none.  Places are searched from a document's start,
    so work grows with its length times its chunks: a second for a text of a million characters.
    """
    text = F.coalesce("body", F.lit(""))
    split = parsed.select("chave", "titulo", text.alias("_text"), split_text(text, size, overlap).alias("_chunks"))
    placed = split.select("chave", "titulo", "_chunks", locate(F.col("_text"), F.col("_chunks")).alias("_places"), heading_paths(F.col("_text")).alias("_heads"))
    above = F.transform("_places", lambda at: F.coalesce(F.try_element_at(F.filter("_heads", lambda h: h["inicio"] <= at)["caminho"], F.lit(-1)), F.lit("")))
    rows = placed.select("chave", "titulo", F.posexplode(F.arrays_zip("_chunks", above.alias("_above"))).alias("chunk_indice", "_c"))
    chunk = F.col("_c._chunks")
    return rows.select(
        F.col("chave").alias("documento_chave"),
        F.col("titulo").alias("documento_titulo"),
        "chunk_indice",
        chunk.alias("chunk_texto"),
        F.col("_c._above").alias("heading_path"),
        F.sha2(F.concat_ws("|", "chave", "chunk_indice", chunk), 256).alias("chunk_hash"),
        F.length(chunk).alias("n_caracteres"),
    )


def fixed_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of fixed length, spaces trimmed, empty ones dropped, as an array."""
    step = max(size - overlap, 1)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), last), lambda k: F.trim(F.substr(text, k * step + 1, F.lit(size)))), lambda w: w != "")


def _in_ranges(positions: DataFrame, headings: DataFrame) -> DataFrame:
    """Headings and positions in one order of document and place, cut into ranges ``_part`` of about equal size, and written."""
    marks = headings.select("doc", F.col("inicio").alias("posicao"), F.lit(0).alias("_asks"), "caminho")
    asks = positions.select("doc", "posicao").distinct().withColumns({"_asks": F.lit(1), "caminho": F.lit(None).cast("string")})
    return written(marks.unionByName(asks).repartitionByRange("doc", "posicao", "_asks").withColumn("_part", F.spark_partition_id()), "asof")


def heading_asof(positions: DataFrame, headings: DataFrame) -> DataFrame:
    """The last heading at or before each position: both by document, headings with ``inicio, caminho``.

    Rows are cut into ranges, so a document of any size is spread over many; each range finds
    the last heading among its own rows, and the last one of the ranges before, for the
    documents that go on, comes from a table of one row per range and document.
    """
    rows = _in_ranges(positions, headings)
    here = Window.partitionBy("_part", "doc").orderBy("posicao", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("doc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tails = rows.groupBy("_part", "doc").agg(F.max_by("caminho", F.when(F.col("_asks") == 0, F.col("posicao"))).alias("_tail"))
    carried = tails.select("_part", F.col("doc").alias("_of"), F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    own = rows.withColumn("_own", F.last("caminho", ignorenulls=True).over(here)).where("_asks = 1")
    joined = own.join(carried.withColumnRenamed("_part", "_at"), (F.col("_part") == F.col("_at")) & F.col("doc").eqNullSafe(F.col("_of")), "left")
    return joined.select("doc", "posicao", F.coalesce("_own", "_carried", F.lit("")).alias("caminho"))

"""Listing, reading and comparing folders of Markdown documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders
from .scratch import written

MARKDOWN = r"(?i)\.(md|markdown)$"
#: Partitions of Spark's readers that one task reads, one file after the other.
TOGETHER = 32


def _files(spark: SparkSession, root: str, wanted: Column, empty: bool, contents: bool) -> DataFrame:
    """Files below a folder whose ``below``, their path from there, is wanted: ``path, below, length, modified`` (seconds), or ``below, content``.

    Names that start with ``.`` are passed over, and empty files unless they are asked for.
    Tasks list and read the folder, so that the driver's memory doesn't follow the number of
    files; a root that they can't list by themselves goes through Spark's reader, which
    passes over empty files in any case and over names that start with ``_``.
    """
    if not folders.reachable(spark, root):
        return _by_reader(spark, root).where(wanted)
    path = folders.local(root)
    lead = "file:" + path if path else root.rstrip("/")
    # a name may have bytes that are no text
    below = F.make_valid_utf8(F.col("below").cast("string"))
    files = folders.listed(spark, root).where(F.lit(empty) | (F.col("length") > 0)).withColumn("name", F.col("below")).withColumn("below", below).where(wanted)
    if contents:
        return folders.contents(files.select(F.col("name").alias("below"), "length"), root).withColumn("below", below)
    return files.select(F.concat(F.lit(lead.rstrip("/") + "/"), "below").alias("path"), "below", "length", "modified")


def _by_reader(spark: SparkSession, root: str) -> DataFrame:
    """Files as Spark's reader lists them on the driver: ``path, below, length, modified, content``.

    Spark counts some MB for opening a file, so that a task would have a few dozen small
    files at most and leave as many files of results as tasks: partitions are put together,
    ``TOGETHER`` in each, as long as there are several tasks a core.
    """
    lead = re.sub(r"\Afile:/+", "/", root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    partitions = files.select("path").rdd.getNumPartitions()
    fewer = max(8 * spark.sparkContext.defaultParallelism, partitions // TOGETHER)
    together = files.coalesce(fewer) if fewer < partitions else files
    return together.withColumn("below", F.substring_index("path", lead, -1)).withColumn("modified", F.unix_seconds("modificationTime"))


def document_key(path: Column, prefix: str = "") -> Column:
    """A path as a key: slashes only, none in front, without the logical prefix."""
    key = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    lead = prefix.strip("/") + "/" if prefix.strip("/") else ""
    return F.when(key.startswith(lead), F.substr(key, F.lit(len(lead) + 1))).otherwise(key) if lead else key


def document_uri(base: str, key: Column, prefix: str = "") -> Column:
    """Address of a key below a base and a logical prefix."""
    parts = [p for p in (base.rstrip("/"), prefix.strip("/")) if p]
    return F.concat_ws("/", *[F.lit(p) for p in parts], key)


def list_documents(spark: SparkSession, root: str, base: str = "", prefix: str = "", empty: bool = False) -> DataFrame:
    """Markdown files below a folder, at any depth: ``chave, origem_uri, etag, tamanho``; contents are not read.  With ``empty``, empty files too."""
    files = _files(spark, root, F.col("below").rlike(MARKDOWN), empty, contents=False)
    key = document_key(F.col("below"), prefix)
    return files.select(
        key.alias("chave"),
        (document_uri(base, key, prefix) if base else F.col("path")).alias("origem_uri"),
        F.concat(F.lit("mtime-"), "modified").alias("etag"),
        F.col("length").alias("tamanho"),
    ).orderBy("chave")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, bad bytes replaced, byte order marks at the start dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\x{FEFF}+", "")


def read_documents(spark: SparkSession, root: str, prefix: str = "", empty: bool = False) -> DataFrame:
    """Contents of Markdown files: ``chave, conteudo``, and hashes of the bytes and of the text, from one pass.  With ``empty``, empty files too."""
    files = _files(spark, root, F.col("below").rlike(MARKDOWN), empty, contents=True)
    text = decoded(F.col("content"))
    return files.select(
        document_key(F.col("below"), prefix).alias("chave"), text.alias("conteudo"), F.sha2("content", 256).alias("hash_bruto"), F.sha2(text, 256).alias("conteudo_hash")
    )


def read_notes(spark: SparkSession, root: str, empty: bool = False) -> DataFrame:
    """Rule notes: ``path, conteudo`` of ``*.md`` below a folder, without hidden paths and undecodable files.  With ``empty``, empty files too."""
    files = _files(spark, root, F.col("below").endswith(".md") & ~F.col("below").rlike(r"(^|/)\."), empty, contents=True)
    return files.where(F.is_valid_utf8(F.col("content").cast("string"))).select(F.col("below").alias("path"), F.col("content").cast("string").alias("conteudo"))


def split_pending(listing: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Each listed document with ``pendente``: whether it must be processed.

    It must if forced, if it has no version tag, or if the tag differs from the one in the
    index state (``documento_chave, origem_etag``); a key that the state lacks differs.
    """
    known = state.select(F.col("documento_chave").alias("chave"), F.col("origem_etag").alias("_stored"))
    pending = F.lit(force) | (F.coalesce("etag", F.lit("")) == "") | ~F.col("etag").eqNullSafe(F.col("_stored"))
    return listing.join(known, "chave", "left").withColumn("pendente", pending).drop("_stored")


def removed_documents(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Keys of the index state that are listed no more, sorted."""
    return state.select("documento_chave").join(listing.select(F.col("chave").alias("documento_chave")), "documento_chave", "left_anti").orderBy("documento_chave")


def sync_plan(local: DataFrame, remote: DataFrame, force: bool = False, remove: bool = False) -> DataFrame:
    """What publishing does with each key: ``enviado``, ``atualizado``, ``inalterado`` or ``removido``.

    ``local``: ``chave, hash_bruto, conteudo_hash``; ``remote``: ``chave, remoto_hash``.  A
    remote hash of the file's bytes or of its decoded text counts as unchanged; keys that are
    remote only are reported if they are to be removed.
    """
    mine = local.select("chave", "hash_bruto", "conteudo_hash", F.lit(True).alias("_here"))
    both = mine.join(remote.select("chave", "remoto_hash", F.lit(True).alias("_there")), "chave", "full_outer")
    same = F.coalesce((F.col("remoto_hash") == F.col("hash_bruto")) | (F.col("remoto_hash") == F.col("conteudo_hash")), F.lit(False))
    status = (
        F.when(F.col("_here").isNull(), "removido").when(F.col("_there").isNull(), "enviado").when(same & F.lit(not force), "inalterado").otherwise("atualizado")
    )
    planned = both.select("chave", status.alias("status"))
    return planned if remove else planned.where("status <> 'removido'")


#: Leaves of a tree of digests, and children of each node.
LEAVES, FANOUT = 65_536, 256


def digest_tree(rows: DataFrame, hash_col: str, leaves: int = LEAVES) -> DataFrame:
    """``nivel, no, digesto, chaves`` of documents ``chave`` with a hash: digests of buckets of keys, and of ever larger groups of buckets.

    A bucket's digest adds up hashes of its keys and their hashes, so partial sums in each task
    are all that is shuffled; a node's is that of its children in order.  Level 0 has the
    leaves, the last level one root.  Publish it beside what it describes.
    """
    row = F.struct(*[F.xxhash64(F.lit(seed), "chave", F.col(hash_col)).cast("decimal(38,0)").alias(f"h{seed}") for seed in (1, 2)])
    leaf = rows.where(F.col("chave").isNotNull()).select(F.pmod(F.xxhash64("chave"), F.lit(leaves)).cast("int").alias("no"), row.alias("h"))
    level = leaf.groupBy("no").agg(F.sum("h.h1").alias("a"), F.sum("h.h2").alias("b"), F.count(F.lit(1)).alias("chaves"))
    # written, as every level above is made of it
    level = written(level.select("no", F.sha2(F.concat_ws("|", "a", "b", "chaves"), 256).alias("digesto"), "chaves"), "digest-leaves")
    tree, number, width = level.withColumn("nivel", F.lit(0)), 0, leaves
    while width > 1:
        number, width = number + 1, -(-width // FANOUT)
        children = F.array_sort(F.collect_list(F.struct("no", "digesto")))
        level = level.groupBy(F.floor(F.col("no") / FANOUT).cast("int").alias("up")).agg(F.sha2(F.to_json(children), 256).alias("digesto"), F.sum("chaves").alias("chaves")).withColumnRenamed("up", "no")
        tree = tree.unionByName(level.withColumn("nivel", F.lit(number)))
    return tree.select("nivel", "no", "digesto", "chaves")


def differing_leaves(mine: list[DataFrame], theirs: DataFrame, leaves: int = LEAVES) -> list[int]:
    """Buckets in which the other side's tree equals none of ours, from the root down: below nodes that are equal nothing is read.

    ``mine`` has a tree for each hash that counts as unchanged.  Levels are compared one at a
    time, only below what differed above; numbers of nodes, ``leaves`` at most, go through the driver.
    """
    top, width = 0, leaves
    while width > 1:
        top, width = top + 1, -(-width // FANOUT)
    open_: list[int] = [0]
    for level in range(top, -1, -1):
        at = lambda tree: tree.where((F.col("nivel") == level) & F.col("no").isin(open_)).select("no", "digesto")  # noqa: B023, E731
        other = at(theirs).withColumnRenamed("digesto", "_theirs")
        differs = None
        for tree in mine:
            joined = at(tree).join(other, "no", "full_outer").where(~F.col("digesto").eqNullSafe(F.col("_theirs"))).select("no")
            differs = joined if differs is None else differs.join(joined, "no", "left_semi")
        found = sorted(r[0] for r in differs.distinct().collect())
        if not found or level == 0:
            return found
        open_ = [n * FANOUT + k for n in found for k in range(FANOUT)]
    return open_


def sync_changes(local: DataFrame, remote: DataFrame, mine: list[DataFrame], theirs: DataFrame, remove: bool = False, leaves: int = LEAVES) -> DataFrame:
    """The rows of :func:`sync_plan` that are not ``inalterado``, by trees of digests: only keys of differing buckets are listed and joined.

    ``mine`` are the trees of ``local`` by ``hash_bruto`` and by ``conteudo_hash``, ``theirs``
    that of ``remote`` by ``remoto_hash``.
    """
    found = differing_leaves(mine, theirs, leaves)
    inside = F.pmod(F.xxhash64("chave"), F.lit(leaves)).cast("int").isin(found) if found else F.lit(False)
    return sync_plan(local.where(inside), remote.where(inside), remove=remove).where("status <> 'inalterado'")

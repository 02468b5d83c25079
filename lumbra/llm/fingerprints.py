"""Document fingerprints by I-Match with randomised lexicons.

A term is a distinct word.  The lexicon holds the terms whose document frequency lies in a
band (so whose inverse document frequency does): neither words that nearly all documents
share nor rare ones.  Each of 88 lexicon subsets keeps a random part of the lexicon, at
eleven rates from 1/2 to 1/2048; a document's sorted distinct terms within a subset are hashed
to 16 bits.  Sparse subsets tell how alike long documents are, dense ones short documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices
from .storage import materialise
from .words import hash_words, mix, words_of

RATES, PER_RATE = 11, 8
SUBSETS = RATES * PER_RATE
#: The band as shares of all documents, and as numbers of documents below which neither end goes.
BAND, LEAST = (0.0005, 0.05), (2, 30)


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> np.ndarray:
    """Sorted hashes of the terms whose number of documents is within ``band``, as a share of all, neither end of which is below ``LEAST``.

    Frequencies count every document.  The shares of all terms add up to the mean number of
    terms of a document, so no more than that mean over ``band[0]`` terms are in the band,
    however large the corpus: some 600,000 hashes for 300 terms a document.
    """
    total = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 4 << 20):
            terms = [np.unique(hash_words(words_of(text.as_py()))) for text in batch.column(0)]
            found, n = np.unique(np.concatenate(terms), return_counts=True) if terms else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["term", "n"])

    df = docs.select(text_col).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    kept = df.where(F.col("df").between(max(LEAST[0], band[0] * total), max(LEAST[1], band[1] * total))).select("term")
    return np.sort(kept.toPandas()["term"].to_numpy(np.int64).view(np.uint64))


class Fingerprinter:
    """Fingerprints of texts against a lexicon: arrays of 88 hashes, 0 where a subset has none of the terms."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms

    def __call__(self, text: str | None) -> np.ndarray:
        own = np.unique(hash_words(words_of(text)))
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
            own = own[self.terms[at] == own]
        if not len(own) or not len(self.terms):
            return np.zeros(SUBSETS, np.uint16)
        # subset s of rate 2**-(r+1) keeps the terms whose first r + 1 random bits for s are all set
        lanes = mix(own[None, :] + _LANES[:, None])
        flags = lanes.view(np.uint8).reshape(RATES, len(own), 8)[:, :, :PER_RATE] & 1
        kept = np.bitwise_and.accumulate(flags, axis=0).transpose(0, 2, 1).reshape(SUBSETS, len(own))
        # terms are distinct and sorted, so a sum of their scrambled hashes stands for the sequence
        sums = kept.astype(np.uint64) @ mix(own ^ np.uint64(0x51ED270B7A3F2C95))
        digests = np.maximum(mix(sums) >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        return np.where(kept.any(1), digests, 0).astype(np.uint16)


#: A random number for each rate.
_LANES = np.arange(1, RATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def to_text(print_: np.ndarray) -> str:
    """A fingerprint as 352 hexadecimal digits."""
    return print_.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How alike two fingerprints are, 0 to 1; of two without any terms, which tell nothing, 0.

    At each rate, the share of equal hashes among subsets in which either document has
    terms.  Where a subset holds about one term of both documents that share estimates the
    part of terms they have in common; so the two sparsest rates with four such subsets or
    more count, or all if no rate has so many.
    """
    some = ((a != 0) | (b != 0)).reshape(RATES, PER_RATE).sum(1)
    same = ((a != 0) & (a == b)).reshape(RATES, PER_RATE).sum(1)
    if not some.any():
        return 0.0
    enough = np.flatnonzero(some >= 4)[-2:]
    if not len(enough):
        enough = np.arange(RATES)
    return float(same[enough].sum() / some[enough].sum())


_FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(prints: Fingerprinter, text: str, own: np.ndarray, following: str, next_print: np.ndarray) -> tuple:
    k = len(text) // 4
    edited = text[: len(text) - k] + following[:k]
    changed = own if edited == text else prints(edited)
    near = [1.0 if other == text else likeness(own, there) for other, there in ((edited, changed), (following, next_print))]
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(own), to_text(changed), *near


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprint every whole text, the text edited with the next one's start, and compare them.

    The edited text has its last ``floor(n_chars / 4)`` code points replaced by the first as
    many (or all) of the next document's, in ascending order of id (ties: in a fixed order;
    null ids first), after the last the first.  Returns id, ``n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.  Null counts as empty; texts without terms of
    the lexicon have a fingerprint of zeros, which is like no other; equal texts have equal
    fingerprints and a likeness of 1; repeated rows follow each other; texts of any length are
    read whole; an empty table gives no rows; other columns are not read.

    One shuffle puts documents in order, so all but the last of each partition have their
    successor beside them; only these last ones are joined to first ones of later partitions.
    """
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(lexicon(docs, text_col, band))
    kind = docs.schema[id_col].dataType.simpleString()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack.compress((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())], [id_col, "_hash", "_packed"])

    # texts are shuffled compressed one by one, which takes less disk than the shuffle's own compression
    packed = docs.select(id_col, F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_hash"), text_col).mapInArrow(squeeze, f"`{id_col}` {kind}, _hash long, _packed binary")
    # by hash too, so that rows of one id, or of none, may span several ranges
    ordered = packed.repartitionByRange(id_col, "_hash").sortWithinPartitions(id_col, "_hash", "_packed").select(id_col, "_packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, part, unpack = Fingerprinter(terms.value), TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        held = None
        for batch in slices(batches, 1):
            rows: list[tuple] = []
            keys = batch.column(0)
            for n, data in enumerate(batch.column(1).to_pylist()):
                text = unpack.decompress(data).decode()
                key, own = keys[n].as_py(), prints(text)
                if held is None:
                    rows.append((part, "first", key, text, *[None] * 6))
                else:
                    rows.append((part, None, held[0], None, *_compare(prints, held[1], held[2], text, own)))
                held = key, text, own
            yield _table(rows, keys.type)
        if held is not None:
            yield _table([(part, "last", held[0], held[1], *[None] * 6)], keys.type)

    done = materialise(ordered.mapInArrow(run, f"_part int, _edge string, `{id_col}` {kind}, _text string, {_FIELDS}"), "fingerprints")
    first = done.where(F.col("_edge") == "first").select("_part", F.col("_text").alias("_next"))
    last = done.where(F.col("_edge") == "last").select("_part", id_col, "_text")
    parts = first.select("_part")
    after = parts.select("_part", F.coalesce(F.lead("_part").over(Window.orderBy("_part")), F.min("_part").over(Window.partitionBy(F.lit(1)))).alias("_after"))
    edges = last.join(after, "_part").drop("_part").join(first.withColumnRenamed("_part", "_after"), "_after").select(id_col, "_text", "_next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter(terms.value)
        for batch in batches:
            texts = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            rows = [(None, None, None, None, *_compare(prints, a, prints(a), b, prints(b))) for a, b in texts]
            out = _table(rows, batch.column(0).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns[4:]], [id_col, *_NAMES])

    tail = edges.mapInArrow(finish, f"`{id_col}` {kind}, {_FIELDS}")
    return done.where(F.col("_edge").isNull()).select(id_col, *_NAMES).unionByName(tail)


_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _table(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 10
    kinds = [pa.int32(), pa.string(), id_type, pa.string(), *_TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_part", "_edge", "_id", "_text", *_NAMES])

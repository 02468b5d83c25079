"""Token-ID output: shards of token ids, compressed by Re-Pair grammars, that decode at random.

A table of shards is a Parquet folder with one row per shard.  Its column ``blob`` is
self-contained::

    8s  b"REPAIR2\\0"
    u4  base        ids below are terminals, rule k is id base + k
    u4  n_rules, n_docs, bits (of a symbol)
    u8  n_symbols, n_tokens
    rules    n_rules x 2 symbols   what the rule stands for, in terms of earlier rules
    places   (n_docs + 1) x u8     symbol at which each document starts
    symbols  n_symbols symbols

all little-endian; runs of symbols are packed by ``bits`` each, lowest first, to whole bytes.
A document's ids are found from its place alone: its symbols are looked up in the rules.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import slices
from .tokens import dealt, encoder

_HEAD = struct.Struct("<8sIIIIQQ")
_MAGIC = b"REPAIR2\0"
#: Ids after which a shard is closed (a document is never split, so one may hold more).
SHARD_IDS = 1_000_000
#: Slots of a worker's encoder, so that it starts afresh after some 160 MB of texts, and bytes of text encoded together.
SLOTS, SLICE = 1 << 21, 4 << 20
#: Pairs replaced in a round (more, if they occur at least half as often as the most frequent), and uses
#: that a rule must have: it is written as two symbols and saves one a use, so from three on it pays.
RULES, USES = 8192, 3
#: Bits of the tables in which pairs are looked up by their hash.
_RULE_BITS, _OFTEN_BITS = 18, 22


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


def _pairs(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids at some places and after them, as one number each."""
    keys = np.empty((len(at), 2), np.uint32)
    keys[:, 1], keys[:, 0] = seq[at], seq[at + 1]
    return keys.view(np.uint64).ravel()


def repair(ids: np.ndarray, ends: np.ndarray, base: int, rules: int = RULES, uses: int = USES):
    """Compress ``ids`` by replacing frequent pairs of neighbours by new ids, until no pair has ``uses`` places.

    ``ends`` flags the last id of each document: no pair crosses it.  Each round counts the
    places of all pairs that don't overlap places of the same pair and takes the most
    frequent; where these overlap each other, the more frequent one is replaced.  So the most
    frequent pair of a round is replaced everywhere, and what it blocks is left to the next.
    A pair can only gain places if a new id is in it, so places of pairs that are too rare
    are not looked at again until a neighbour is replaced.
    Returns symbols, rule pairs, lengths of expansions and the ends flags of the symbols.
    """
    seq, ends, alive = ids.astype(np.uint32), ends.copy(), ~ends
    pairs = np.zeros((0, 2), np.uint32)
    lengths = np.zeros(0, np.uint32)
    while True:
        alive[-1:] = False
        at = np.flatnonzero(alive)
        keys = _pairs(seq, at)
        again = np.flatnonzero((keys[1:] == keys[:-1]) & (at[1:] == at[:-1] + 1)) + 1
        odd = None
        if len(again):  # of a run of one id, the first, third and so on
            n = np.arange(len(again))
            head = np.ones(len(again), bool)
            head[1:] = again[1:] != again[:-1] + 1
            odd = np.ones(len(at), bool)
            odd[again[(n - np.maximum.accumulate(np.where(head, n, 0))) % 2 == 0]] = False
        inner = np.sort(keys if odd is None else keys[odd])
        firsts = np.flatnonzero(np.concatenate(([True], inner[1:] != inner[:-1]))) if len(inner) else np.zeros(0, np.int64)
        counts = np.diff(np.append(firsts, len(inner)))
        often = np.flatnonzero(counts >= uses)
        if not len(often):
            return seq, pairs, lengths, ends
        flags = np.zeros(1 << _OFTEN_BITS, bool)
        flags[_slot(inner[firsts[often]], _OFTEN_BITS)] = True
        stay = flags[_slot(keys, _OFTEN_BITS)]
        alive[at] = stay
        # chosen pairs are among those that stay
        stay = np.flatnonzero(stay if odd is None else stay & odd)
        at, keys = at[stay], keys[stay]
        often = often[np.argsort(-counts[often], kind="stable")]
        chosen = inner[firsts[often[: max(rules, int((counts[often] * 2 >= counts[often[0]]).sum()))]]]
        # a slot holds one pair; of those that meet in one, the most frequent stays
        table = np.full(1 << _RULE_BITS, -1, np.int32)
        order = np.arange(len(chosen))[::-1]
        table[_slot(chosen[order], _RULE_BITS)] = order
        rule = table[_slot(keys, _RULE_BITS)]
        hit = np.flatnonzero(rule >= 0)
        hit = hit[chosen[rule[hit]] == keys[hit]]
        at, rule = at[hit], rule[hit]
        near = at[1:] == at[:-1] + 1
        won = np.ones(len(at), bool)
        won[1:] &= ~near | (rule[1:] < rule[:-1])
        won[:-1] &= ~near | (rule[:-1] < rule[1:])
        at, rule = at[won], rule[won]
        used = np.bincount(rule, minlength=len(chosen)) >= uses
        at, rule = at[used[rule]], rule[used[rule]]
        number = np.cumsum(used) - 1 + base + len(pairs)
        seq[at] = number[rule]
        kept = chosen[used]
        new = np.stack([(kept >> np.uint64(32)).astype(np.uint32), kept.astype(np.uint32)], axis=1)
        size = np.ones(new.shape, np.uint32)
        size[new >= base] = lengths[new[new >= base] - base]
        lengths = np.concatenate([lengths, size.sum(1, dtype=np.uint32)])
        pairs = np.concatenate([pairs, new])
        # new symbols make new pairs with their neighbours
        alive[at] = ~ends[at + 1]
        before = at[at > 0] - 1
        alive[before] = ~ends[before]
        ends[at] = ends[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        seq, ends, alive = seq[stay], ends[stay], alive[stay]


#: Symbols packed together: a multiple of 8, so that each lot fills whole bytes.
_LOT = 1 << 16


def _pack(symbols: np.ndarray, bits: int) -> bytes:
    lots = (symbols[k : k + _LOT].astype("<u4").view(np.uint8).reshape(-1, 4) for k in range(0, len(symbols), _LOT))
    return b"".join(np.packbits(np.unpackbits(x, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes() for x in lots)


def _unpack(blob: bytes, at: int, n: int, bits: int) -> np.ndarray:
    out = np.empty(n, "<u4")
    for k in range(0, n, _LOT):
        m = min(_LOT, n - k)
        flat = np.unpackbits(np.frombuffer(blob, np.uint8, -(-m * bits // 8), at + k * bits // 8), count=m * bits, bitorder="little")
        wide = np.zeros((m, 32), np.uint8)
        wide[:, :bits] = flat.reshape(m, bits)
        out[k : k + m] = np.packbits(wide, axis=1, bitorder="little").view("<u4")[:, 0]
    return out


def pack_shard(ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    """One shard's blob from the ids of its documents, one after the other, and flags of each one's last id."""
    seq, pairs, _, ends = repair(ids, ends, base)
    places = np.concatenate(([0], np.flatnonzero(ends) + 1)).astype("<u8")
    bits = max(1, (base + len(pairs) - 1).bit_length())
    head = _HEAD.pack(_MAGIC, base, len(pairs), len(places) - 1, bits, len(seq), len(ids))
    return b"".join([head, _pack(pairs.ravel(), bits), places.tobytes(), _pack(seq, bits)])


class Shard:
    """Random access to the documents of a blob."""

    def __init__(self, blob: bytes) -> None:
        magic, self.base, n_rules, self.n_docs, bits, n_symbols, self.n_tokens = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size
        rules = _unpack(blob, at, 2 * n_rules, bits).reshape(-1, 2)
        at += -(-2 * n_rules * bits // 8)
        self.places = np.frombuffer(blob, "<u8", self.n_docs + 1, at).astype(np.int64)
        self.symbols = _unpack(blob, at + 8 * (self.n_docs + 1), n_symbols, bits)
        # rules stand after those that they use; runs of rules that use none of each other are expanded together
        newest = np.where(rules >= self.base, rules.astype(np.int64) - self.base, -1).max(1, initial=-1)
        self.lengths, self._from, self._flat = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        while (done := len(self.lengths)) < n_rules:
            stop = np.flatnonzero(newest[done:] >= done)
            stop = done + int(stop[0]) if len(stop) else n_rules
            flat, sizes = self._expanded(rules[done:stop].ravel())
            self.lengths = np.concatenate([self.lengths, sizes.reshape(-1, 2).sum(1)])
            self._from = np.concatenate(([0], np.cumsum(self.lengths)))
            self._flat = np.concatenate([self._flat, flat])

    def _expanded(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that symbols stand for, and how many each has."""
        rule = symbols.astype(np.int64) - self.base
        at = np.flatnonzero(rule >= 0)
        size = np.ones(len(symbols), np.int64)
        size[at] = self.lengths[rule[at]]
        if not len(at):
            return symbols.astype(np.uint32), size
        # terminals follow the expansions in one pool, so that all symbols are dealt alike
        start = len(self._flat) + np.arange(len(symbols))
        start[at] = self._from[rule[at]]
        return dealt(np.concatenate([self._flat, symbols.astype(np.uint32)]), start, size), size

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self._expanded(self.symbols[self.places[k] : self.places[k + 1]])[0]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, one after the other, and where each starts (and the last one ends)."""
        ids, size = self._expanded(self.symbols)
        return ids, np.concatenate(([0], np.cumsum(size)))[self.places]


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, base: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, append ``end_id`` and write shards to ``path`` in ascending order of id.

    Rows of one id follow each other in a fixed order, equal ones as often as they are there;
    null ids come first; null and empty texts have the end id only; a text of any length is
    one document.  ``base`` is the vocabulary's size.  Documents are dealt to ranges of ids
    (and of hashes of texts, so that one id's rows may span several), so a shard holds a
    stretch of the order; row fields ``part, shard`` order shards.  An empty table gives a
    folder without rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [id_col, "_hash"]
    ordered = docs.select(id_col, F.xxhash64(text).alias("_hash"), text.alias("_text")).repartitionByRange(*order).sortWithinPartitions(*order, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(tokenizer, SLOTS), TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            names = pa.concat_arrays(keys)
            ends = np.zeros(size, bool)
            ends[np.cumsum(np.concatenate(lengths)) - 1] = True
            values = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), values, pa.array([pack_shard(np.concatenate(held), ends, base)], pa.binary())], ["part", "shard", "ids", "blob"]
            )

        for batch in slices(batches, 1, SLICE):
            ids, at = enc.encode(batch.column(1), end_id)
            row = 0
            while row < batch.num_rows:
                # up to the document that fills the shard
                stop = min(int(np.searchsorted(at, at[row] + shard_ids - size, "left")), batch.num_rows)
                keys.append(batch.column(0).slice(row, stop - row))
                held.append(ids[at[row] : at[stop]])
                lengths.append(np.diff(at[row : stop + 1]))
                size += int(at[stop] - at[row])
                row = stop
                if size >= shard_ids:
                    yield close()
                    keys, held, lengths, size, shard = [], [], [], 0, shard + 1
        if held:
            yield close()

    rows = ordered.select(id_col, "_text").mapInArrow(run, f"part int, shard int, ids array<{kind}>, blob binary")
    rows.write.option("parquet.block.size", str(16 << 20)).parquet(path)


def _header_long(blob: Column, at: int) -> Column:
    """A little-endian 64-bit number in a blob, ``at`` bytes from its start."""
    digits = F.hex(F.substring(blob, at + 1, 8))
    return F.conv(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]), 16, 10).cast("long")


def read_token_shards(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Decode every document of shards: id, ``start`` (ids before it), ``n_tokens`` and ``ids_crc32``.

    Everything is read from the blobs: sizes of shards are in their heads, and places of
    shards come from sums per part, then inside each part, so no window holds more than the
    parts or one part's shards.  A folder without rows gives none.
    """
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "shard", _header_long(F.col("blob"), _HEAD.size - 8).alias("_tokens"))
    parts = sizes.groupBy("part").agg(F.sum("_tokens").alias("_sum"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_sum").over(before(Window.orderBy("part"))), F.lit(0)).alias("_part_start"))
    inside = before(Window.partitionBy("part").orderBy("shard"))
    starts = sizes.withColumn("_in", F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("_in") + F.col("_part_start")).alias("_start"))
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, number, names, blob = (batch.column(c)[row] for c in ("part", "shard", "ids", "blob"))
                shard = Shard(blob.as_py())
                found, at = shard.documents()
                data, n = memoryview(found.astype("<u4")).cast("B"), shard.n_docs
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(part, n), pa.repeat(number, n), names.values, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                    ["part", "shard", id_col, "_at", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "shard", "ids", "blob").mapInArrow(run, f"part int, shard int, `{id_col}` {kind}, _at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select(id_col, (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")

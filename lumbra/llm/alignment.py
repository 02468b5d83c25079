"""Cross-tokenizer alignment: which tokens of one vocabulary cover the same bytes as which of another.

Where the first tokenizer always starts a token and no token of the second one joins the
bytes on both sides, a text may be cut without a change to either's tokens.  A worker
encodes and aligns each distinct piece once, by diagonal run skipping over the token ends
of all new pieces together, and remembers recent ones; a text's groups and links are those
of its pieces.

Links of one id pair in many documents are counted over blocks of documents: a block names
each of its pairs once and its documents refer to them, so what is shuffled follows the
distinct pairs of blocks, not those of documents.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .storage import materialise
from .tokens import cut_at_spaces, dealt

#: Pieces a worker remembers before it starts afresh, and text bytes and documents of a block at most, but for one longer text.
_REMEMBERED = 400_000
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 100_000

def align_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Where groups end in both lists of token ends, as numbers of tokens: after each end that both have.

    At the current shift of indexes, stretches of ends are compared whole and grow twofold
    while they agree (each agreeing place ends a group of one token each), then shrink
    twofold to the first place that doesn't.  From there the list that is behind advances
    until both have an end in common, which closes a group and sets the shift anew.
    """
    ends_a: list[int] = []
    ends_b: list[int] = []
    i = j = 0
    stop = len(a)
    while i < stop:
        width = 1
        while width and i < stop:
            if a[i : i + width] == b[j : j + width]:
                width = min(width, stop - i)
                ends_a.extend(range(i + 1, i + width + 1))
                ends_b.extend(range(j + 1, j + width + 1))
                i, j, width = i + width, j + width, width * 2
            else:
                # once a stretch has failed, the rest of it is searched by halves
                width //= 2
                while width:
                    if a[i : i + width] == b[j : j + width]:
                        ends_a.extend(range(i + 1, i + width + 1))
                        ends_b.extend(range(j + 1, j + width + 1))
                        i, j = i + width, j + width
                    width //= 2
        if i < stop:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
            ends_a.append(i)
            ends_b.append(j)
    return ends_a, ends_b


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Its alphabet spells printable bytes by themselves and the others, in order, by the
    characters from U+0100 on.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    added = tokenizer.get_added_tokens_decoder()
    out = []
    for k in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(k)
        out.append(token.encode() if k in added else bytes(spelt[c] for c in token))
    return out


def sentence_tokens(model) -> list[bytes]:
    """The bytes of each id of a sentencepiece model, U+2581 as a space."""
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]


class Aligner:
    """Groups and links of pieces, remembered; ``path_a`` a byte-level vocabulary, ``path_b`` a sentencepiece model that adds a space."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._a, self._b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self._a.encode_special_tokens = True
        self.bytes_a, self.bytes_b = byte_level_tokens(path_a), sentence_tokens(self._b)
        # a piece is encoded after a line end, a token of its own, so that no space is put before it
        self._lead = len(self._b.encode("\n"))
        if any(b"\n" in t for t in self.bytes_b if len(t) > 1):
            raise ValueError("the second vocabulary joins line ends with other characters")
        #: bytes that some token of the second vocabulary has side by side
        self._joined = np.zeros((256, 256), bool)
        for token in self.bytes_b:
            self._joined[list(token[:-1]), list(token[1:])] = True
        self._size_a, self._size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._groups: list[bytes] = []
        #: whether a piece has tokens; numbers of tokens of both, groups and links; where its pairs start in the pool and how many there are
        self._rows = np.zeros((1024, 7), np.int64)
        self._pairs, self._times, self._used = np.zeros(4096, np.int64), np.zeros(4096, np.int64), 0

    def _learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        a = [e.ids for e in self._a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [ids[self._lead :] for ids in self._b.encode(["\n" + t for t in texts], num_threads=1)]
        good = [b"".join(map(self.bytes_a.__getitem__, x)) == p == b"".join(map(self.bytes_b.__getitem__, y)) for p, x, y in zip(pieces, a, b, strict=True)]
        a, b = [x if g else [] for g, x in zip(good, a, strict=True)], [y if g else [] for g, y in zip(good, b, strict=True)]
        n_a, n_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        flat_a, flat_b = (np.fromiter((k for x in ids for k in x), np.int64, int(n.sum())) for ids, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = (np.array(e, np.int64) for e in align_ends(np.cumsum(self._size_a[flat_a]).tolist(), np.cumsum(self._size_b[flat_b]).tolist()))
        in_a, in_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        # pieces end with a token of either
        through = np.searchsorted(ends_a, np.cumsum(n_a), "right")
        n_groups = np.diff(through, prepend=0)
        links = np.concatenate(([0], np.cumsum(in_a * in_b)))[through]

        said_a, said_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        groups = [
            f"{said_a[k - 1]}|{said_b[m - 1]}" if n == r == 1 else f"{','.join(said_a[k - n : k])}|{','.join(said_b[m - r : m])}"
            for n, k, r, m in zip(in_a.tolist(), ends_a.tolist(), in_b.tolist(), ends_b.tolist(), strict=True)
        ]
        at = 0
        for end in through.tolist():
            self._groups.append(";".join(groups[at:end]).encode())
            at = end

        # the distinct ids of each group, then all pairs of them
        (of_a, id_a, times_a), (of_b, id_b, times_b) = (self._distinct(np.repeat(np.arange(len(n)), n), flat) for n, flat in ((in_a, flat_a), (in_b, flat_b)))
        first_b = np.searchsorted(of_b, np.arange(len(in_b) + 1))
        per = np.diff(first_b)[of_a]
        right = dealt(np.arange(len(of_b)), first_b[of_a], per)
        pairs, times = np.repeat(id_a << 32, per) | id_b[right], np.repeat(times_a, per) * times_b[right]
        held = np.diff(np.searchsorted(np.repeat(of_a, per), through), prepend=0)

        rows = np.stack([np.array(good, np.int64), n_a, n_b, n_groups, np.diff(links, prepend=0), self._used + np.cumsum(held) - held, held], axis=1)
        had = len(self._known)
        for k, p in enumerate(pieces, had):
            self._known[p] = k
        self._rows = self._put(self._rows, had, rows)
        self._pairs, self._times = self._put(self._pairs, self._used, pairs), self._put(self._times, self._used, times)
        self._used += len(pairs)

    @staticmethod
    def _put(pool: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        while at + len(values) > len(pool):
            pool = np.concatenate([pool, np.zeros_like(pool)])
        pool[at : at + len(values)] = values
        return pool

    @staticmethod
    def _distinct(of: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both, times = np.unique((of << 32) | ids, return_counts=True)
        return both >> 32, both & 0xFFFFFFFF, times

    def _find(self, pieces: list[bytes]) -> np.ndarray:
        if len(self._known) > _REMEMBERED:
            self._forget()
        if new := [p for p in pieces if p not in self._known]:
            self._learn(new)
        return np.fromiter(map(self._known.__getitem__, pieces), np.int64, len(pieces))

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts with a space put before them, and how many each has; null and empty texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        pieces, counts = cut_at_spaces(pc.if_else(pc.equal(texts, ""), pa.scalar("", pa.large_string()), spaced))
        if not len(pieces):
            return pieces, counts
        _, offsets, data = pieces.buffers()
        cuts = np.frombuffer(offsets, np.int32, len(pieces) + 1)
        raw = np.frombuffer(data, np.uint8, int(cuts[-1]))
        starts = np.ones(len(pieces), bool)
        starts[1:] = ~self._joined[raw[cuts[1:-1] - 1], raw[cuts[1:-1]]]
        starts[(np.cumsum(counts) - counts)[counts > 0]] = True
        at = np.append(np.flatnonzero(starts), len(pieces))
        of = np.repeat(np.arange(len(counts)), counts)
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(cuts[at]), data), np.bincount(of[starts], minlength=len(counts))

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of whole texts: numbers of tokens of both, groups and links; groups spelt out; and the pairs linked.

        Pairs are ``distinct`` ones (first id in the upper 32 bits), and for each text, one
        after the other, which of them it holds, how often, and where each text's end.
        """
        pieces, counts = self._cut(texts)
        found = pieces.dictionary_encode()
        code = self._find(found.dictionary.cast(pa.binary()).to_pylist())
        local = found.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(counts)
        of = np.repeat(np.arange(len(texts)), counts)
        rows = self._rows[code]
        bad = np.bincount(of, rows[local, 0] == 0, len(texts)) > 0
        kept = ~bad[of]
        total = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(rows[local, 1:5] * kept[:, None], axis=0)))
        numbers = total[ends] - total[ends - counts]
        spelt, nth = self._groups, code[local].tolist()
        groups = [b"" if bad[k] or not n else b";".join([spelt[x] for x in nth[e - n : e]]) for k, (e, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True))]

        # pieces of a text, each once, then their pairs, each once
        width = max(len(code), 1)
        held, often = np.unique(of[kept] * width + local[kept], return_counts=True)
        start, size = rows[:, 5], rows[:, 6]
        distinct, nth_pair = np.unique(dealt(self._pairs, start, size), return_inverse=True)
        first = np.cumsum(size) - size
        text, piece = held // width, held % width
        n = size[piece]
        key = np.repeat(text, n) * max(len(distinct), 1) + dealt(nth_pair, first[piece], n)
        times = np.repeat(often, n) * dealt(self._times, start[piece], n)
        by = np.argsort(key, kind="stable")
        key, times = key[by], times[by]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        times = np.add.reduceat(times, heads) if len(heads) else times
        key = key[heads]
        text_ends = np.searchsorted(key, np.arange(1, len(texts) + 1) * max(len(distinct), 1))
        return numbers, groups, (distinct, key % max(len(distinct), 1), times, text_ends)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner of two vocabulary files; one for others is forgotten."""
    if (path_a, path_b) not in _aligners:
        _aligners.clear()
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_a, n_b, n_groups, n_links`` and ``groups``, spelt ``a1,a2|b1;a3|b2,b3``.

    Tokens are those of the text with a space before it.  Null and empty texts, and those
    whose tokens of either vocabulary do not spell them byte for byte, have none.  Nothing
    is shuffled; texts are read whole, repeated rows each; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b)
        for part in slices(batches, 1):
            numbers, groups, _ = known.align(part.column(1))
            columns = [part.column(0), *map(pa.array, numbers.T), pa.array(groups, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", *_NUMBERS, "groups"])

    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return read.mapInArrow(run, f"_id {kind}, {', '.join(f'{c} long' for c in _NUMBERS)}, groups string").withColumnRenamed("_id", id_col)


def _packed(nth: np.ndarray, times: np.ndarray) -> bytes:
    """Rising numbers and how often each stands, in few bytes."""
    flat = np.concatenate((np.diff(nth, prepend=0), times)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return pa.compress(np.ascontiguousarray(flat.T).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(packed, size * 16, "zstd", asbytes=True)
    flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)
    return np.cumsum(flat[:size]), flat[size:]


def _blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Documents with their links packed, and after those of each block a row of its pairs and how many documents hold each."""
    fields = {"_block": pa.int64(), "_id": None, **dict.fromkeys(_NUMBERS, pa.int64()), "_sha": pa.string(), "_held": pa.int64(), "_links": pa.binary(), "_pairs": pa.list_(pa.int64()), "_docs": pa.list_(pa.int64())}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        ids, parts = [], []
        used = rows = 0

        def written() -> Iterator[pa.RecordBatch]:
            distinct, to = np.unique(np.concatenate([p[2][0] for p in parts]), return_inverse=True)
            holders = np.zeros(len(distinct), np.int64)
            at = 0
            for own, (numbers, shas, (here, nth, times, ends)) in zip(ids, parts, strict=True):
                nth = to[at : at + len(here)][nth]
                at += len(here)
                holders += np.bincount(nth, minlength=len(distinct))
                starts = np.concatenate(([0], ends[:-1]))
                links = [_packed(nth[i:k], times[i:k]) for i, k in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(np.full(len(own), number)), own, *map(pa.array, numbers.T), pa.array(shas, pa.string()), pa.array(ends - starts), pa.array(links, pa.binary()), *(pa.nulls(len(own), fields[c]) for c in ("_pairs", "_docs"))]
                yield pa.RecordBatch.from_arrays(columns, names=list(fields))
            last = [pa.array([number]), pa.nulls(1, ids[0].type), *(pa.nulls(1, fields[c]) for c in [*_NUMBERS, "_sha", "_held", "_links"]), pa.array([distinct], fields["_pairs"]), pa.array([holders], fields["_docs"])]
            yield pa.RecordBatch.from_arrays(last, names=list(fields))

        for part in slices(batches, 1):
            ids.append(part.column(0))
            numbers, groups, pairs = known.align(part.column(1))
            parts.append((numbers, [sha256(g).hexdigest() if g else "" for g in groups], pairs))
            used, rows = used + (pc.sum(pc.binary_length(part.column(1))).as_py() or 0), rows + part.num_rows
            if used >= BLOCK_BYTES or rows >= BLOCK_DOCS:
                yield from written()
                ids, parts, used, rows, number = [], [], 0, 0, number + 1
        if ids:
            yield from written()

    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_block long, _id {kind}, {', '.join(f'{c} long' for c in _NUMBERS)}, _sha string, _held long, _links binary, _pairs array<long>, _docs array<long>"
    return materialise(read.mapInArrow(run, schema), "aligned")


def score_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`align_documents`, with the SHA-256 of ``groups`` in their place, and ``n_best, count_sum`` of links by corpus counts.

    An id pair counts the documents (rows) in which it is linked; ``count_sum`` adds up the
    counts of a document's links, ``n_best`` is how many have the highest count of any pair
    of their first id.  Documents without tokens have zeros and an empty hash; an empty
    table gives no rows.

    Blocks are written once.  Their distinct pairs are summed up, meet the totals by pair
    and return to their block, whose documents look them up: no key has more rows than
    there are blocks, and no task holds more than one block.
    """
    blocks = _blocks(docs, path_a, path_b, id_col, text_col)
    named = blocks.where(F.col("_pairs").isNotNull()).select("_block", F.posexplode(F.arrays_zip("_pairs", "_docs")).alias("_nth", "_p")).select("_block", "_nth", F.col("_p._pairs").alias("_pair"), F.col("_p._docs").alias("_docs"))
    counts = materialise(named.groupBy("_pair").agg(F.sum("_docs").alias("_count")).withColumn("_a", F.shiftright("_pair", 32)), "pair-counts")
    highest = counts.groupBy("_a").agg(F.max("_count").alias("_most"))
    totals = counts.join(highest, "_a").select("_pair", "_count", (F.col("_count") == F.col("_most")).alias("_best"))
    told = named.join(totals, "_pair").select("_block", "_nth", "_count", "_best")

    def add_up(mine: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, bool)
        nth = pairs["_nth"].to_numpy()
        count[nth], best[nth] = pairs["_count"].to_numpy(), pairs["_best"].to_numpy()
        n_best, sums = [], []
        for packed, size in zip(mine["_links"].to_pylist(), mine["_held"].to_pylist(), strict=True):
            held, times = _unpacked(packed, size)
            n_best.append(int(times[best[held]].sum()))
            sums.append(int((times * count[held]).sum()))
        return mine.select(["_id", *_NUMBERS, "_sha"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    mine = blocks.where(F.col("_links").isNotNull()).select(F.col("_block").alias("_in"), "_id", *_NUMBERS, "_sha", "_held", "_links")
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, {', '.join(f'{c} long' for c in _NUMBERS)}, _sha string, n_best long, count_sum long"
    out = mine.groupBy("_in").cogroup(told.groupBy("_block")).applyInArrow(add_up, schema)
    return out.select(F.col("_id").alias(id_col), *_NUMBERS, "n_best", "count_sum", F.col("_sha").alias("groups_sha256"))

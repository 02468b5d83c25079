"""Exact top-k inner products by an impact-ordered index, score at a time.

Components are whole numbers (``floor(scale * x)``).  Candidates lie in blocks; a block's
index, written once, holds posting segments: for each dimension the vectors and values of one
quantised impact, the least l with ``|value| <= 2**l``, by falling impact.  A query takes the
segments of all dimensions by falling ``|query component| * 2**l`` and adds them to the scores
of their vectors.  After each stage all postings that are left have products below a known
limit, so a vector's score is off by no more than that limit times the number of its postings
that are left.  Vectors whose best possible score is below the k-th best certain one are
out.  Work stops when few possible members remain, and these are scored exactly: the result
is the exact top-k whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Vectors per block of candidates and of queries.
BLOCK, QUERIES = 16384, 2048
#: The first stage takes impacts down to the largest one's 2**-FIRST, each other stage down to half of the last.
FIRST = 7
#: Share of a block that may still be possible when segments are left for exact scores.
FEW = 0.05
#: Segments that hold at least this part of a block's vectors are kept as columns over all of them.
DENSE = 1 / 16


def quantise(matrix: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * x)`` in double precision."""
    return np.floor(matrix.astype(np.float64) * scale)


def impact(values: np.ndarray) -> np.ndarray:
    """The least l with ``|value| <= 2**l`` of whole numbers other than 0, -1 of 0."""
    size = np.abs(values)
    fraction, power = np.frexp(size)
    return np.where(size == 0, -1, power - (fraction == 0.5)).astype(np.int8)


def postings_of(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posting segments of whole-number vectors: ``dims, levels, vectors, values``, by dimension, then falling impact, then vector."""
    level = impact(matrix)
    vector, dim = np.nonzero(matrix)
    order = np.lexsort((vector, -level[vector, dim].astype(np.int64), dim))
    vector, dim = vector[order], dim[order]
    return dim.astype("<u2"), level[vector, dim].astype("i1"), vector.astype("<u2"), matrix[vector, dim].astype("<i8")


class BlockIndex:
    """Posting segments of one block, as they were written."""

    def __init__(self, ids: np.ndarray, n_dims: int, dims: np.ndarray, levels: np.ndarray, vectors: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.n = ids, len(ids)
        self.matrix = np.zeros((self.n, n_dims))
        self.matrix[vectors, dims] = values
        self.norm = float(np.sqrt((self.matrix**2).sum(1)).max(initial=0))
        self.held = np.bincount(vectors, minlength=self.n).astype(np.uint8 if n_dims < 256 else np.uint16)
        self.vectors, self.values = vectors.astype(np.int64), values.astype(np.float64)
        self.top = int(levels.max(initial=0))
        # place in the postings at which those of a dimension with a falling impact end, by dimension and impact
        first = np.searchsorted(dims, np.arange(n_dims + 1))
        self.first = first[:-1]
        self.ends = np.zeros((n_dims, self.top + 2), np.int64)
        for d in range(n_dims):
            own = -levels[first[d] : first[d + 1]].astype(np.int64)
            self.ends[d] = first[d] + np.searchsorted(own, -np.arange(self.top + 2), "right")
        self._columns: dict[tuple[int, int, type], tuple[np.ndarray, np.ndarray]] = {}
        #: Products of a query's and a posting's value so far, and those of a scan of all.
        self.multiplied = self.scanned = 0

    def _column(self, a: int, b: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Segments of one dimension as a column over all vectors, and which of them have a posting there."""
        found = self._columns.get((a, b, kind))
        if found is None:
            column, mark = np.zeros(self.n, kind), np.zeros(self.n, self.held.dtype)
            column[self.vectors[a:b]], mark[self.vectors[a:b]] = self.values[a:b], 1
            found = self._columns[a, b, kind] = column, mark
        return found

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its best ``k`` in this block, without itself."""
        largest = self.norm * float(np.sqrt((queries**2).sum(1)).max(initial=0))
        # all sums of products are whole and no larger than the norms' product, so single precision is exact below 2**24
        kind = np.float32 if largest < 2**24 else np.float64
        for query, key in zip(queries, query_ids.tolist(), strict=True):
            yield key, *self._search(query, self.ids == key, k, kind)

    def _search(self, q: np.ndarray, own: np.ndarray, k: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        self.scanned += int(self.held.sum(dtype=np.int64))
        dims = np.flatnonzero(q)
        power = np.log2(np.abs(q[dims]))
        score, left, room = np.zeros(self.n, kind), self.held.copy(), np.empty(self.n, kind)
        at = self.first[dims]
        # a posting of impact l is taken once |q| * 2**l is above 2**limit; below 1 none is left
        limit = int(np.ceil(float(power.max(initial=0)) + self.top)) - FIRST
        possible = ~own
        while True:
            least = np.floor(limit - power).astype(np.int64) + 1 if limit >= 0 else np.zeros(len(dims), np.int64)
            ends = np.where(least > self.top, at, self.ends[dims, np.clip(least, 0, self.top + 1)])
            for d, a, b in zip(dims.tolist(), at.tolist(), ends.tolist(), strict=True):
                if b - a >= DENSE * self.n:
                    column, mark = self._column(a, b, kind)
                    np.multiply(column, kind(q[d]), out=room)
                    score += room
                    left -= mark
                elif b > a:
                    score[self.vectors[a:b]] += kind(q[d]) * self.values[a:b].astype(kind)
                    left[self.vectors[a:b]] -= 1
            self.multiplied += int((ends - at).sum())
            at = ends
            if limit < 0:
                break
            # what is left of a vector can't add more than this to its score, or take from it
            slack = left * kind(2.0**limit)
            if 2 * float(slack.mean()) < float(score.max()) - float(score.mean()) or self.n <= k:
                low = score - slack
                low[own] = -np.inf
                kth = np.partition(low, -k)[-k] if self.n > k else -np.inf
                possible = (score + slack >= kth) & ~own
                if int(possible.sum()) <= max(FEW * self.n, 2 * k):
                    break
            limit -= 1
        some = np.flatnonzero(possible)
        if limit >= 0:
            self.multiplied += int(self.held[some].sum(dtype=np.int64))
            found = self.matrix[some] @ q
        else:
            found = score[some].astype(np.float64)
        if len(some) > k:
            floor = np.partition(found, -k)[-k]
            some, found = some[found >= floor], found[found >= floor]
        best = np.lexsort((self.ids[some], -found))[:k]
        return self.ids[some[best]], found[best].astype(np.int64)


def usable(id_col: str, vector_col: str) -> Column:
    """Rows with an id and a vector of finite components."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite


def _blocks(batches: Iterator[pa.RecordBatch], scale: float, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors of up to ``size`` rows together, by id."""

    def block(ids: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        names, matrix = np.concatenate(ids), np.concatenate(parts)
        order = np.lexsort((*matrix.T[::-1], names))  # so that retries make the same blocks
        return names[order], matrix[order]

    ids: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    held = 0
    for batch in batches:
        names = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        vectors = batch.column(1)
        sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
        if parts:
            sizes = np.union1d(sizes, [parts[0].shape[1]])
        if len(sizes) > 1:
            raise ValueError(f"vectors of {sizes[0]} and {sizes[-1]} components can't be compared")
        matrix = quantise(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1), scale)
        for at in range(0, len(names), size):
            ids.append(names[at : at + size])
            parts.append(matrix[at : at + size])
            held += len(ids[-1])
            if held >= size:
                yield block(ids, parts)
                ids, parts, held = [], [], 0
    if held:
        yield block(ids, parts)


def _bytes(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def build_index(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Posting segments of all usable rows, written to the shared folder: one row per block, ``ids, n_dims, dims, levels, vectors, values``."""
    rows = vectors.where(usable(id_col, vector_col)).select(id_col, F.col(vector_col).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in _blocks(batches, scale, BLOCK):
            ids, *postings = _bytes(ids, *postings_of(matrix))
            yield pa.RecordBatch.from_arrays([ids, pa.array([matrix.shape[1]], pa.int32()), *postings], ["ids", "n_dims", "dims", "levels", "vectors", "values"])

    dealt = rows.repartition(max(1, -(-rows.count() // BLOCK)))
    return materialise(dealt.mapInArrow(run, "ids binary, n_dims int, dims binary, levels binary, vectors binary, values binary"), "impact-index")


def search_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", index: DataFrame | None = None
) -> DataFrame:
    """The ``k`` highest whole-number inner products of each query: ``query_id, rank, vec_id, score``.

    Ties go to the smaller id; a query's own id is no candidate; fewer candidates give fewer
    rows.  Rows with a null id, a null vector, or null or non-finite components take no part;
    vectors of different lengths are an error; an empty table gives no rows; a repeated
    candidate counts each time, a repeated query has its rows each time; other columns are
    not read.  Exact while ``dim * max |value|**2`` stays below 2**53.  ``index`` is that of
    ``vectors`` from an earlier :func:`build_index`, if there is one.

    Blocks of candidates meet blocks of queries, both of bounded size, so memory is bounded
    and a table with any number of equal vectors is dealt evenly.  Only ``k`` rows per query
    and block are shuffled.
    """
    index = build_index(vectors, scale, id_col, vector_col) if index is None else index
    rows = queries.where(usable(id_col, vector_col)).select(id_col, F.col(vector_col).cast("array<double>"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in _blocks(batches, scale, QUERIES):
            ids, matrix_ = _bytes(ids, matrix.astype("<f8"))
            yield pa.RecordBatch.from_arrays([ids, pa.array([matrix.shape[1]], pa.int32()), matrix_], ["_ids", "_dims", "_data"])

    asked = materialise(rows.repartition(max(1, -(-rows.count() // QUERIES))).mapInArrow(blocks, "_ids binary, _dims int, _data binary"), "impact-queries")
    # the stated queries against all rows, block by block: a row of this product is a pair of blocks
    pairs = index.repartition(max(1, index.count())).crossJoin(asked.withColumn("_block", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, BlockIndex] | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n_dims, dims, levels, members, values, q_ids, q_dims, q_data, q_block = (batch.column(c)[row].as_py() for c in range(10))
                if n_dims != q_dims:
                    raise ValueError(f"vectors of {n_dims} and {q_dims} components can't be compared")
                if held is None or held[0] != ids:
                    held = ids, BlockIndex(np.frombuffer(ids, "<i8"), n_dims, np.frombuffer(dims, "<u2"), np.frombuffer(levels, "i1"), np.frombuffer(members, "<u2"), np.frombuffer(values, "<i8"))
                asked_ids = np.frombuffer(q_ids, "<i8")
                found = list(held[1].search(np.frombuffer(q_data, "<f8").reshape(-1, n_dims), asked_ids, k))
                counts = [len(x[1]) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_block * QUERIES + np.arange(len(found)), counts)),
                        pa.array(np.repeat(asked_ids, counts)),
                        pa.array(np.concatenate([x[1] for x in found])),
                        pa.array(np.concatenate([x[2] for x in found])),
                    ],
                    ["_q", "query_id", "vec_id", "score"],
                )

    found = pairs.mapInArrow(run, "_q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

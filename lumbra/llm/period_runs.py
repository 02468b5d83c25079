"""Stretches of a text that repeat a sequence of words: maximal repetitions, by an enhanced suffix array.

The texts of a slice have one suffix array, in which each text's suffixes are neighbours as
no two texts share a code.  Prefix doubling sorts only suffixes not told apart yet and keeps
the ranks by the first 1, 2, 4, ... words, from which the common prefix or suffix of any two
places is read in as many steps.  Intervals of the array whose suffixes share ``depth`` words
come from next smaller values of the LCP array; a suffix ``i`` of a smaller child is asked
whether ``ISA[i + depth]`` or ``ISA[i - depth]`` lies in the interval but in another child.
If so, a square of two times ``depth`` words ends where its repetition ends; rotated to the
left as far as words agree it gives the whole run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

_RUNS = "array<struct<start: long, length: long, period: long>>"


class _Codes(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def word_codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts, a last code of its own after each, and where each text starts.

    Equal words of one text have equal codes; those of two texts never have.
    """
    known = _Codes()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    words = np.fromiter((known[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    codes = np.full(starts[-1], len(known), np.int64)
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    codes[inside] = words
    return codes + np.repeat(np.arange(len(texts)), sizes + 1) * (len(known) + 1), starts


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the rank of each by its first 1, 2, 4, ... codes: the least place of those that share them.

    The last rank array has no equal ranks.  Codes must be such that one that stands at the
    end of ``codes``, and so a suffix that holds it, has no equal.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    slots, suffixes, keys = np.arange(n), order, codes[order]
    rank, ranks, width = np.zeros(n, np.int64), [], 1
    while True:
        head = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = np.flatnonzero(head)
        rank[suffixes] = np.repeat(slots[first], np.diff(np.append(first, len(head))))
        ranks.append(rank.astype(np.int32 if n < 2**31 else np.int64))
        alone = head & np.append(head[1:], True)
        slots, suffixes = slots[~alone], suffixes[~alone]
        if not len(slots):
            return order, ranks
        keys = rank[suffixes] * n + rank[suffixes + width]
        by = np.argsort(keys, kind="stable")
        suffixes, keys = suffixes[by], keys[by]
        order[slots] = suffixes
        width *= 2


def common_prefix(ranks: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many codes from places ``x`` on equal those from other places ``y`` on."""
    x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        step = (ranks[k][x] == ranks[k][y]).astype(np.int64) << k
        x, y, out = x + step, y + step, out + step
    return out


def common_suffix(ranks: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many codes before places ``x`` equal those before places ``y``, which are greater."""
    x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        back = x - (1 << k)
        step = ((back >= 0) & (ranks[k][back] == ranks[k][y - (1 << k)])).astype(np.int64) << k
        x, y, out = x - step, y - step, out + step
    return out


def _next(values: np.ndarray, ask: np.ndarray, way: int, equal: bool) -> np.ndarray:
    """For the places ``ask``: the nearest to the right (``way`` 1) or left (-1) of a smaller value, or an equal one too.

    Pointers jump along each other's: those still on too large a value take its pointer.
    The first and last value must be smaller than all asked for.
    """
    at = np.arange(len(values)) + way
    far = np.greater if equal else np.greater_equal
    while len(ask):
        ask = ask[far(values[at[ask]], values[ask])]
        at[ask] = at[at[ask]]
    return at


def branching_squares(codes: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Places ``i`` and depths ``d`` where codes from ``i`` and ``i + d`` agree for exactly ``d``, and the ranks.

    Only among suffixes that begin with the same code as two that share ``least`` codes.
    """
    order, ranks = suffix_order(codes)
    n = len(codes)
    place = ranks[-1].astype(np.int64)
    lcp = np.zeros(n + 1, np.int64)
    alike = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    lcp[alike] = common_prefix(ranks, order[alike - 1], order[alike])
    bounds = np.flatnonzero(lcp == 0)
    rich = np.maximum.reduceat(lcp, bounds) >= least
    asked = alike[rich[np.searchsorted(bounds, alike, "right") - 1]]
    if not len(asked):
        return asked, asked, ranks

    depth = lcp[asked]
    left = _next(lcp, asked, -1, False)[asked]
    right = _next(lcp, asked, 1, False)[asked]
    follow = _next(lcp, asked, 1, True)
    # the interval of each boundary, named by its first one
    own = np.arange(n + 1)
    more = asked[lcp[follow[asked]] == depth]
    own[follow[more]] = more
    name = own.copy()
    while not np.array_equal(after := name[name], name):
        name = after
    first = own[asked] == asked
    # children: from each boundary to the next of its interval, and before the first one
    lo = np.concatenate((asked, left[first]))
    hi = np.concatenate((follow[asked], asked[first]))
    of = np.concatenate((name[asked], asked[first]))
    deep, low, high = (np.concatenate((v, v[first])) for v in (depth, left, right))
    size = hi - lo
    most = np.zeros(n + 1, np.int64)
    np.maximum.at(most, of, size)
    largest = np.full(n + 1, -1)
    top = np.flatnonzero(size == most[of])
    largest[of[top]] = top
    small = np.flatnonzero(largest[of] != np.arange(len(of)))
    big = largest[of[small]]

    # each suffix of a smaller child, with its child's and interval's bounds
    of_child = np.repeat(np.arange(len(small)), size[small])
    at = np.arange(len(of_child)) + np.repeat(lo[small] - (np.cumsum(size[small]) - size[small]), size[small])
    child, i = small[of_child], order[at]
    d = deep[child]
    ahead, back = i + d, i - d
    seen = place[np.minimum(ahead, n - 1)]
    after = (ahead < n) & (seen >= low[child]) & (seen < high[child]) & ((seen < lo[child]) | (seen >= hi[child]))
    seen, big = place[np.maximum(back, 0)], big[of_child]
    before = (back >= 0) & (seen >= lo[big]) & (seen < hi[big])
    return np.concatenate((i[after], back[before])), np.concatenate((d[after], d[before])), ranks


def maximal_runs(codes: np.ndarray, min_words: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run of at least ``min_words`` and two periods, by start, then period.

    The square at the end of a run is one of its turns that begin alike, the first two of
    which share all but what is left of a whole number of periods and one period: codes
    without so long a repeat are passed over.
    """
    i, d, ranks = branching_squares(codes, min((min_words // p * p - p for p in range(1, min_words // 2 + 1)), default=1))
    turned = common_suffix(ranks, i, i + d)
    start, length = i - turned, 2 * d + turned
    long = length >= min_words
    start, length, d = start[long], length[long], d[long]
    by = np.lexsort((d, length, start))
    start, length, d = start[by], length[by], d[by]
    # one stretch repeats by multiples of its smallest period too
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))[: len(start)]
    start, length, d = start[new], length[new], d[new]
    by = np.lexsort((d, start))
    return start[by], length[by], d[by]


def _found(texts: list[bytes | None], min_words: int) -> tuple[list[int], list[list[dict]], list[bytes]]:
    """Numbers of words, runs and collapsed texts of a slice."""
    words = [(t or b"").split() for t in texts]
    codes, starts = word_codes(words)
    start, length, period = maximal_runs(codes, min_words)
    of = np.searchsorted(starts, start, "right") - 1
    runs: list[list[dict]] = [[] for _ in texts]
    for k, s, n, p in zip(of.tolist(), (start - starts[of]).tolist(), length.tolist(), period.tolist(), strict=True):
        runs[k].append({"start": s, "length": n, "period": p})
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    stays = np.cumsum(edges) == 0
    collapsed = [b" ".join(compress(w, stays[starts[k] : starts[k + 1]]) if runs[k] else w) for k, w in enumerate(words)]
    return [len(w) for w in words], runs, collapsed


def find_runs(docs: DataFrame, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``runs`` and the ``collapsed`` text.

    Words are the longest runs of anything but ASCII white space, numbered from 0.  A run is
    a stretch of at least ``min_words`` words and two periods whose words one smallest period
    apart are equal, as long as it can be made; ``runs`` has ``start, length, period`` by
    start, then period.  ``collapsed`` is the text, its words joined by single spaces, without
    those that a run holds after its first period.

    Null and empty texts have no words and an empty ``collapsed``; repeated rows are found
    each; other columns, whatever their names, are not read; an empty table gives no rows.
    Nothing is shuffled; texts are read whole, in slices of bounded bytes, and memory follows
    the longest one: some 150 bytes a word, and four more for each doubling of its longest repeat.
    """
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, n_words long, runs {_RUNS}, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            n_words, runs, collapsed = _found(part.column(1).cast(pa.binary()).to_pylist(), min_words)
            columns = [part.column(0), pa.array(n_words, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_words", "runs", "collapsed"])

    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return read.mapInArrow(run, schema).withColumnRenamed("_id", id_col)

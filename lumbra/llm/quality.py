"""Quality classifier by co-training two views of a document: its text and its page metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .batches import slices
from .storage import materialise
from .tokens import cut_at_spaces, forget_encoder

#: Documents with a label that the classifiers are fitted on at most, unless told otherwise.
MAX_LABELLED = 4000
#: Rounds of exchange, pseudo-labels per round and view, and the certainty these need.
ROUNDS, EXCHANGED, CERTAIN = 3, 400, 0.95
#: A good document that the threshold costs weighs as much as so many bad ones that it rejects, by shares of their classes.
WORTH = 4.0

#: Bytes of texts, and rows, that are turned into views together: a row takes a kilobyte of floats several times over, however short its text.
SLICE, ROWS = 512 << 10, 512

TRIGRAMS, TEXT_EXTRA = 1024, 14
SOURCES, LANGS, CROSSED, SIZES = 64, 16, 128, 24
_TEXT, _PAGE = TRIGRAMS + TEXT_EXTRA, SOURCES + LANGS + CROSSED + SIZES + 2

#: Kind of each byte: 0 others, 1 blanks, 2 capitals, 3 digits, 4 signs of sentences, 5 other signs.
_KIND = np.zeros(256, np.int64)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _KIND[_c] = 4 if _c in b".,;:'\"()-?" else 5


def _repeated(parts: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document's parts: how many differ, how often the most frequent occurs, and how many equal the one before."""
    codes = parts.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    again = np.bincount(owner[1:][(codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])], minlength=len(counts))
    keys, times = np.unique(owner * (int(codes.max(initial=0)) + 1) + codes, return_counts=True)
    of = keys // (int(codes.max(initial=0)) + 1)
    most = np.zeros(len(counts), np.int64)
    np.maximum.at(most, of, times)
    return np.bincount(of, minlength=len(counts)), most, again


def text_views(texts: pa.Array) -> np.ndarray:
    """Content: hashed frequencies of byte trigrams, how repetitive trigrams, words and lines are, and kinds of bytes.  Null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    out = np.zeros((n, _TEXT), np.float32)
    if not n:
        return out
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    size = np.diff(ends)
    raw = np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0])) if size.sum() else np.zeros(0, np.uint8)
    owner = np.repeat(np.arange(n), size)
    if len(raw) > 2:
        wide = raw.astype(np.uint32)
        hashed = ((wide[:-2] * np.uint32(65536) + wide[1:-1] * np.uint32(256) + wide[2:]) * np.uint32(2654435761)) >> np.uint32(22)
        inside = owner[2:] == owner[:-2]
        share = np.bincount(owner[2:][inside] * TRIGRAMS + hashed[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS) / np.maximum(size - 2, 1)[:, None]
        out[:, :TRIGRAMS] = np.sqrt(share)
        out[:, TRIGRAMS] = -(share * np.log(np.where(share > 0, share, 1))).sum(1) / np.log(TRIGRAMS)
        out[:, TRIGRAMS + 1] = share.max(1)
    parts, counts = cut_at_spaces(texts)
    differ, most, again = _repeated(parts, counts)
    some = np.maximum(counts, 1)
    lines = pc.split_pattern(texts, "\n")
    n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = np.bincount(owner * 6 + _KIND[raw], minlength=6 * n).reshape(n, 6) / np.maximum(size, 1)[:, None]
    extra = [differ / some, most / some, again / some, np.minimum(counts, 50) / 50, np.log1p(n_lines) / 6, np.log1p(size / n_lines) / 8, _repeated(lines.flatten(), n_lines)[0] / n_lines]
    out[:, TRIGRAMS + 2 :] = np.stack([*extra, *kinds.T[1:]], axis=1)
    return out


def page_view(source: object, lang: object, n_chars: object) -> np.ndarray:
    """Metadata alone: source, language, both together, and the stated size."""
    out = np.zeros(_PAGE, np.float32)
    out[xxh3_64_intdigest(str(source)) % SOURCES] = 1
    out[SOURCES + xxh3_64_intdigest(str(lang)) % LANGS] = 1
    at = SOURCES + LANGS
    out[at + xxh3_64_intdigest(f"{source}\0{lang}") % CROSSED] = 1
    at += CROSSED
    if n_chars is None:
        out[at + SIZES] = 1
    else:
        size = np.log1p(max(0.0, float(n_chars)))
        out[at + min(SIZES - 1, int(2 * size))] = 1
        out[at + SIZES + 1] = size / 12
    return out


@dataclass
class Linear:
    """Logistic regression on standardised features, calibrated by a line over its log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    line: tuple[float, float] = (1.0, 0.0)

    def odds(self, x: np.ndarray) -> np.ndarray:
        slope = self.weights / self.scale
        raw = x @ slope + (self.bias - self.mean @ slope)
        return np.clip(raw * self.line[0] + self.line[1], -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Rows that are multiplied, and columns whose spread is taken, together: the driver holds the features once, and copies of so many of them.
_TILE, _STRIP = 256, 64


def _times(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``z @ w`` in the precision of ``w``, without all of ``z`` in it."""
    return np.concatenate([z[k : k + _TILE] @ w for k in range(0, len(z), _TILE)]) if len(z) else z @ w


def _summed(z: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """``z.T @ gap`` in the precision of ``gap``, without all of ``z`` in it."""
    out = np.zeros(z.shape[1], np.result_type(z, gap))
    for k in range(0, len(z), _TILE):
        out += z[k : k + _TILE].T @ gap[k : k + _TILE]
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 300, spend: bool = False) -> Linear:
    """Weighted logistic regression by accelerated gradient steps; with ``spend``, ``x`` itself is standardised, and no copy."""
    mean = x.mean(0)
    spread = [x[:, k : k + _STRIP].std(0) for k in range(0, x.shape[1], _STRIP)]
    scale = np.maximum(np.concatenate(spread), 1e-3)
    z = np.subtract(x, mean, out=x if spend else None)
    z /= scale
    z = z.astype(np.float32, copy=False)
    w, b = np.zeros(z.shape[1], np.float32), float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    weight = (weight / weight.sum()).astype(np.float32)
    # the curvature is at most a quarter of the largest eigenvalue, which a few power steps give
    v = np.ones(z.shape[1], np.float32)
    for _ in range(10):
        v = z.T @ (weight * (z @ v))
        v /= max(float(np.linalg.norm(v)), 1e-9)
    rate = 1 / (0.3 * (float(np.linalg.norm(z.T @ (weight * (z @ v)))) + 1) + ridge)
    seen_w, seen_b = w, b
    for t in range(steps):
        gap = weight * (_sigmoid(_times(z, seen_w) + seen_b) - y)
        new_w, new_b = seen_w - rate * (_summed(z, gap) + ridge * seen_w), seen_b - rate * float(gap.sum())
        pull = t / (t + 3)
        seen_w, seen_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w, new_b
    return Linear(mean.astype(np.float32), scale.astype(np.float32), w, b)


def calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Line over log odds that fits held-out labels (Platt's targets)."""
    line = fit(odds[:, None], np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)), np.ones(len(y)))
    slope = float(line.weights[0] / line.scale[0])
    return max(slope, 1e-3), line.bias - float(line.mean[0]) * slope


def cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The threshold by which the share of bad rejected less ``WORTH`` times the share of good rejected is largest.

    One document moves this by its part of its class only, so no outlier or wrong label sets
    the threshold.  It lies halfway between neighbouring scores; of equals the lowest is taken.
    """
    order = np.argsort(scores, kind="stable")
    s, bad = scores[order], y[order] == 0
    gain = np.concatenate(([0.0], np.cumsum(np.where(bad, 1 / max(1, bad.sum()), -WORTH / max(1, (~bad).sum())))))
    edges = np.concatenate(([0.0], (s[:-1] + s[1:]) / 2, [1.0]))
    gain[1:-1][s[:-1] == s[1:]] = -np.inf
    return float(edges[int(np.argmax(gain))])


@dataclass
class QualityModel:
    """Both views' classifiers, how to combine them, and the score below which documents are rejected."""

    views: list[Linear] = field(default_factory=list)
    combine: tuple[float, float, float] = (1.0, 1.0, 0.0)
    threshold: float = 0.0

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of good quality by text, by page and by both."""
        if not self.views:
            ones = np.ones(len(text))
            return ones, ones, ones
        a, b = self.views[0].odds(text), self.views[1].odds(page)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2])


#: Features of documents that a view has been given, and their labels.
Given = tuple[np.ndarray, np.ndarray]


def co_train(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, exchange: Callable[[list[Linear], list[int]], list[Given]], rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> QualityModel:
    """Train both views; each gives the other its most certain labels of unlabelled documents, round by round.

    ``held`` flags labelled rows kept for calibration, combination and the threshold;
    ``exchange`` takes both models and how many bad and good documents to label, and returns
    what each view is given anew.
    """
    learn, n = ~held, int((~held).sum())
    given = [[(v[:0], y[:0])] for v in views]
    good = y[learn].mean()
    models: list[Linear] = []
    for r in range(rounds + 1):
        models = []
        for k in (0, 1):
            told = np.concatenate([t for _, t in given[k]])
            x = np.empty((n + len(told), views[k].shape[1]), views[k].dtype)
            np.take(views[k], np.flatnonzero(learn), axis=0, out=x[:n], mode="clip")  # any other mode makes a copy first
            np.concatenate([v for v, _ in given[k]], out=x[n:])
            model = fit(x, np.concatenate([y[learn], told]), np.concatenate([np.ones(n), np.full(len(told), 0.5)]), spend=True)
            del x
            model.line = calibrate(model.odds(views[k][held]), y[held])
            models.append(model)
        if r == rounds:
            break
        new = exchange(models, [int(exchanged * (1 - good)) + 1, int(exchanged * good) + 1])
        for k in (0, 1):
            given[k].append(new[k])
        if not any(len(told) for _, told in new):
            break
    odds = np.stack([models[k].odds(views[k][held]) for k in (0, 1)], axis=1)
    both = fit(odds, y[held], np.ones(held.sum()))
    slopes = np.maximum(both.weights / both.scale, 0)
    model = QualityModel(models, (float(slopes[0]), float(slopes[1]), float(both.bias - (both.mean * slopes).sum())))
    # what is likelier good than bad stays, whatever a few held-out labels would gain
    model.threshold = min(0.5, cut(model.scores(views[0][held], views[1][held])[2], y[held]))
    return model


_FIELDS = ("source", "lang", "n_chars")


def _portions(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in portions of at most ``ROWS`` rows and ``SLICE`` bytes of text (or one row)."""
    forget_encoder()  # a worker that has tokenised before needs its memory
    for part in slices(batches, text_col, SLICE):
        yield from (part.slice(k, ROWS) for k in range(0, part.num_rows, ROWS))


def _views(batch: pa.RecordBatch, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch's rows; metadata that it lacks counts as null."""
    names = batch.schema.names
    meta = [batch.column(names.index(c)).to_pylist() if c in names else [None] * batch.num_rows for c in _FIELDS]
    page = [page_view(*x) for x in zip(*meta, strict=True)]
    return text_views(batch.column(names.index(text_col))), np.stack(page) if page else np.zeros((0, _PAGE), np.float32)


def train_quality(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, exchanged: int = EXCHANGED, certain: float = CERTAIN,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> QualityModel:
    """Fit on at most ``max_labelled`` labelled documents, chosen by a hash of their ids, and on pseudo-labels.

    In each of ``rounds`` all unlabelled documents are scored by both views, and the rows of
    the most certain of them, some ``exchanged`` per view, are fetched; nothing else of them
    comes to the driver.  Ids with several labels count as bad if one of them is bad; labels
    of 1 are good, null ones are no labels; of rows of one id the most certain counts.  Null
    ids are not learnt from; null texts count as empty.  Without labels of both kinds, as in
    empty tables, the model accepts all documents with a score of 1.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min((F.col(label_col) == 1).cast("int")).alias("_y"))
    order = F.xxhash64(F.lit(6), F.col(id_col))
    ids = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    known = ids.join(named, id_col).orderBy(order, id_col).limit(max_labelled)
    fields = [text_col, *(c for c in _FIELDS if c in docs.columns and c != text_col)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, text_col):
            a, b = (pa.array([row.tobytes() for row in x], pa.binary()) for x in _views(batch, text_col))
            yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("_y"), batch.column("_to"), a, b], ["_h", "_y", "_to", "a", "b"])

    def fetch(chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Hashes, ``_y, _to`` and both views of the documents of a bounded number of ids.

        Written by the executors and fetched partition by partition, so that the driver's JVM never holds them all.
        """
        rows = docs.select(id_col, *fields).join(F.broadcast(chosen), id_col).select(order.alias("_h"), "_y", "_to", *fields)
        rows = materialise(rows.mapInArrow(features, "_h long, _y int, _to int, a binary, b binary"), "features")
        keys, a, b = [], bytearray(), bytearray()
        for *key, text, page in rows.toLocalIterator():
            keys.append(key)
            a += text
            b += page
        h, y, to = np.array(keys, np.int64).reshape(-1, 3).T
        at = np.lexsort((y, h, to))
        x = [np.frombuffer(a, np.float32).reshape(-1, _TEXT)[at]]
        del a
        x.append(np.frombuffer(b, np.float32).reshape(-1, _PAGE)[at])
        return h[at], y[at], to[at], x

    kind = docs.schema[id_col].dataType.simpleString()
    taken: list[set] = [set(), set()]

    def exchange(models: list[Linear], many: list[int]) -> list[Given]:
        def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _portions(batches, text_col):
                p = [_sigmoid(m.odds(x)) for m, x in zip(models, _views(batch, text_col), strict=True)]
                some = pa.array(np.maximum(np.maximum(p[0], 1 - p[0]), np.maximum(p[1], 1 - p[1])) >= certain)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(float)) for x in p)], [id_col, "_p0", "_p1"]).filter(some)

        scored = docs.where(F.col(id_col).isNotNull()).select(id_col, *fields).mapInArrow(sure, f"`{id_col}` {kind}, _p0 double, _p1 double")
        open_ = materialise(materialise(scored, "certain").join(named, id_col, "left_anti"), "unlabelled")
        told: list[tuple] = []
        for to in (0, 1):
            p, best = F.col(f"_p{1 - to}"), {}
            for value in (0, 1):
                most = F.max(p if value else 1 - p).alias("_c")
                top = open_.groupBy(id_col).agg(most).where(F.col("_c") >= certain).orderBy(F.desc("_c"), order, id_col).limit(many[value] + len(taken[to]))
                fresh = [r[0] for r in top.collect() if r[0] not in taken[to] and r[0] not in best]
                best |= dict.fromkeys(fresh[: many[value]], value)
            taken[to] |= set(best)
            told += [(key, value, to) for key, value in best.items()]
        if not told:
            return [(np.zeros((0, n), np.float32), np.zeros(0)) for n in (_TEXT, _PAGE)]
        _, y, to, x = fetch(docs.sparkSession.createDataFrame(told, f"`{id_col}` {kind}, _y int, _to int"))
        return [(x[k][to == k], y[to == k].astype(float)) for k in (0, 1)]

    h, y, _, x = fetch(known.withColumn("_to", F.lit(0)))
    held = h % 10 < 3
    if min(((y == k) & f).sum() for k in (0, 1) for f in (held, ~held)) == 0:
        return QualityModel()
    return co_train(x, y.astype(float), held, exchange, rounds, exchanged)


def _scoring_fields(docs: DataFrame, text_col: str) -> list[str]:
    return [text_col, *(c for c in _FIELDS if c in docs.columns and c != text_col)]


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``text_score, page_score, score`` (chances of good quality) and ``accepted``.

    Null texts count as empty; whole texts of any length are read; columns of page metadata
    that are missing or null have a value of their own; rows of one id, repeated ones too,
    are scored each; equal rows have equal scores; an empty table gives no rows; other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, text_col):
            a, b, both = model.scores(*_views(batch, text_col))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(s.astype(float)) for s in (a, b, both)), pa.array(both >= model.threshold)], [id_col, "text_score", "page_score", "score", "accepted"])

    rows = docs.select(F.col(id_col).alias("_id"), *_scoring_fields(docs, text_col))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, text_score double, page_score double, score double, accepted boolean")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns as they are; nulls, repeated rows and empty tables as in :func:`score_quality`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, text_col):
            yield batch.filter(pa.array(model.scores(*_views(batch, text_col))[2] >= model.threshold))

    return docs.mapInArrow(run, docs.schema)

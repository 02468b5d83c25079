"""Near-duplicate documents by ProbMinHash, banding and exact verification.

The similarity is the probability Jaccard of weighted shingles: a text's shingles (runs of
five words) weigh their number of occurrences; or the Jaccard index of their shingle sets, if that
is larger.  For texts without repeated shingles both are the same, so only other texts have a
second signature, over the same shingles of weight 1, and are banded by both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .batches import slices
from .components import connected_components
from .storage import materialise
from .tokens import forget_encoder
from .words import hash_words, mix, shingles, words_of

WIDTH, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares one of 25 bands of 5 registers but for a chance of 5e-5.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
_BYTES = 2 * REGISTERS
#: Pairs whose registers agree in a smaller part are not compared: four standard deviations below 0.8,
#: so that a pair of 0.8 is lost as rarely as by banding.
LIKELY = 0.66
#: Bytes of texts whose signatures are computed together; texts per block that meet another block's, and
#: members of a bucket per part that meet another part's: small, so that parts of one large bucket spread evenly.
TOGETHER, BLOCK, PART = 1 << 19, 300, 150
#: Leaders meet the rest of their buckets while a round leaves at most this part of it.
SHRINK = 0.7
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and how often each occurs."""
    return np.unique(shingles(hash_words(words_of(text)), width), return_counts=True)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n x registers) of n weighted sets, given as elements with weight and owner.

    Each element arrives by a Poisson process whose rate is its weight, at a random register
    each time; a register holds the element of its first arrival, so two sets' registers
    agree with the probability Jaccard as chance.  All elements' next arrivals are drawn
    together, and an element stops as soon as its process is later than the latest register
    of its set: no later arrival could change anything.
    """
    first = np.full(n * registers, np.inf)
    holds = np.zeros(n * registers, np.uint64)
    clock = np.zeros(len(elements))
    active = np.arange(len(elements))
    drawn, count = 0, 1
    latest = np.full(n, np.inf)
    while len(active):
        e, o = elements[active], owner[active]
        steps = np.arange(drawn + 1, drawn + count + 1, dtype=np.uint64) * _GOLDEN
        u = mix(e[:, None] + steps[None, :])
        waits = -np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weights[active][:, None]
        at = clock[active][:, None] + np.cumsum(waits, axis=1)
        clock[active] = at[:, -1]
        place = ((mix(u ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        slot = o[:, None] * registers + place.astype(np.int64)
        early = at < latest[o][:, None]
        slot, at, who = slot[early], at[early], np.broadcast_to(e[:, None], early.shape)[early]
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        holds[slot[won]] = who[won]
        latest = first.reshape(n, registers).max(1)
        active = active[clock[active] < latest[o]]
        drawn += count
        count = min(64, 2 * count)
    return holds.reshape(n, registers)


def signatures_of(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes | None]:
    """Short signatures of weighted sets: by weights, then by weights of 1 where some weight is not; None for empty sets."""

    def short(some: list[tuple[np.ndarray, np.ndarray]], plain: bool) -> list[bytes]:
        if not some:
            return []
        elements, weights = np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some]).astype(float)
        weights = np.ones(len(weights)) if plain else weights
        return short_signatures(prob_minhash(elements, weights, np.repeat(np.arange(len(some)), [len(s[0]) for s in some]), len(some)))

    full = [n for n, s in enumerate(sets) if len(s[0])]
    repeating = [n for n in full if sets[n][1].max() > 1]
    out: list[bytes | None] = [None] * len(sets)
    for n, sig in zip(full, short([sets[n] for n in full], False), strict=True):
        out[n] = sig
    for n, sig in zip(repeating, short([sets[n] for n in repeating], True), strict=True):
        out[n] += sig
    return out


def _both(sigs: list[bytes]) -> np.ndarray:
    """Registers of texts by weights and by weights of 1 (n x 2 x registers; n x 1 x registers if none differ)."""
    if all(len(s) == _BYTES for s in sigs):
        return np.frombuffer(b"".join(sigs), "<u2").reshape(-1, 1, REGISTERS)
    return np.frombuffer(b"".join(s if len(s) > _BYTES else s + s for s in sigs), "<u2").reshape(-1, 2, REGISTERS)


def _first_bands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which a text shares a bucket with each of others, by whichever of their signatures."""
    return (a[None, :, None] == b[:, None, :]).reshape(len(b), -1, BANDS, ROWS).all(3).any(1).argmax(1)


def short_signatures(signatures: np.ndarray) -> list[bytes]:
    """Signatures by 16 bits of each register, which differ for different elements but for a chance of 2**-16."""
    return [row.tobytes() for row in (signatures >> np.uint64(48)).astype("<u2")]


def _buckets() -> Column:
    """Structs ``band, bucket`` of the column ``sig``; both signatures of a text share the keys, each of which it has once."""

    def keys(start: int) -> Column:
        key = lambda b: F.xxhash64(F.lit(b), F.substring(F.col("sig"), start + b * 2 * ROWS + 1, 2 * ROWS))
        return F.array(*[F.struct(F.lit(b).alias("band"), key(b).alias("bucket")) for b in range(BANDS)])

    return F.when(F.length("sig") > _BYTES, F.array_distinct(F.concat(keys(0), keys(_BYTES)))).otherwise(keys(0))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the probability Jaccard of two weighted sets and the Jaccard index of their elements.

    They differ only where elements repeat.  With J the sum over common i of
    1 / sum_j max(x_j / x_i, y_j / y_i): in order of x / y, the elements up to i give their y
    and those after it their x, so running sums do.
    """
    common, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(a[0]) + len(b[0]) - len(common))
    x, y = a[1][at].astype(float), b[1][bt].astype(float)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    sum_y = np.cumsum(y) + only_y
    sum_x = x.sum() - np.cumsum(x) + only_x
    return max(plain, float((1.0 / (sum_x / x + sum_y / y)).sum()))


#: Shingles whose common ones are counted by one product of matrices.
_COLUMNS = 4096


def _common(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How many elements each two of some sets have in common (n x n)."""
    owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    _, at, held = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True, return_counts=True)
    shared = held > 1
    column, owner = (np.cumsum(shared) - 1)[at[shared[at]]], owner[shared[at]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)))
    for first in range(0, int(shared.sum()), _COLUMNS):
        some = slice(*np.searchsorted(column, (first, first + _COLUMNS)))
        holds = np.zeros((len(sets), _COLUMNS), np.float32)
        holds[owner[some], column[some] - first] = 1
        total += holds @ holds.T
    return total


def _alike(sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> Callable[[int, int], bool]:
    """Whether two of some sets have a :func:`similarity` of ``threshold`` or above; sets without repeated elements need their common ones only."""
    common, size = _common(sets), np.array([len(s[0]) for s in sets])
    jaccard = common / (size[:, None] + size[None, :] - common)
    repeats = [len(s[1]) > 0 and s[1].max() > 1 for s in sets]
    return lambda i, j: bool(jaccard[i, j] >= threshold or ((repeats[i] or repeats[j]) and similarity(sets[i], sets[j]) >= threshold))


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, ``_th`` (hash of the text), ``tid`` (128-bit identity of its words) and ``sig``.

    Texts without words are identified by the text itself and have no signature.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()  # a worker that has tokenised before needs its memory
        for batch in slices(batches, 2, TOGETHER):
            tids, sets = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                tids.append(xxh3_128_digest(b" ".join(words) if words else b"\0" + text.encode("utf-8", "replace")))
                sets.append(np.unique(shingles(hash_words(words), WIDTH), return_counts=True))
            sigs = signatures_of(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tids, pa.binary()), pa.array(sigs, pa.binary())], [id_col, "_th", "tid", "sig"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, F.xxhash64(text).alias("_th"), text.alias("_text"))
    return materialise(rows.mapInArrow(run, f"`{id_col}` {kind}, _th long, tid binary, sig binary"), "minhash")


def _likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs ``leader, tid`` those whose registers agree often enough, by weights or by weights of 1, to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_both(batch.column(c).to_pylist()) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).mean(2).max(1) >= LIKELY))

    sig = texts.select("tid", "sig")
    both = pairs.join(sig.select(F.col("tid").alias("leader"), F.col("sig").alias("_a")), "leader").join(sig.withColumnRenamed("sig", "_b"), "tid")
    return materialise(both.select("leader", "tid", "_a", "_b").mapInArrow(run, "leader binary, tid binary"), "likely-pairs")


def _texts_of(texts: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``tid, _text`` of some texts (``tid, _p``); of equal rows of ``docs`` one is read.

    Texts are shuffled once, by the hash of row and text, and those that nobody asks for end there.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = lambda i, t: F.xxhash64(F.struct(i.alias("i"), t.alias("t")))
    rows = docs.select(F.col(id_col).alias("_of"), text.alias("_text")).withColumn("_row", key(F.col("_of"), F.xxhash64("_text")))
    pick = texts.select("tid", "_p._id", key(F.col("_p._id"), F.col("_p._th")).alias("_row"))
    met = rows.join(pick.hint("shuffle_hash"), "_row").where(F.col("_of").eqNullSafe(F.col("_id")))
    return materialise(met.select("_row", "tid", "_text").dropDuplicates(["_row", "tid"]).select("tid", "_text"), "wanted-texts")


def _verified(pairs: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """Of distinct pairs ``leader, tid`` those of exact similarity at ``threshold`` or above, as ``a, b``.

    Texts (``bodies``) are dealt to blocks of bounded size by their hash; a group is the pairs
    between two blocks with the texts these need, so a text goes to each group once, not once a pair.
    """
    wanted = pairs.select("tid").unionByName(pairs.select(F.col("leader").alias("tid"))).distinct()
    n = max(1, -(-wanted.count() // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = pairs.select(block(F.col("leader")).alias("x"), block(F.col("tid")).alias("y"), "leader", "tid")
    needed = dealt.select("x", "y", F.explode(F.array("leader", "tid")).alias("tid")).distinct()
    shipped = needed.join(bodies, "tid").select("x", "y", "tid", F.lit(None).cast("binary").alias("other"), "_text")
    rows = shipped.unionByName(dealt.select("x", "y", "tid", F.col("leader").alias("other"), F.lit(None).cast("string").alias("_text")))
    rows = rows.repartition("x", "y").sortWithinPartitions("x", "y", F.col("other").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            a, b = [], []
            for x, y, tid, other, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (x, y):
                    group, held = (x, y), {}
                if other is None:
                    held[tid] = weighted_shingles(text)
                elif similarity(held[tid], held[other]) >= threshold:
                    a.append(other)
                    b.append(tid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return materialise(rows.select("x", "y", "tid", "other", "_text").mapInArrow(run, "a binary, b binary"), "verified")


def _likely_in(group: list[tuple]) -> Iterator[tuple[int, int]]:
    """Places of likely pairs of different components in a group of rows ``bucket, x, y, own, band, tid, root, sig``.

    A pair counts in the first band that it shares, so in one bucket; between two blocks only
    pairs of both count.
    """
    _, x, y, _, band, *_ = group[0]
    roots = np.unique([r[6] for r in group], return_inverse=True)[1]
    if roots.max() == 0:
        return
    sigs = _both([r[7] for r in group])
    side = np.array([r[3] for r in group])
    for i in range(len(group) - 1):
        same = sigs[i + 1 :] == sigs[i]
        keep = (same.mean(2).max(1) >= LIKELY) & (roots[i + 1 :] != roots[i])
        if x != y:
            keep &= side[i + 1 :] != side[i]
        some = i + 1 + np.flatnonzero(keep)
        if len(some):
            for j in some[_first_bands(sigs[i], sigs[some]) == band].tolist():
                yield i, j


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Neighbouring rows of equal ``bucket, x, y``."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[0][:3] != row[:3]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


_ROW = ["bucket", "x", "y", "_own", "band", "tid", "root", "sig"]


def _links_across(members: DataFrame, texts: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame | None:
    """Links ``a, b`` between texts (``bucket, band, tid, root``) of different components in the same buckets, or None.

    All pairs of different components in a bucket are looked at by their registers, in blocks
    of bounded size: a bucket of more texts than a block is dealt to several, those of its
    largest component to blocks of their own, and each two blocks, but for two of the largest
    component, meet in a group of their own.  Texts that have a likely partner there are then brought to the same
    groups and compared exactly; pairs themselves are never written, and what a group has
    connected it doesn't compare again.
    """
    parts = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("_c"))
    sizes = parts.groupBy("bucket").agg(F.sum("_c").alias("_n"), F.max(F.struct("_c", "root")).alias("_most")).where("_n > _most._c")
    one, most, blocks = F.col("_n") <= PART, F.col("_most._c"), lambda n: F.ceil(n / PART).cast("int")
    rest = F.when(one, 1).otherwise(blocks(F.col("_n") - most))
    sizes = materialise(sizes.select("bucket", F.col("_most.root").alias("_main"), rest.alias("_rest"), F.when(one, 0).otherwise(blocks(most)).alias("_more")), "bucket-blocks")
    main, hashed = (F.col("root") == F.col("_main")) & (F.col("_more") > 0), F.xxhash64("tid")
    own = F.when(main, F.col("_rest") + F.pmod(hashed, F.col("_more"))).otherwise(F.pmod(hashed, F.col("_rest"))).cast("int")
    others = F.col("_rest") + F.when(main, 0).otherwise(F.col("_more"))
    dealt = members.join(sizes.hint("shuffle_hash"), "bucket").withColumn("_own", own).withColumn("_k", F.explode(F.sequence(F.lit(0), others - 1)))
    dealt = dealt.select("bucket", F.least("_own", "_k").alias("x"), F.greatest("_own", "_k").alias("y"), "_own", "band", "tid", "root")
    rows = dealt.join(texts.select("tid", "sig"), "tid").select(*_ROW).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "tid")
    kinds = [rows.schema[c].dataType.simpleString() for c in _ROW]

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            some = sorted({k for pair in _likely_in(group) for k in pair})
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([group[k][c] for k in some], t) for c, t in enumerate(_ARROW)], _ROW)

    found = materialise(rows.mapInArrow(partnered, ", ".join(f"{c} {t}" for c, t in zip(_ROW, kinds, strict=True))), "partnered")
    if found.isEmpty():
        return None
    met = found.join(bodies, "tid").select(*_ROW, "_text").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "tid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            pairs = list(_likely_in([r[:8] for r in group]))
            sets = [weighted_shingles(r[8]) for r in group]
            # few pairs are compared one by one
            alike = _alike(sets, threshold) if len(pairs) > len(sets) else lambda i, j, sets=sets: similarity(sets[i], sets[j]) >= threshold
            to: dict[bytes, bytes] = {}

            def root(node: bytes, to: dict[bytes, bytes] = to) -> bytes:
                while node in to:
                    node = to[node]
                return node

            links = []
            for i, j in pairs:
                one, other = root(group[i][6]), root(group[j][6])
                if one != other and alike(i, j):
                    to[max(one, other)] = min(one, other)
                    links.append((group[i][5], group[j][5]))
            yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in links], pa.binary()) for c in (0, 1)], ["a", "b"])

    return materialise(met.mapInArrow(compare, "a binary, b binary"), "links-across")


_ARROW = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _linked(docs: DataFrame, texts: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame | None:
    """``node, root`` of texts that have a near-duplicate, or None if there are none.

    In each bucket (texts with one key) a leader meets all texts that are not connected to it,
    and leaves the bucket: whatever it is not connected to then is not alike.  Leaders are
    those whose buckets hold most texts: copies that were edited in different places share
    buckets with their original rather than with each other, so the original leads and large
    groups of copies become components by as many comparisons as they have members.  Buckets
    of one component are done.  When a round has no longer done away with a good part of what
    was left, the texts of each bucket that are in different components still are compared
    with each other.
    """
    keys = texts.where("sig IS NOT NULL").select("tid", F.inline(_buckets()))
    several = materialise(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "buckets")
    # hash joins throughout: no side is sorted, and plans don't change with the size of a side; a text has two keys a band at most
    fame = (-F.sum("_n").over(Window.partitionBy("tid"))).alias("_fame")
    members = materialise(keys.join(several.hint("shuffle_hash"), "bucket").select("bucket", "band", "tid", fame, F.col("tid").alias("root")), "members")
    texts = materialise(texts.select("tid", "_p", "sig").join(members.select("tid").distinct().hint("shuffle_hash"), "tid", "left_semi"), "found")
    bodies = _texts_of(texts, docs, id_col, text_col)
    roots: DataFrame | None = None
    tops, n = _tops(members)
    while n:
        rest = members.join(tops.hint("shuffle_hash"), "bucket").where(F.col("tid") != F.col("_lead.tid"))
        met = rest.where(F.col("root") != F.col("_lead.root")).select(F.col("_lead.tid").alias("leader"), "tid").distinct()
        likely = _likely(met, texts)
        if not likely.isEmpty():
            roots = _joined(roots, _verified(likely, bodies, threshold))
        members, before = materialise(_rooted(rest.select("bucket", "band", "tid", "_fame", "root"), roots), "rest"), n
        tops, n = _tops(members)
        if n > SHRINK * before:
            more = _links_across(members, texts, bodies, threshold)
            return roots if more is None else _joined(roots, more)
    return roots


def _tops(members: DataFrame) -> tuple[DataFrame, int]:
    """``bucket, _lead, _n`` (leader and members) of buckets in which several roots are left, and how many members these have.

    Written, so that both sides of a join with it are plain shuffles, of which adaptive execution can split a large bucket.
    """
    lead = F.min(F.struct("_fame", "tid", "root")).alias("_lead")
    tops = members.groupBy("bucket").agg(lead, F.count(F.lit(1)).alias("_n"), F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b")
    tops = materialise(tops.select("bucket", "_lead", "_n"), "tops")
    return tops, tops.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members with their present roots."""
    if roots is None:
        return members
    now = roots.select(F.col("node").alias("tid"), F.col("root").alias("_now"))
    return members.join(now.hint("shuffle_hash"), "tid", "left").select("bucket", "band", "tid", "_fame", F.coalesce("_now", "root").alias("root"))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, root``: components of the roots so far and more links."""
    known = links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return connected_components(known)


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, ``_th, class_id, class_size`` and ``_keep_th`` (the text hash of the one to keep)."""
    marks = _marks(docs, id_col, text_col)
    one = F.min(F.struct(F.col(id_col).alias("_id"), "_th")).alias("_p")
    texts = materialise(marks.groupBy("tid").agg(one, F.count(F.lit(1)).alias("_n"), F.first("sig").alias("sig")), "texts")
    roots = _linked(docs, texts, threshold, id_col, text_col)
    rooted = texts.select("tid", "_p", "_n", F.col("tid").alias("root"))
    if roots is not None:
        rooted = rooted.drop("root").join(roots.select(F.col("node").alias("tid"), "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    rooted = materialise(rooted, "rooted")
    classes = materialise(rooted.groupBy("root").agg(F.min("_p").alias("_c"), F.sum("_n").alias("class_size")), "classes")
    named = materialise(rooted.select("tid", "root").join(classes, "root").select("tid", F.col("_c._id").alias("class_id"), F.col("_c._th").alias("_keep_th"), "class_size"), "named")
    return marks.drop("sig").join(named, "tid").drop("tid")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``class_id`` (the smallest id of its class) and ``class_size`` (rows).

    A class is a connected component of texts with similarity ``threshold`` or above over
    whole texts.  Texts with the same words are alike; texts of fewer than five words have
    one shingle; texts without words, null and empty ones (which are equal), are alike only
    if equal.  Repeated rows are of one class; a null id counts as the smallest; an
    empty table gives no rows; other columns are not read.
    """
    return _classes(docs, threshold, id_col, text_col).select(id_col, "class_id", "class_size")


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; same columns, whatever their names.

    Nulls, empty texts, repeated rows and empty tables as in :func:`near_duplicates`.
    """
    found = _classes(docs, threshold, id_col, text_col)
    keep = found.where(F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("_th") == F.col("_keep_th"))).select(F.col(id_col).alias("_id"), F.col("_th").alias("_h")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_of"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"))
    kept = rows.join(keep, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")), "left_semi")
    return kept.dropDuplicates(["_of", "_th"]).select(*[f"row.`{c}`" for c in docs.columns])

"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .storage import materialise
from .tokens import encoder

#: Pieces per shard, islands per shard, individuals per island and crossovers per island and epoch.
SHARD, ISLANDS, POPULATION, CROSSOVERS = 2000, 2, 8, 24
#: Epochs without a gain after which a shard's islands stop.
PATIENCE = 2
#: Sequences at least this full stay as they are; the pieces of others are packed again.
FULL = 0.9995

Bins = list[list[int]]


def least_bins(lengths: list[int], capacity: int) -> int:
    """A number of bins that no packing can go below.

    For each bound c up to half the capacity: items above ``capacity - c`` have bins of their
    own, others above half the capacity one each, and what those in [c, capacity / 2] have
    beyond the room left in these needs more.
    """
    falling = sorted(lengths, reverse=True)
    ahead = [0, *accumulate(falling)]
    upto = lambda least: bisect_right(falling, -least, key=lambda x: -x)  # noqa: E731  items of that length or more
    half = upto(capacity // 2 + 1)
    best = max(half, -(-ahead[-1] // capacity))
    for c in set(falling[half:]):
        alone, small = upto(capacity - c + 1), upto(c)
        over = ahead[small] - ahead[half] - ((half - alone) * capacity - (ahead[half] - ahead[alone]))
        best = max(best, half + max(0, -(-over // capacity)))
    return best


def best_fit(lengths: list[int], items: list[int], capacity: int, bins: Bins, room: list[int]) -> None:
    """Put each item, in order, into the bin with the least room that holds it, or a new one."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        by_room.setdefault(r, []).append(b)
        mask |= 1 << r
    for i in items:
        need = lengths[i]
        found = mask >> need
        if found:
            r = need + (found & -found).bit_length() - 1
            same = by_room[r]
            b = same.pop()
            if not same:
                mask ^= 1 << r
        else:
            r, b = capacity, len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        r -= need
        room[b] = r
        same = by_room.setdefault(r, [])
        same.append(b)
        mask |= 1 << r


class Island:
    """A population of packings of one shard; an individual is a list of bins."""

    def __init__(self, lengths: list[int], capacity: int, seed: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.rng = random.Random(seed)
        self.least = least_bins(lengths, capacity)
        self.order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        #: Crossovers, and those whose child was better than all before it.
        self.crossed = self.won = 0

    def fill(self, bin_: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, bin_))

    def fitness(self, bins: Bins) -> tuple[int, float]:
        """Fewer bins are better, then fuller ones (sum of squares of fill)."""
        fills = [self.fill(b) / self.capacity for b in bins]
        return -len(bins), sum(f * f for f in fills)

    def pack(self, items: list[int], bins: Bins | None = None) -> Bins:
        bins = [] if bins is None else bins
        best_fit(self.lengths, items, self.capacity, bins, [self.capacity - self.fill(b) for b in bins])
        return bins

    def founder(self, blurred: bool) -> Bins:
        """Best fit by falling length, or by lengths that are blurred at random."""
        if not blurred:
            return self.pack(self.order)
        blur = [x * self.rng.uniform(0.7, 1.3) for x in self.lengths]
        return self.pack(sorted(self.order, key=lambda i: -blur[i]))

    def improve(self, bins: Bins, displaced: list[int]) -> list[int]:
        """Exchange items of bins for displaced ones that fill the bins better; returns what is displaced then.

        One item goes for a longer one, or for two that fill the bin to the last token.
        """
        size, left = self.lengths, sorted(displaced, key=self.lengths.__getitem__)
        pairs: dict[int, tuple[int, int]] = {}
        if len(left) <= 60:
            pairs = {size[a] + size[b]: (a, b) for k, a in enumerate(left) for b in left[:k]}
        for b in bins:
            room = self.capacity - self.fill(b)
            if not room:
                continue
            for k, i in enumerate(b):
                two = pairs.get(size[i] + room)
                if two is not None and two[0] in left and two[1] in left:
                    b[k] = two[0]
                    b.append(two[1])
                    left.remove(two[0])
                    left.remove(two[1])
                    insort(left, i, key=size.__getitem__)
                    break
                at = bisect_right(left, size[i] + room, key=size.__getitem__) - 1
                if at >= 0 and size[left[at]] > size[i]:
                    room -= size[left[at]] - size[i]
                    b[k] = left.pop(at)
                    insort(left, i, key=size.__getitem__)
                    if not room:
                        break
        return left[::-1]

    def cross(self, one: Bins, other: Bins) -> Bins:
        """Inject well-filled bins of ``other`` into ``one``: bins that hold an injected item again go, and their rest is fitted anew."""
        well = sorted(other, key=self.fill, reverse=True)[: max(1, len(other) // 2)]
        injected = self.rng.sample(well, max(1, len(well) // self.rng.choice((3, 6, 12))))
        taken = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in one:
            if taken.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        # mutation: the emptiest bins and a few others are opened too
        kept.sort(key=self.fill)
        opened = set(range(min(len(kept), 1 + len(kept) // 50))) | {self.rng.randrange(len(kept)) for _ in range(2 if kept else 0)}
        for k in opened:
            displaced += kept[k]
        kept = [b for k, b in enumerate(kept) if k not in opened] + [list(b) for b in injected]
        return self.pack(self.improve(kept, displaced), kept)

    def evolve(self, elites: list[Bins], crossovers: int = CROSSOVERS) -> Bins:
        """The best individual after some crossovers; ``elites`` have come from other islands, the rest of the population is founded here.

        Ends early where a packing needs no more bins than any must.
        """
        people = [(self.fitness(b), b) for b in elites]
        while len(people) < POPULATION and not (people and -max(p[0] for p in people)[0] <= self.least):
            bins = self.founder(blurred=bool(people))
            people.append((self.fitness(bins), bins))
        people.sort(key=lambda p: p[0], reverse=True)
        for _ in range(crossovers):
            if -people[0][0][0] <= self.least or len(people) < 2:
                break
            a, b = sorted(self.rng.sample(range(len(people)), 2))
            one, other = people[a][1], people[b][1]
            child = self.cross(one, other) if self.rng.random() < 0.5 else self.cross(other, one)
            fit = self.fitness(child)
            self.crossed += 1
            self.won += fit > people[0][0]
            if fit > people[-1][0] and all(fit != p[0] for p in people):
                people[-1] = (fit, child)
                people.sort(key=lambda p: p[0], reverse=True)
        return people[0][1]


def _to_bins(assigned: list[int]) -> Bins:
    bins: Bins = [[] for _ in range(max(assigned, default=-1) + 1)]
    for i, b in enumerate(assigned):
        bins[b].append(i)
    return bins


#: What is known of a shard before an epoch: its best packing, epochs without a gain, crossovers and those that made a better packing.
_STATE = ["_had", "_idle", "_c", "_w"]


def _evolve(shards: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch on every island (``_shard, _island, _items, _elites``, and ``_had, _idle, _c, _w``, which stay as they are).

    Adds ``_best`` (bin of each item), ``_bins`` (how many), ``_fit``, ``_open`` (whether fewer are thinkable) and
    ``_crossed, _won`` (crossovers, and those that made a better packing).
    """
    shape = shards.schema["_items"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, island = batch.column("_shard")[row].as_py(), batch.column("_island")[row].as_py()
                lengths = batch.column("_items")[row].values.field("length").to_pylist()
                elites = [_to_bins(x) for x in batch.column("_elites")[row].as_py() or []]
                home = Island(lengths, capacity, zlib.crc32(f"{shard}/{island}/{epoch}".encode()))
                bins = home.evolve(elites)
                best = np.zeros(len(lengths), np.int32)
                for k, b in enumerate(bins):
                    best[b] = k
                one = batch.slice(row, 1)
                made = [pa.array([best], pa.list_(pa.int32())), pa.array([len(bins)], pa.int64()), pa.array([home.fitness(bins)[1]], pa.float64())]
                made += [pa.array([len(bins) > home.least]), pa.array([home.crossed], pa.int64()), pa.array([home.won], pa.int64())]
                yield pa.RecordBatch.from_arrays([*one.columns[:3], *one.columns[4:], *made], ["_shard", "_island", "_items", *_STATE, "_best", "_bins", "_fit", "_open", "_crossed", "_won"])

    schema = f"_shard long, _island int, _items {shape}, _had struct<_b:long,_f:double>, _idle int, _c long, _w long, _best array<int>, _bins long, _fit double, _open boolean, _crossed long, _won long"
    return shards.select("_shard", "_island", "_items", "_elites", *_STATE).mapInArrow(run, schema)


def _evolved(shards: DataFrame, capacity: int, number: int) -> DataFrame:
    """The best packing of every shard (``_shard, _items``): adds ``_best``, and ``_crossed, _won`` of all its islands.

    Islands of a shard start from founders of their own; after each epoch their best migrate
    to all of them.  A shard is done when its packing is proven to be least or when
    ``PATIENCE`` epochs have not bettered it; only others go on.
    """
    spread = lambda df: df.withColumn("_island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    open_ = shards.withColumns({"_elites": F.lit(None).cast("array<array<int>>"), "_had": F.lit(None).cast("struct<_b:long,_f:double>"), "_idle": F.lit(0), "_c": F.lit(0).cast("long"), "_w": F.lit(0).cast("long")})
    done: DataFrame | None = None
    epoch = 0
    while True:
        found = _evolve(spread(open_), capacity, epoch)
        rank = F.struct((-F.col("_bins")).alias("_b"), F.col("_fit").alias("_f"))
        met = found.groupBy("_shard").agg(
            F.max_by("_best", F.struct(rank, "_island")).alias("_best"), F.max(rank).alias("_now"), F.collect_list("_best").alias("_elites"), F.first("_items").alias("_items"),
            F.bool_and("_open").alias("_open"), F.sum("_crossed").alias("_crossed"), F.sum("_won").alias("_won"),
            *[F.first(c).alias(c) for c in _STATE],  # the same on all islands; a join would be a broadcast of each epoch's
        )
        gained = F.col("_had").isNull() | (F.col("_now") > F.col("_had"))
        state = met.withColumns({"_idle": F.when(gained, 0).otherwise(F.col("_idle") + 1), "_c": F.col("_c") + F.col("_crossed"), "_w": F.col("_w") + F.col("_won")})
        state = materialise(state.select("_shard", "_items", "_best", "_elites", F.col("_now").alias("_had"), "_idle", "_c", "_w", (F.col("_open") & (F.col("_idle") < PATIENCE)).alias("_more")), f"packed-{number}-{epoch}")
        ended = state.where(~F.col("_more")).select("_shard", "_items", "_best", F.col("_c").alias("_crossed"), F.col("_w").alias("_won"))
        done = ended if done is None else done.unionByName(ended)
        open_ = state.where("_more").drop("_best", "_more")
        if open_.isEmpty():
            return done
        epoch += 1


def _pack_round(pieces: DataFrame, n_shards: int, capacity: int, number: int, keys: list[str]) -> DataFrame:
    """Pack the pieces of each shard: adds ``sequence_id, offset`` and ``_stays``.

    Sequences that are full stay, and so does the fuller half of a shard's; others may be packed again.
    """
    names = pieces.columns
    # equal rows meet in one shard and keep their order, so retries give the same packing
    items = F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("_by"), *names)))
    shard = F.pmod(F.xxhash64(F.lit(number), *keys), F.lit(n_shards))
    won = _evolved(materialise(pieces.groupBy(shard.alias("_shard")).agg(items.alias("_items")), f"shards-{number}"), capacity, number)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = batch.column(0)[row].as_py()
                items = batch.column(1)[row].values
                size = np.array(items.field("length").to_numpy(zero_copy_only=False), np.int64)
                bins = np.array(batch.column(2)[row].as_py(), np.int64)
                order = np.argsort(bins, kind="stable")
                ahead = np.cumsum(size[order]) - size[order]
                start = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
                offset = np.empty(len(size), np.int64)
                offset[order] = ahead - np.maximum.accumulate(np.where(start, ahead, 0))
                fill = np.bincount(bins, weights=size)
                stays = (fill >= FULL * capacity) | (np.argsort(np.argsort(fill, kind="stable")) >= len(fill) // 2)
                ids = (number << 56) + (shard << 20) + bins
                yield pa.RecordBatch.from_arrays([*items.flatten()[1:], pa.array(ids), pa.array(offset), pa.array(stays[bins])], [*names, "sequence_id", "offset", "_stays"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return won.select("_shard", "_items", "_best").mapInArrow(place, f"{fields}, sequence_id long, offset long, _stays boolean")


def pack_pieces(pieces: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces, so that few sequences of ``capacity`` hold all.

    ``length`` (1 to ``capacity``) is a piece's size; ``keys`` name columns that differ
    between pieces (repeated pieces are packed each).  Pieces are dealt to shards of a bounded
    number, whose islands evolve packings; see :func:`_evolved`.  The less full half of a
    shard's sequences, unless they are full, are dealt to fewer shards and packed again, so
    that what a shard leaves half empty is shared out, until one shard holds what is left:
    each round has at most half the sequences of the one before.  Rows must be comparable;
    an empty table gives no rows.
    """
    done: DataFrame | None = None
    left, number = pieces, 0
    n = pieces.count()
    while True:
        n_shards = max(1, -(-n // SHARD))
        packed = materialise(_pack_round(left, n_shards, capacity, number, keys), f"packed-{number}")
        last = n_shards == 1
        kept = packed if last else packed.where("_stays")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done.drop("_stays")
        left = packed.where(~F.col("_stays")).drop("sequence_id", "offset", "_stays")
        n = left.count()
        number += 1


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text's ids and ``end_id``: id, ``piece, start, length, ids_crc32``.

    Only documents longer than ``capacity`` are cut, however long they are.  Null and empty
    texts have the end id only; a null id is kept; repeated rows have their pieces each; an
    empty table gives no rows; no other column is read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches, 1):
            ids, at = enc.encode(batch.column(1), end_id)
            data, n = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), -(-np.diff(at) // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = at[row] + piece * capacity
            length = np.minimum(at[row + 1] - first, capacity)
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            columns = [pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *columns], [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document into pieces and pack these: see :func:`cut_pieces` and :func:`pack_pieces`."""
    pieces = materialise(cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    return pack_pieces(pieces, capacity, [id_col, "piece"])

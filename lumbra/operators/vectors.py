"""Vectors of chunks: normalising, blending and exact filtered search by cosine."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

CONTENT, METADATA = 0.9, 0.1
TOP_K, MAX_DISTANCE = 6, 0.5
#: Questions and chunks per block.
QUESTIONS, CHUNKS = 512, 4096


def l2_norm(vector: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalised(vector: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = l2_norm(vector)
    return F.when(norm == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))


def blended(content: Column, metadata: Column, weights: tuple[float, float] = (CONTENT, METADATA)) -> Column:
    """Weighted sum of both vectors, normalised; without metadata the content's; different lengths are an error."""
    mixed = F.zip_with(content, metadata, lambda c, m: weights[0] * c.cast("double") + weights[1] * m.cast("double"))
    same = F.size(content) == F.size(metadata)
    checked = F.when(same, mixed).otherwise(F.raise_error(F.concat(F.lit("vectors of different lengths: "), F.size(content), F.lit(" and "), F.size(metadata))))
    return F.when(metadata.isNull(), l2_normalised(content)).otherwise(l2_normalised(checked))


def blend_tables(content: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, embedding``: each content vector blended with its metadata vector, if there is one (both ``keys, vetor``)."""
    joined = content.join(metadata.withColumnRenamed("vetor", "_meta"), keys, "left")
    return joined.select(*keys, blended(F.col("vetor"), F.col("_meta")).alias("embedding"))


def check_dimension(vector: Column, dimension: int) -> Column:
    """The vector, or an error if its length is another."""
    return F.when(F.size(vector) == dimension, vector).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimension} components, found "), F.size(vector))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine of two vectors, in double precision; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, 1 - dot / norms)


def _blocks(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Rows as arrays of about ``size``, each by the hash of its key."""
    n = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct(*rows.columns)).alias(name)).select(name)


def _matrix(values: pa.StructArray, name: str) -> np.ndarray:
    vectors = values.field(name)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _passing(questions: pa.StructArray, chunks: pa.StructArray) -> np.ndarray:
    """Which chunks each question's filters let through."""
    out = np.ones((len(questions), len(chunks)), bool)
    asked = {f.name for f in questions.type}
    had = {f.name for f in chunks.type}
    if "ano_min" in asked and "ano" in had:
        years = np.array([np.nan if y is None else y for y in chunks.field("ano").to_pylist()], float)
        for q, least in enumerate(questions.field("ano_min").to_pylist()):
            if least is not None:
                out[q] &= years >= least
    if "regional" in asked and "regional" in had:
        regions = np.array(chunks.field("regional").to_pylist(), object)
        for q, region in enumerate(questions.field("regional").to_pylist()):
            if region is not None:
                out[q] &= (regions == region) | np.equal(regions, None)
    if "tema" in asked and "tema" in had:
        themes = chunks.field("tema").to_pylist()
        for q, theme in enumerate(questions.field("tema").to_pylist()):
            if theme is not None:
                out[q] &= np.array([t is not None and theme in t for t in themes], bool)
    return out


def _local_best(pairs: DataFrame, k: int, max_distance: float | None, key: str, kinds: tuple[str, str]) -> DataFrame:
    """The ``k`` best chunks of each question of a block within a block of chunks, for pairs of blocks ``c, q``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                c, q = batch.column(0)[row].values, batch.column(1)[row].values
                a, b = _matrix(q, "vetor"), _matrix(c, "embedding")
                norms = np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))
                distance = np.full(norms.shape, np.inf)
                np.divide(a @ b.T, norms, out=distance, where=norms > 0)
                distance[norms > 0] = 1 - distance[norms > 0]
                distance[~_passing(q, c)] = np.inf
                if max_distance is not None:
                    distance[distance > max_distance] = np.inf
                keys = c.field(key).to_pylist()
                found: list[tuple[int, int, float]] = []
                for n, line in enumerate(distance):
                    at = np.flatnonzero(np.isfinite(line))
                    if len(at) > k:
                        at = at[line[at] <= np.partition(line[at], k - 1)[k - 1]]
                    found += [(n, j, line[j]) for j in sorted(at.tolist(), key=lambda j: (line[j], keys[j]))[:k]]
                take = lambda column, which: column.take(pa.array([f[which] for f in found], pa.int64()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([take(q.field("question_id"), 0), take(c.field(key), 1), pa.array([f[2] for f in found], pa.float64())], ["question_id", key, "distancia"])

    q_kind, c_kind = kinds
    return pairs.select("c", "q").mapInArrow(run, f"question_id {q_kind}, `{key}` {c_kind}, distancia double")


def _ranked(local: DataFrame, k: int, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("distancia", key))
    return local.withColumn("posicao", rank).where(F.col("posicao") <= k)


def nearest_chunks(questions: DataFrame, chunks: DataFrame, k: int = TOP_K, max_distance: float | None = MAX_DISTANCE, key: str = "chunk_id") -> DataFrame:
    """``question_id, key, distancia, posicao``: the ``k`` nearest chunks of each question that pass its filters.

    Exact; ties by key.  ``questions``: ``question_id, vetor`` and optional ``ano_min, regional,
    tema``, each skipped where null.  ``chunks``: ``key, embedding`` and optional ``ano, regional,
    tema``: a chunk passes if its year is not below, its region is equal or null, its theme
    contains the asked one.  Zero vectors are at no distance.  Blocks of questions meet blocks
    of chunks, both of bounded size; a task multiplies their matrices and keeps its ``k`` best
    per question, so only these are shuffled.
    """
    wanted = [c for c in ("ano", "regional", "tema") if c in chunks.columns]
    filters = [c for c in ("ano_min", "regional", "tema") if c in questions.columns]
    asked = _blocks(questions.select("question_id", "vetor", *filters), "question_id", QUESTIONS, "q")
    held = _blocks(chunks.select(key, "embedding", *wanted), key, CHUNKS, "c")
    kinds = tuple(d.schema[c].dataType.simpleString() for d, c in ((questions, "question_id"), (chunks, key)))
    return _ranked(_local_best(held.crossJoin(asked), k, max_distance, key, kinds), k, key)


#: Groups that a question visits before others are judged by what it found there.
FIRST_GROUPS = 2


def _angles(vectors: pa.Array, centres: np.ndarray) -> np.ndarray:
    """Angle between each vector, none of them zero, and each centre."""
    a = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return np.arccos(np.clip((a / np.sqrt((a * a).sum(1))[:, None]) @ centres.T, -1, 1))


def nearest_chunks_by_group(
    questions: DataFrame, chunks: DataFrame, k: int = TOP_K, max_distance: float | None = MAX_DISTANCE, key: str = "chunk_id", groups: int = 64, met: list[DataFrame] | None = None
) -> DataFrame:
    """As :func:`nearest_chunks`, exact too, but a question meets only groups of chunks that may hold one of its best.

    ``groups`` chunks, those of the smallest hashes of their keys, are centres; each chunk
    belongs to the nearest, and a group's radius is its largest angle to its centre.  By the
    triangle inequality of angles no chunk of a group is nearer to a question than the angle
    to its centre less its radius.  A question visits its nearest groups by that bound, and
    then those whose bound doesn't exceed its ``k``-th distance so far.  Centres and radii,
    ``groups`` of them, are all that goes through the driver.  Groups are met in blocks, each
    pair of a block of chunks and a block of questions by itself, so a group may hold any
    share of all chunks.  ``met`` receives the pairs of blocks, for those who count them.
    """
    spark = questions.sparkSession
    wanted = [c for c in ("ano", "regional", "tema") if c in chunks.columns]
    filters = [c for c in ("ano_min", "regional", "tema") if c in questions.columns]
    kinds = tuple(d.schema[c].dataType.simpleString() for d, c in ((questions, "question_id"), (chunks, key)))
    some = lambda v: F.exists(v, lambda x: x != 0)
    usable = chunks.where(some(F.col("embedding"))).select(F.struct(key, "embedding", *wanted).alias("c"), F.col("embedding").cast("array<double>").alias("_v"), F.xxhash64(key).alias("_h"))
    picked = [r[0] for r in usable.orderBy("_h").limit(groups).select("_v").collect()]
    if not picked:
        return spark.createDataFrame([], f"question_id {kinds[0]}, `{key}` {kinds[1]}, distancia double, posicao int")
    centres = np.array(picked, float)
    centres /= np.sqrt((centres * centres).sum(1))[:, None]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(batch.column("_v"), centres)
            group = angles.argmin(1)
            nearest = angles[np.arange(len(group)), group]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("_h"), pa.array(group, pa.int32()), pa.array(nearest)], names=["c", "_h", "_group", "_angle"])

    of = usable.schema["c"].dataType.simpleString()
    grouped = written(usable.mapInArrow(assign, f"c {of}, _h long, _group int, _angle double"), "grouped-vectors")
    known = {r[0]: (r[1], r[2]) for r in grouped.groupBy("_group").agg(F.max("_angle"), F.count(F.lit(1))).collect()}
    numbers = sorted(known)
    # a little wider, for what arc cosines lose
    radii = np.array([known[g][0] for g in numbers]) + 1e-6
    per_group = F.from_json(F.lit(json.dumps([-(-known[g][1] // CHUNKS) if g in known else 1 for g in range(len(picked))])), "array<int>")
    blocks = F.get(per_group, F.col("_group"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = 1 - np.cos(np.maximum(_angles(batch.column("_v"), centres[numbers]) - radii, 0))
            order = least.argsort(1, kind="stable")
            near = [[{"group": numbers[g], "least": float(line[g])} for g in by] for line, by in zip(least, order, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("q"), pa.array(near, pa.list_(pa.struct([("group", pa.int32()), ("least", pa.float64())])))], names=["q", "_near"])

    asked = questions.where(some(F.col("vetor"))).select(F.struct("question_id", "vetor", *filters).alias("q"), F.col("vetor").cast("array<double>").alias("_v"))
    asked = written(asked.mapInArrow(bound, f"q {asked.schema['q'].dataType.simpleString()}, _near array<struct<group: int, least: double>>"), "bounded-questions")
    per_block = max(1, -(-asked.count() // QUESTIONS))
    held = grouped.groupBy("_group", F.pmod("_h", blocks).alias("_nth")).agg(F.collect_list("c").alias("c"))

    def visit(wanting: DataFrame) -> DataFrame:
        rows = wanting.select("q", F.explode("_visit.group").alias("_group"))
        groups_of = rows.groupBy("_group", F.pmod(F.xxhash64("q.question_id"), F.lit(per_block)).alias("_qb")).agg(F.collect_list("q").alias("q"))
        spread = groups_of.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
        pairs = held.join(spread, ["_group", "_nth"])
        if met is not None:
            met.append(pairs)
        return _local_best(pairs, k, max_distance, key, kinds)

    first = written(visit(asked.withColumn("_visit", F.slice("_near", 1, FIRST_GROUPS))), "first-visits")
    beat = _ranked(first, k, key).groupBy("question_id").agg(F.max("distancia").alias("_beat"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k)
    open_ = asked.join(beat.select(F.col("question_id").alias("_of"), "_beat"), F.col("q.question_id") == F.col("_of"), "left")
    limit = F.coalesce("_beat", F.lit(float("inf") if max_distance is None else max_distance))
    rest = F.filter(F.slice("_near", FIRST_GROUPS + 1, len(numbers)), lambda g: g["least"] <= F.col("_limit"))
    more = open_.withColumn("_limit", limit).select("q", rest.alias("_visit"))
    return _ranked(first.unionByName(visit(more)), k, key)

"""Mixing sources to target weights by distributed prefix sums of sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Documents of a source per slice of its random order: what one task sorts at a time.
SLICE = 2_000


def count_words(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``).

    Sources in order of code points, null last, get ``weights`` in turn and share
    ``share`` times all sizes by weight; a target stops at ``ceiling`` times the source's
    size and the excess is shared again by weight until none is above.  In order of size
    over weight the sources that stop come first, so running sums give the level at which
    sharing ends.  An empty table gives no rows, a source of size 0 the target 0.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights)) + 1)
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_ratio", "_rank")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.lit(float(ceiling)) * F.col("source_size")
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    return (
        sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_w", w)
        .withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", left / F.sum("_w").over(after))
        # the level falls from the first source on that doesn't stop, so the highest open one is its
        .withColumn("_open", F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(everything))
        .withColumn("target", F.when(F.col("_level") >= F.col("_ratio"), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_open"))))
        .select("source", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``size, source_size, target, taken, copies``.

    ``carry=True`` gives all columns of ``docs``, as ``row``, in place of the id.

    Whole epochs of a source are taken while its target holds them; the last epoch is cut
    at the exact budget in a random order that depends on seed, id and text only, so reruns
    agree: ``taken`` sums to the target's whole words in every source, and the document at
    the cut gives its first words only.  ``copies`` counts whole documents instead: the one
    at the cut is in if half of it is.  Null and empty texts have size 0; a null source is a
    source; a null id is an id; repeated rows are separate documents, in any order; texts of
    any length are counted whole; an empty table gives no rows.

    The random key is uniform, so cutting its range into equal slices is a range partition
    that needs no sample: a source of any size is dealt over as many slices as it has
    thousands of documents, and only sums per slice meet in one window.
    """
    sized = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("_source"),
        count_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_key"),
        *([F.struct(*docs.columns).alias("row")] if carry else []),
    )
    narrow = materialise(sized.drop("row"), "mix-sizes")
    counts = materialise(narrow.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")), "mix-sources")
    goal = source_targets(counts.select(F.col("_source").alias("source"), "source_size"), weights, share, ceiling)
    size = F.col("source_size")
    plan = materialise(
        counts.select("_source", F.ceil(F.col("_docs") / SLICE).cast("int").alias("_slices"))
        .join(goal, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("_epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
        .withColumn("_rest", (F.floor(F.col("target")) - F.col("_epochs") * size).cast("long"))
        .select(F.col("_source").alias("_of"), "_slices", "source_size", "target", "_epochs", "_rest"),
        "mix-plan",
    )
    # 2**-64 times the unsigned key, so that slices are equal ranges of it
    unit = F.col("_key") / F.lit(2.0**64) + F.lit(0.5)
    slice_of = F.least(F.floor(unit * F.col("_slices")), F.col("_slices") - 1).cast("int")
    of_source = F.col("_source").eqNullSafe(F.col("_of"))
    sums = narrow.join(plan.select("_of", "_slices"), of_source).groupBy("_source", slice_of.alias("_slice")).agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_source").alias("_from"), F.col("_slice").alias("_at"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_source", "_slice").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized if carry else narrow
    placed = (
        rows.join(plan, of_source)
        .withColumn("_slice", slice_of)
        .join(starts, F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_slice") == F.col("_at")))
        .withColumn("_ahead", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    )
    room = F.col("_rest") - F.col("_ahead")
    part = F.greatest(F.lit(0), F.least(F.col("size"), room))
    taken = F.col("_epochs") * F.col("size") + part
    copies = F.col("_epochs") + (2 * room > F.col("size")).cast("int")
    first = F.col("row") if carry else F.col("_id").alias(id_col)
    return placed.select(first, "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"))


def draw_mixture(docs: DataFrame, **settings) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as :func:`mix_sources` copies it, same columns, whatever their names.

    Documents stay whole.  Those without words, as null and empty texts, have no copy beyond
    whole epochs.  An empty table gives no rows.
    """
    mixed = mix_sources(docs, carry=True, **settings)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*[f"row.`{c}`" for c in docs.columns])

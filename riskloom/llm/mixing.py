"""Mixing sources to target weights by weighted fair queueing, on DataFrame functions alone."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.keys import hash_of, words
from riskloom.sources.staging import stage

WEIGHTS = (3, 1, 2)
SLICE_ROWS = 8_192
ORDER = ["finish", "copy", "key", "doc_id", "tie"]


def targets(sources: DataFrame, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """``target`` per source from ``source``, ``source_size``.

    Sources take the weights in turn, by code point, null last. ``share`` of all sizes is split
    by weight; no target exceeds ``repeats`` times its source's size, what is above is shared
    again by weight. The level at which that ends is the highest of the levels that hold when
    the sources with the least room per unit of weight are full.

    One row per source passes through one task here, never a document.
    """
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    full = F.col("source_size") * repeats
    return (
        sources.withColumn("weight", weight)
        .withColumn("room", full.cast("double") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn(
            "level",
            (F.col("budget") - F.coalesce(F.sum(full).over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        )
        .withColumn("target", F.least(full.cast("double"), F.max("level").over(everything) * F.col("weight")))
        .withColumn("target", F.when(F.col("budget") >= F.sum(full).over(everything), full.cast("double")).otherwise(F.col("target")))
        .select("source", "source_size", "target", "budget")
    )


def _finish(copy: Column) -> Column:
    """Virtual finish time: words of the source up to this copy of the document, over the target."""
    upto = copy * F.col("source_size") + F.col("upto")
    return F.coalesce(F.try_divide(upto.cast("double"), F.col("target")), F.lit(0.0))


def _place(seed: int) -> list[Column]:
    """What orders the documents of a source: ``key``, a seeded hash, then the id, then ``tie``, a digest of the text."""
    return [
        hash_of(F.lit(f"mix{seed}"), F.col("doc_id")).alias("key"), F.col("doc_id"),
        F.md5(F.coalesce("text", F.lit(""))).alias("tie"),
    ]


def mix(
    df: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 0,
    slice_rows: int = SLICE_ROWS, size: Column | None = None,
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` per document.

    Documents (``doc_id``, ``text``, ``source``) are shuffled by a seeded hash. A copy of a
    document finishes when its source's words up to it, over the source's target, say so; a
    further copy starts after the whole source. Copies in the order of their finish times are
    taken until the budget is reached. Each source so gets its target, but for a part of a
    document.

    Running sums are taken in two steps, per hash slice of a source and over the slices, so a
    source with a third of all rows is many groups. The global order is a range partitioning:
    sums of whole ranges find the one in which the budget ends, only that one is gone through.
    Equal keys are ordered by id and text; rows equal in all are interchangeable.

    Null and empty texts have size 0, are in no source's way and take nothing. A null source is a
    source, a null id an id. An empty table gives an empty result. Other columns are ignored.
    """
    timed, taken = queue(df, weights, share, repeats, seed, slice_rows, size)
    copies = sum(t.cast("int") for t in taken)
    return timed.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )


def queue(
    df: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 0,
    slice_rows: int = SLICE_ROWS, size: Column | None = None,
) -> tuple[DataFrame, list[Column]]:
    """Documents without their texts, with finish times of their source, and for each copy whether it is taken."""
    rows = df.select("source", (words("text") if size is None else size).alias("size"), *_place(seed))
    rows = stage(rows, "mix-sizes")
    n = rows.count()
    slices = max(1, math.ceil(n / slice_rows))
    width = 16**15 // slices + 1
    rows = rows.withColumn("slice", F.expr(f"key div {width}")).withColumn(
        "name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    )
    sums = stage(rows.groupBy("name", "source", "slice").agg(F.sum("size").alias("words")), "mix-sums")
    goals = stage(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats), "mix-targets")
    budget = goals.agg(F.max("budget")).first()[0] or 0.0
    earlier = Window.partitionBy("name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(goals, sums["source"].eqNullSafe(goals["source"]))
        .select("name", "slice", "start", "source_size", "target")
    )
    within = Window.partitionBy("name", "slice").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    timed = (
        rows.withColumn("in_slice", F.sum("size").over(within))
        .join(starts, ["name", "slice"])
        .withColumn("upto", F.col("start") + F.col("in_slice"))
        .drop("in_slice", "start", "slice", "name")
    )
    timed = stage(timed, "mix-times")

    copies = timed.select(
        "key", "doc_id", "tie", "size", "source_size", "target", "upto",
        F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"),
    ).select(_finish(F.col("copy")).alias("finish"), "copy", "key", "doc_id", "tie", "size")
    ranges = max(1, math.ceil(n * repeats / slice_rows))
    ordered = stage(copies.repartitionByRange(ranges, *ORDER).withColumn("range", F.spark_partition_id()), "mix-order")
    through = F.sum("words").over(Window.orderBy("range"))
    cut = (
        ordered.groupBy("range").agg(F.sum("size").alias("words")).withColumn("through", through)
        .where(F.col("through") > budget).orderBy("range").first()
    )
    if cut is None:
        return timed, [F.lit(True)] * repeats
    running = F.sum("size").over(Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    end = (
        ordered.where(F.col("range") == cut["range"]).withColumn("running", running + F.lit(cut["through"] - cut["words"]))
        .where(F.col("running") > budget).orderBy("running").first()
    )
    kinds = dict(ordered.dtypes)
    last = F.struct(*[F.lit(end[c]).cast(kinds[c]).alias(c) for c in ORDER])
    return timed, [
        F.struct(_finish(F.lit(c)).alias("finish"), F.lit(c).alias("copy"), "key", "doc_id", "tie") < last
        for c in range(repeats)
    ]


def mixture(df: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The documents of the mix themselves, each as often as it is taken, with the columns of ``df``.

    Finish times grow with a document's place in its source, so of each copy a source gives its first places. The last
    of them, one row per source, are joined to the documents, whose texts are neither shuffled nor written again.
    Rows equal in place, so in id and text, are interchangeable: if the mix takes some of them, they are counted out.
    """
    timed, taken = queue(df, seed=seed, **options)
    copies = range(len(taken))
    place = F.struct("key", "doc_id", "tie").alias("place")
    timed = timed.select(F.col("source").alias("of"), place, *[t.alias(f"taken{c}") for c, t in enumerate(taken)])
    lasts = timed.groupBy("of").agg(*[F.max(F.when(F.col(f"taken{c}"), F.col("place"))).alias(f"last{c}") for c in copies])
    lasts = stage(lasts, "mix-lasts")
    at = [F.coalesce(F.col("place") == F.col(f"last{c}"), F.lit(False)) for c in copies]
    equal = timed.join(lasts.withColumnRenamed("of", "source"), F.col("of").eqNullSafe(F.col("source"))).groupBy("of").agg(
        *[F.count_if(at[c]).alias(f"equal{c}") for c in copies],
        *[F.count_if(at[c] & F.col(f"taken{c}")).alias(f"first{c}") for c in copies],
    )
    equal = equal.withColumnRenamed("of", "__of")
    ends = lasts.join(equal, lasts["of"].eqNullSafe(equal["__of"])).drop("__of")
    ends = stage(ends, "mix-ends")

    kept = [F.col(c).alias(f"kept_{c}") for c in df.columns]
    rows = df.select("source", *_place(seed), *kept).select("source", place, *[f"kept_{c}" for c in df.columns])
    rows = rows.join(ends, rows["source"].eqNullSafe(ends["of"]))
    parted = reduce(Column.__or__, [at[c] & (F.col(f"first{c}") < F.col(f"equal{c}")) for c in copies])
    upto = [F.coalesce(F.col("place") <= F.col(f"last{c}"), F.lit(False)).cast("int") for c in copies]
    chosen = rows.where(~parted).withColumn("copies", sum(upto))
    if not ends.where(reduce(Column.__or__, [F.col(f"first{c}") < F.col(f"equal{c}") for c in copies])).isEmpty():
        number = F.row_number().over(Window.partitionBy("source", "place").orderBy(F.lit(0)))
        some = rows.where(parted).withColumn("number", number)
        first = [F.when(at[c], (F.col("number") <= F.col(f"first{c}")).cast("int")).otherwise(upto[c]) for c in copies]
        chosen = chosen.unionByName(some.withColumn("copies", sum(first)).drop("number"))
    chosen = chosen.where(F.col("copies") > 0)
    repeated = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"kept_{c}").alias(c) for c in df.columns])

"""Mergeable sketches: quantiles with a stated rank error, and the frequent values of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# size parameter of a quantile sketch: some 60 kilobytes hold a column of any length
SIZE = 4_000
MERGED = 64
# frequent values: those a sketch keeps count of
TRACKED = 16_384


def rank_error(size: int = SIZE) -> float:
    """How far the share of values up to a sketched quantile is from the one asked for, 99 times in 100."""
    return 2.296 / size**0.9021


def quantile_sketches(
    df: DataFrame, columns: list[str], by: list[str] | None = None, size: int = SIZE
) -> DataFrame:
    """One row per group with a sketch (binary) of each column, to be stored and merged with others.

    Tasks sketch what they see and their sketches are merged, so little is shuffled and no group is
    held.  Nulls are left out.
    """
    parts = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(size)).alias(c) for c in columns]
    return df.groupBy(*(by or [])).agg(*parts)


def merged(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the sketches of all rows merged, in two levels of a bounded number of sketches each."""
    fold = lambda c: F.reduce(
        F.collect_list(c), F.lit(None).cast("binary"),
        lambda kept, next_one: F.when(kept.isNull(), next_one).otherwise(F.kll_sketch_merge_double(kept, next_one)),
    ).alias(c)
    dealt = sketches.withColumn("__part", F.pmod(F.xxhash64(*columns), F.lit(MERGED)))
    first = dealt.groupBy("__part").agg(*[fold(c) for c in columns])
    return first.agg(*[fold(c) for c in columns])


def quantiles(sketches: DataFrame, columns: list[str], share: float = 0.5) -> dict[str, float | None]:
    """The value at a share of each column, from the sketches of all groups."""
    one = merged(sketches, columns)
    filled = [F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(share))).alias(c) for c in columns]
    row = one.select(*filled).first()
    return {c: row[c] for c in columns}


def frequent(df: DataFrame, column: str, share: float, tracked: int = TRACKED) -> dict:
    """Values that hold at least ``share`` of the rows, with the share they hold at most.

    From one pass with a frequent-items sketch: no group is formed per value.  Counts are at most
    3.5 / ``tracked`` of the rows too high, and values within that of the bar are listed as well, so
    none is missed and at most about 1 / ``share`` reach the driver.
    """
    slack = 3.5 / tracked
    wanted = min(tracked, int(1 / max(share - slack, slack)) + 1)
    found = df.select(F.col(column).alias("v")).agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(v, {wanted}, {tracked})").alias("items")
    ).first()
    rows = max(found["rows"], 1)
    bar = (share - slack) * rows
    return {i["item"]: i["count"] / rows for i in found["items"] or [] if i["item"] is not None and i["count"] >= bar}

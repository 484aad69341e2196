"""Whether two frames hold the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.rowhash import row_hashes
from riskloom.sources.staging import stage


def frame_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that are not equally often in both, with how many more the left has.

    One grouped pass over both; equal rows cancel out before the shuffle.
    """
    columns = left.columns
    signed = left.select(*columns, F.lit(1).alias("__sign")).unionByName(
        right.select(*columns, F.lit(-1).alias("__sign"))
    )
    return (
        signed.groupBy(*columns)
        .agg(F.sum("__sign").alias("surplus"))
        .where(F.col("surplus") != 0)
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that stands for a frame as a bag of rows: ``rows`` and two sums of row hashes.

    Sums do not depend on order, so one aggregate does and no row is shuffled.
    """
    first, second = row_hashes(df)
    return df.select(first.alias("a"), second.alias("b")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in "ab"]
    )


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often, by their fingerprints."""
    prints = fingerprint(left).unionByName(fingerprint(right.select(*left.columns)))
    one, other = prints.collect()
    return one == other


def changed_rows(left: DataFrame, right: DataFrame) -> int:
    """How many distinct rows are not equally often in both; rows are only grouped if there are any."""
    return 0 if same_rows(left, right) else frame_diff(left, right).count()


def perturb_and_compare(
    df: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    column: str,
    texts: list[str],
    keep: list[str],
) -> DataFrame:
    """Per replacement text, how many result rows change if a whole column is set to it.

    ``transform`` should fit anew, so that a text that leaks into the fit shows as well.
    """
    base = stage(transform(df).select(*keep), "base")
    changed = [
        (number, changed_rows(base, transform(df.withColumn(column, F.lit(text))).select(*keep)))
        for number, text in enumerate(texts)
    ]
    return df.sparkSession.createDataFrame(changed, "case int, changed bigint")

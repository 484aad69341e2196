"""Duplicates: exact copies, repeated keys, and counting both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.rowhash import row_hashes


def drop_exact(df: DataFrame) -> DataFrame:
    """One of each set of identical rows; copies collapse before the shuffle."""
    return df.dropDuplicates()


def _one_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    # Filtering row_number() = 1 lets Spark cut every key down to one row per map task
    # (WindowGroupLimit) before the shuffle, so a key with many rows costs no more there.
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def _order_names(df: DataFrame, key: list[str], order_by: list[str] | None) -> list[str]:
    return order_by or [name for name in df.columns if name not in key]


def keep_first(df: DataFrame, key: str | list[str], order_by: list[str] | None = None) -> DataFrame:
    """The first row of each key; null is a key like any other.

    A table has no order of its own, so name the columns that give it (``_position`` for
    tables read with one).  Without them all columns ascending decide.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [F.asc_nulls_first(name) for name in _order_names(df, key, order_by)]
    return _one_per_key(df, key, order or [F.asc_nulls_first(key[0])])


def keep_last(df: DataFrame, key: str, order_by: list[str] | None = None) -> DataFrame:
    """The last row of each non-empty key."""
    order = [F.desc_nulls_last(name) for name in _order_names(df, [key], order_by)]
    present = df.where(F.col(key).isNotNull())
    if isinstance(df.schema[key].dataType, T.StringType):
        present = present.where(F.col(key) != "")
    return _one_per_key(present, [key], order or [F.desc_nulls_last(key)])


def duplicate_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: all rows, what dedupe drops, and distinct keys with and without null.

    Two levels of grouping, each summed up before its shuffle; rows travel as their key and two hashes.
    """
    first, second = row_hashes(df)
    rows = df.groupBy(key, first.alias("__a"), second.alias("__b")).agg(F.count(F.lit(1)).alias("copies"))
    keys = rows.groupBy(key).agg(
        F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("variants")
    )
    return keys.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("rows") - F.col("variants")), F.lit(0)).alias("full_duplicates"),
        F.coalesce(F.sum(F.col("variants") - 1), F.lit(0)).alias("key_duplicates"),
        F.count(F.lit(1)).alias("keys"),
        F.count(key).alias("present_keys"),
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.where(F.col("occurrences") > 1)


def duplicate_examples(duplicates: DataFrame, key: str, examples: int = 3) -> DataFrame:
    """One row: how many keys are duplicated and the first few of them."""
    total = duplicates.agg(
        F.count(F.lit(1)).alias("duplicated"), F.lit(None).cast("string").alias("example")
    )
    first = duplicates.orderBy(key).limit(examples)
    shown = first.select(
        F.lit(None).cast("bigint").alias("duplicated"), F.col(key).cast("string").alias("example")
    )
    return total.unionByName(shown).agg(
        F.max("duplicated").alias("duplicated"),
        F.array_sort(F.collect_list("example")).alias("examples"),
    )

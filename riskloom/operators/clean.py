"""Cleaning of the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import fixed
from riskloom.functions import coerce


def normalize_na(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing-value tokens to null in all (or the named) text columns, in one projection."""
    chosen = set(columns or df.columns)
    kinds = {field.name: field.dataType for field in df.schema.fields}
    return df.select(
        *[
            coerce.missing_to_null(name).alias(name)
            if name in chosen and isinstance(kinds[name], T.StringType)
            else F.col(name)
            for name in df.columns
        ]
    )


_WHOLE = r"^\s*[+-]?[0-9]{1,18}\s*$"


def infer_numbers(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Types a reader that infers them would give text columns, found in one pass.

    ``bigint`` if every row holds a whole number, ``double`` if every value is a number and
    there is one, else not listed.  One aggregate row reaches the driver.
    """
    names = [
        field.name
        for field in df.schema.fields
        if isinstance(field.dataType, T.StringType) and field.name in (columns or df.columns)
    ]
    if not names:
        return {}
    tests = []
    for name in names:
        value = F.col(name)
        tests.append(F.bool_and(coerce.to_number(value).isNotNull() | value.isNull()))
        tests.append(F.bool_and(F.coalesce(value.rlike(_WHOLE), F.lit(False))))
        tests.append(F.count(value) > 0)
    row = df.agg(*[test.alias(f"t{i}") for i, test in enumerate(tests)]).first()
    kinds = {}
    for index, name in enumerate(names):
        numeric, whole, any_value = row[3 * index : 3 * index + 3]
        if any_value and numeric:
            kinds[name] = "bigint" if whole else "double"
    return kinds


def as_read(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns cast to inferred types, so that ``5`` and ``5.0`` are the same value."""
    return df.withColumns(
        {
            name: coerce.to_number(F.col(name)).cast(kind)
            if kind == "double"
            else F.trim(F.col(name)).try_cast(kind)
            for name, kind in kinds.items()
        }
    )


def select_present(df: DataFrame, columns: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """The listed columns that exist, some under another name."""
    rename = rename or {}
    return df.select(
        *[F.col(name).alias(rename.get(name, name)) for name in columns if name in df.columns]
    )


def clean_amount(df: DataFrame) -> DataFrame:
    """``amount_raw`` as read, ``amount`` as a number, ``amount_invalid`` if null or <= 0."""
    amount = coerce.number_column(df, "amount")
    raw = F.col("amount") if "amount" in df.columns else F.lit(None).cast("string")
    return (
        df.withColumn("amount_raw", raw)
        .withColumn("amount", amount)
        .withColumn("amount_invalid", F.coalesce(F.col("amount") <= 0, F.lit(True)))
    )


def fill_amount(df: DataFrame, median: float | None) -> DataFrame:
    """``amount_filled``: the amount, or the median of the valid ones where it is invalid."""
    return df.withColumn(
        "amount_filled",
        F.when(~F.col("amount_invalid"), F.col("amount")).otherwise(F.lit(median).cast("double")),
    )


def clean_times(
    df: DataFrame,
    as_of: str = fixed.AS_OF,
    formats: list[coerce.TimestampFormat] | None = None,
) -> DataFrame:
    """``ts``, ``ts_invalid`` (unreadable or after ``as_of``) and ``hour``.

    The given hour counts if it lies within the day (fractions kept), else that of ``ts``.
    """
    given = coerce.number_column(df, "transaction_hour")
    future = F.col("ts") > F.lit(as_of).cast("timestamp_ntz")
    return (
        df.withColumn(
            "ts",
            coerce.parse_timestamp(coerce.text_column(df, "transaction_timestamp"), formats),
        )
        .withColumn("ts_future", F.coalesce(future, F.lit(False)))
        .withColumn("ts_invalid", F.col("ts").isNull() | F.col("ts_future"))
        .withColumn("__given", given)
        .withColumn(
            "hour",
            F.when(F.col("__given").between(0, 23), F.col("__given")).otherwise(
                F.hour("ts").cast("double")
            ),
        )
        .drop("__given")
    )


def clean_status_flags(df: DataFrame) -> DataFrame:
    """``status_clean`` and a ``_b`` column for each flag column that is there."""
    out = df.withColumn(
        "status_clean", coerce.normalize_status(coerce.text_column(df, "status"))
    )
    for name in fixed.FLAG_COLUMNS:
        if name in df.columns:
            out = out.withColumn(f"{name}_b", coerce.to_flag(F.col(name)))
    return out


def clean_transactions(
    df: DataFrame,
    as_of: str = fixed.AS_OF,
    formats: list[coerce.TimestampFormat] | None = None,
) -> DataFrame:
    """All per-row cleaning of a transaction table whose missing tokens are nulls already."""
    return clean_status_flags(clean_times(clean_amount(df), as_of, formats))


def is_high_risk(df: DataFrame) -> Column:
    """Rated high risk; null or absent is not."""
    rating = F.upper(coerce.text_column(df, "risk_rating", ""))
    return F.coalesce(rating == "HIGH", F.lit(False))


def is_kyc_bad(df: DataFrame) -> Column:
    """Not verified; null or absent counts as not verified."""
    status = F.upper(coerce.text_column(df, "kyc_status", ""))
    return F.coalesce(status != "VERIFIED", F.lit(True))


def is_politically_exposed(df: DataFrame) -> Column:
    return coerce.to_01(coerce.number_column(df, "is_politically_exposed")) == 1

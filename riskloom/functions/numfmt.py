"""Numbers as text, the way a feature prompt shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def whole_text(number: Column) -> Column:
    """No decimals, ties to even; ``nan`` and ``inf`` spelled out."""
    return (
        F.when(number.isNull(), F.lit("nan"))
        .when(number == float("inf"), F.lit("inf"))
        .when(number == float("-inf"), F.lit("-inf"))
        .otherwise(F.rint(number).try_cast("decimal(38,0)").cast("string"))
    )


def double_text(number: Column) -> Column:
    """Shortest text of a double: plain digits from 1e-4 up to 1e16, an exponent beyond.

    Spark itself goes over to exponents at 1e7 and 1e-3.
    """
    raw = number.cast("string")
    size = F.abs(number)
    plain = F.rtrim(raw.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(raw, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    digits = F.abs(power).cast("string")
    digits = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return (
        F.when(size == float("inf"), F.when(number > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(((size >= 1e-3) & (size < 1e7)) | (size == 0), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, sign, digits))
    )


def value_text(df: DataFrame, name: str, missing: str = "?") -> Column:
    """A column of any type as shown text, ``missing`` for null or an absent column."""
    if name not in df.columns:
        return F.lit(missing)
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.col(name).cast("double")
        return F.when(value.isNull() | F.isnan(value), F.lit(missing)).otherwise(double_text(value))
    return F.coalesce(F.col(name).cast("string"), F.lit(missing))

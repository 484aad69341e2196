"""Two 64-bit hashes that stand for a whole row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def row_hashes(df: DataFrame, columns: list[str] | None = None) -> tuple[Column, Column]:
    """Hashes of a row's values; equal rows agree, others in both only by chance (one in 2**128).

    Spark's hash passes over nulls, so which values are null is hashed as well.  Nested values
    are hashed as their JSON text.
    """
    parts = []
    for name in columns or df.columns:
        value = F.col(f"`{name}`")
        nested = isinstance(df.schema[name].dataType, _NESTED)
        parts += [F.to_json(F.struct(value)) if nested else value, value.isNull()]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit("2"), *parts)

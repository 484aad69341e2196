"""Relational text tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.clean import normalize_na
from riskloom.operators.dedupe import keep_last

POSITION = "_position"


def path_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_raw_table(
    spark: SparkSession, path: str, multiline: bool = False, position: bool = False
) -> DataFrame:
    """A CSV table with a header, every column as text and as it stands in the file.

    Files are split over tasks.  ``multiline`` lets a quoted field hold line breaks; a file is
    then read by one task.  ``position`` adds a column that sorts rows in file order.
    """
    table = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multiline)
    if not position:
        return table
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return table.select(*table.columns, place.alias(POSITION))


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multiline: bool = False,
    position: bool = False,
) -> DataFrame:
    """A CSV table with missing-value tokens as nulls.

    Columns stay text, to be cast by the cleaning operators; a schema casts the columns it
    names and lets text that does not fit become null.
    """
    table = normalize_na(read_raw_table(spark, path, multiline, position))
    if schema is None:
        return table
    kinds = {field.name: field.dataType for field in schema.fields}
    return table.select(
        *[
            F.col(name).try_cast(kinds[name]).alias(name) if name in kinds else F.col(name)
            for name in table.columns
        ]
    )


def read_lookup(
    spark: SparkSession, path: str, key: str, multiline: bool = False
) -> DataFrame | None:
    """A CSV table with one row per non-empty key, the last in the file; None if unreadable.

    Text is kept as it stands: the missing-value tokens mean nothing here.
    """
    try:
        table = read_raw_table(spark, path, multiline, position=True)
    except AnalysisException:
        return None
    if key not in table.columns:
        return None
    return keep_last(table, key, [POSITION]).drop(POSITION)

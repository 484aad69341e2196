"""Checking a written verdict file against its input."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import validate
from riskloom.sources.jsonl import read_jsonl_numbered
from riskloom.sources.staging import stage
from riskloom.sources.tables import read_table


def validate_lines(
    lines: DataFrame, inputs: DataFrame | None, line: str = "line", value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """(summary, failures) of verdict lines; checked lines and id counts are staged for both."""
    checked = stage(validate.check_lines(lines, line, value), "checked-lines")
    ids = stage(validate.ledger(checked, inputs), "id-ledger")
    known = inputs is not None
    return (
        validate.summary(checked, ids, known),
        validate.all_failures(checked, ids, known),
    )


def validate_file(
    spark: SparkSession, verdict_path: str, transactions_path: str, multiline: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(summary, failures) of a verdict file; an unreadable input table is a failure itself.

    ``multiline`` says that quoted fields of the input table may hold line breaks.
    """
    lines = read_jsonl_numbered(spark, verdict_path)
    try:
        inputs = read_table(spark, transactions_path, multiline=multiline)
        inputs = inputs.select("transaction_id")
    except AnalysisException:
        inputs = None
    return validate_lines(lines, inputs)

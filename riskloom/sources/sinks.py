"""Writers.  Big results stay in as many part files as there are tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.operators.verdict import assert_records


def write_verdicts(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Verdict records as JSON lines with exactly the four keys, checked first."""
    assert_records(records).select(*fixed.VERDICT_FIELDS).write.mode(mode).json(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row nested report as one JSON document."""
    report.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_splits(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Prompt and completion pairs as JSON lines, one folder per split."""
    pairs.select("prompt", "completion", "split").write.mode(mode).partitionBy("split").json(path)


def write_explorer(
    rows: DataFrame,
    metrics: DataFrame,
    report: DataFrame | None,
    path: str,
    mode: str = "errorifexists",
    compression: str | None = None,
) -> None:
    """What a viewer shows, as JSON: ``rows``, ``metrics`` and, if there is one, ``report``.

    ``compression`` is that of the rows, whose field names fill most of a file; Spark reads it as it is.
    """
    rows.write.mode(mode).option("ignoreNullFields", False).json(f"{path}/rows", compression=compression)
    metrics.coalesce(1).write.mode(mode).json(f"{path}/metrics")
    if report is not None:
        text = report.select(F.to_json("doc").alias("value"))
        text.coalesce(1).write.mode(mode).text(f"{path}/report")

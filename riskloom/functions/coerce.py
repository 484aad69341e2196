"""Turning dirty text columns into typed ones (all JVM-side expressions)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import fixed

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# the number at the start of a text
ASCII_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_POSITIVE_INFINITY = ["inf", "+inf", "infinity", "+infinity"]
_NEGATIVE_INFINITY = ["-inf", "-infinity"]


_NA_LIST = ", ".join(f"'{token}'" for token in fixed.NA_TOKENS)


def missing_to_null(name: str) -> Column:
    """Text tokens that stand for a missing value become null."""
    return F.expr(f"CASE WHEN `{name}` NOT IN ({_NA_LIST}) THEN `{name}` END")


def strip_text(column: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.btrim(column, F.lit(fixed.TEXT_SPACE))


def to_number(column: Column) -> Column:
    """Text to double; whatever is not a plain decimal number, an exponent or inf is null.

    The pattern keeps out what a Spark cast would take (``1d``, ``1.5f``); the cast itself
    can then give neither NaN nor an error.
    """
    text = F.btrim(column, F.lit(fixed.ASCII_SPACE))
    word = F.lower(text)
    return (
        F.when(text.rlike(_NUMBER), text.try_cast("double"))
        .when(word.isin(_POSITIVE_INFINITY), F.lit(float("inf")))
        .when(word.isin(_NEGATIVE_INFINITY), F.lit(float("-inf")))
    )


def number_column(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a double without NaN; all null where the frame has no such column."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return to_number(F.col(name))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return F.col(name).cast("double")


def text_column(df: DataFrame, name: str, default: str | None = None) -> Column:
    """Column ``name`` as text, or a constant where the frame has no such column."""
    if name not in df.columns:
        return F.lit(default).cast("string")
    return F.col(name).cast("string")


def to_flag(column: Column) -> Column:
    """Yes/no words to 1.0/0.0; anything else, null too, counts as 0.0."""
    word = F.lower(strip_text(column.cast("string")))
    return F.when(word.isin(fixed.TRUE_WORDS), F.lit(1.0)).otherwise(F.lit(0.0))


def to_01(number: Column) -> Column:
    """Cut a number down to 0 or 1: null, fractions below one and negatives are 0."""
    return F.when(number >= 1, F.lit(1)).otherwise(F.lit(0))


def normalize_status(column: Column) -> Column:
    """One spelling per status: runs of white space to one blank, trimmed, upper case."""
    squeezed = F.regexp_replace(column.cast("string"), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.coalesce(F.upper(F.trim(squeezed)), F.lit("UNKNOWN"))


@dataclass(frozen=True)
class TimestampFormat:
    """A text layout: what it has to look like and how to write it as an ISO timestamp."""

    name: str
    pattern: str
    iso: str


# the layouts a format is guessed from, most specific first; times are zone-less
TIMESTAMP_FORMATS = [
    TimestampFormat(
        "datetime",
        r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}) +([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})$",
        "$1 $2",
    ),
    TimestampFormat(
        "datetime_fraction",
        r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}) +([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\.[0-9]{1,6})$",
        "$1 $2",
    ),
    TimestampFormat(
        "iso_t",
        r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})T([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})$",
        "$1 $2",
    ),
    TimestampFormat(
        "minutes", r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}) +([0-9]{1,2}:[0-9]{1,2})$", "$1 $2:00"
    ),
    TimestampFormat("date", r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})$", "$1 00:00:00"),
    TimestampFormat(
        "slashed",
        r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2}) +([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})$",
        "$1-$2-$3 $4",
    ),
    TimestampFormat(
        "month_first",
        r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) +([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})$",
        "$3-$1-$2 $4",
    ),
    TimestampFormat("month_first_date", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$1-$2 00:00:00"),
]
DEFAULT_FORMAT = TIMESTAMP_FORMATS[0]


def parse_timestamp(column: Column, formats: list[TimestampFormat] | None = None) -> Column:
    """Text to a zone-less timestamp by explicit layouts; anything else is null.

    One layout is the default, as a whole column is expected to follow one.  More layouts
    are tried in order.  Instants outside the nanosecond range count as unparseable.
    """
    parsed = []
    for layout in formats or [DEFAULT_FORMAT]:
        iso = F.regexp_replace(column, layout.pattern, layout.iso)
        parsed.append(F.when(column.rlike(layout.pattern), iso.try_cast("timestamp_ntz")))
    stamp = F.coalesce(*parsed)
    earliest = F.lit(fixed.EARLIEST_TS).cast("timestamp_ntz")
    latest = F.lit(fixed.LATEST_TS).cast("timestamp_ntz")
    return F.when(stamp.between(earliest, latest), stamp)


def guess_timestamp_format(df: DataFrame, name: str, order_by: list[str]) -> TimestampFormat:
    """The layout of the first non-null value, as a reader that infers one format would pick.

    One aggregate row reaches the driver.
    """
    present = df.where(F.col(name).isNotNull())
    first = present.agg(F.min_by(F.col(name), F.struct(*order_by)).alias("first"))
    tests = [F.col("first").rlike(layout.pattern) for layout in TIMESTAMP_FORMATS]
    hits = first.select(*tests).first()
    for layout, hit in zip(TIMESTAMP_FORMATS, hits):
        if hit:
            return layout
    return DEFAULT_FORMAT

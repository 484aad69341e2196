"""Small expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# a word: the longest run of characters other than blank, tab and line breaks
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(*parts: Column, digits: int = 15) -> Column:
    """The first hexadecimal digits of an MD5 over the parts, as a long; nulls count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, digits), 16, 10).cast("long")

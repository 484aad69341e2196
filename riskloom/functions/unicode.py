"""The one text step Spark has no built-in for: compatibility folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fold(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text)
    for char in set(folded):
        if not char.isprintable():
            folded = folded.replace(char, "")
    return folded


@F.pandas_udf(T.StringType())
def fold_printable(texts: pd.Series) -> pd.Series:
    """NFKC form without non-printable characters (controls, zero-width, odd spaces)."""
    return texts.map(_fold, na_action="ignore")

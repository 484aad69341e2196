"""The nine model features: building, filling and standardizing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions.coerce import number_column
from riskloom.functions.ranks import ColumnStats, column_stats, round_significant


def finite(column: Column) -> Column:
    """Infinities and NaN become null."""
    odd = column.isin(float("inf"), float("-inf")) | F.isnan(column)
    return F.when(~odd, column)


def add_features(df: DataFrame) -> DataFrame:
    """Add the feature columns, raw, with null for what is missing or infinite."""
    flag = lambda name: F.col(name).cast("double") if name in df.columns else F.lit(0.0)
    amount = number_column(df, "amount_filled")
    # fixed order of the features
    values = {
        "amt": F.log1p(F.greatest(amount, F.lit(0.0))),
        "ratio": number_column(df, "amount_to_account_avg_ratio"),
        "dist": number_column(df, "distance_from_home_km"),
        "t24": number_column(df, "txn_count_last_24h"),
        "tsince": number_column(df, "time_since_prev_txn_mins"),
        "hour": number_column(df, "hour"),
        "foreign": flag("is_foreign_transaction_b"),
        "newdev": flag("is_new_device_b"),
        "cardpresent": flag("is_card_present_b"),
    }
    # greatest() skips nulls; a missing amount must stay missing
    values["amt"] = F.when(amount.isNotNull(), values["amt"])
    return df.withColumns({f"f_{name}": finite(value) for name, value in values.items()})


FEATURE_COLUMNS = [f"f_{name}" for name in fixed.FEATURES]


def feature_stats(df: DataFrame) -> dict[str, ColumnStats]:
    return column_stats(df.select(*FEATURE_COLUMNS), FEATURE_COLUMNS)


def fills(stats: dict[str, ColumnStats]) -> dict[str, float]:
    """What replaces a null: the median, or 0 for a column without values."""
    return {n: 0.0 if stats[n].median is None else stats[n].median for n in FEATURE_COLUMNS}


def scales(stats: dict[str, ColumnStats]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation after filling; a constant column has scale 1.

    Rounded to 12 digits, so that they do not depend on how the rows are partitioned.
    """
    out = {}
    for name, fill in fills(stats).items():
        mean = round_significant(stats[name].imputed_mean(fill))
        deviation = round_significant(stats[name].imputed_std(fill))
        out[name] = (mean, deviation if deviation > 1e-12 * max(1.0, abs(mean)) else 1.0)
    return out


def scale_features(
    df: DataFrame, fill: dict[str, float], scale: dict[str, tuple[float, float]]
) -> DataFrame:
    """Fill and standardize the feature columns in place."""
    return df.withColumns(
        {
            name: (F.coalesce(F.col(name), F.lit(fill[name])) - F.lit(scale[name][0]))
            / F.lit(scale[name][1])
            for name in FEATURE_COLUMNS
        }
    )

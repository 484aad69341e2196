"""The scoring job: clean, deduplicate, link, fit once, score every transaction."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions.coerce import TimestampFormat
from riskloom.functions.ranks import exact_median
from riskloom.operators.anomaly import (
    Forest,
    fit_forest,
    normalize_score,
    score_forest,
    score_range,
)
from riskloom.operators.clean import clean_transactions, fill_amount, normalize_na
from riskloom.operators.dedupe import keep_first
from riskloom.operators.features import (
    FEATURE_COLUMNS,
    add_features,
    feature_stats,
    fills,
    scale_features,
    scales,
)
from riskloom.operators.link import link
from riskloom.operators.observed import Watch, unwatched
from riskloom.operators.rules import apply_rules
from riskloom.operators.verdict import decide, verdicts
from riskloom.sources.staging import stage

KEY = "transaction_id"
# what rules and features read of a linked row
SCORING_COLUMNS = [
    KEY, "amount", "amount_invalid", "ts_invalid", "hour", "status_clean",
    "is_foreign_transaction_b", "is_new_device_b", "is_card_present_b",
    "amount_to_account_avg_ratio", "distance_from_home_km", "txn_count_last_24h",
    "time_since_prev_txn_mins", "risk_rating", "kyc_status", "is_politically_exposed",
]


def deduplicated(transactions: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per transaction id, missing tokens as nulls.

    Exact copies share their id, so keeping the first row per id drops them as well and one
    shuffle does for both.
    """
    return keep_first(normalize_na(transactions), KEY, order_by)


def prepare(
    transactions: DataFrame,
    accounts: DataFrame,
    customers: DataFrame,
    order_by: list[str] | None = None,
    as_of: str = fixed.AS_OF,
    formats: list[TimestampFormat] | None = None,
    balance: bool = False,
    watch: Watch = unwatched,
) -> DataFrame:
    """Raw tables to one cleaned, linked row per transaction (lazy).

    ``order_by`` names the columns, common to the three tables, that say which row of a key
    is first.  ``watch`` sees the points of ``link`` and those named raw and kept: the
    transactions before and after deduplication.
    """
    raw = normalize_na(transactions)
    first = keep_first(watch("raw", raw), KEY, order_by)
    kept = watch("kept", first, F.count(KEY).alias("keys"))
    cleaned = clean_transactions(kept, as_of, formats)
    return link(
        cleaned,
        normalize_na(accounts),
        normalize_na(customers),
        account_order=order_by,
        customer_order=order_by,
        balance=balance,
        sized_by=raw,
        watch=watch,
    )


def scoring_columns(linked: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """What scoring reads of linked rows, and the columns to keep beside it.

    Cut before rows are staged, this spares the shuffles below all other columns too.
    """
    wanted = set(SCORING_COLUMNS) | set(keep or [])
    return linked.select(*[name for name in linked.columns if name in wanted])


@dataclass(frozen=True)
class ScoringModel:
    """Everything that was learned from a batch; frozen, it scores any other rows alike."""

    amount_median: float | None
    fill: dict[str, float]
    scale: dict[str, tuple[float, float]]
    forest: Forest
    raw_low: float | None = None
    raw_high: float | None = None


def valid_amount_median(linked: DataFrame) -> float | None:
    return exact_median(linked, F.when(~F.col("amount_invalid"), F.col("amount")))


def scaled_features(linked: DataFrame, model: ScoringModel) -> DataFrame:
    featured = add_features(fill_amount(linked, model.amount_median))
    return scale_features(featured, model.fill, model.scale)


def _fit_staged(featured: DataFrame, median: float | None, **forest_options) -> ScoringModel:
    stats = feature_stats(featured)
    fill, scale = fills(stats), scales(stats)
    rows = stats[FEATURE_COLUMNS[0]].rows
    scaled = scale_features(featured.select(KEY, *FEATURE_COLUMNS), fill, scale)
    return ScoringModel(median, fill, scale, fit_forest(scaled, KEY, rows, **forest_options))


def fit_trees(linked: DataFrame, **forest_options) -> ScoringModel:
    """All of a model but the range of its raw scores."""
    median = valid_amount_median(linked)
    featured = add_features(fill_amount(linked, median)).select(KEY, *FEATURE_COLUMNS)
    # nine numbers per row, parsed once for all passes over them
    return _fit_staged(stage(featured, "features"), median, **forest_options)


def raw_scores(linked: DataFrame, model: ScoringModel) -> DataFrame:
    """Rule scores, reasons and raw anomaly scores, beside all columns that came in."""
    scaled = scaled_features(linked, model)
    return score_forest(apply_rules(scaled), model.forest).drop(*FEATURE_COLUMNS)


def with_range(model: ScoringModel, raw: DataFrame) -> ScoringModel:
    low, high = score_range(raw)
    return replace(model, raw_low=low, raw_high=high)


def finish(raw: DataFrame, model: ScoringModel) -> DataFrame:
    """Raw scores to ``anom_score``, ``combined``, ``is_fraud`` and ``confidence``."""
    return decide(normalize_score(raw, model.raw_low, model.raw_high))


def fit(linked: DataFrame, **forest_options) -> ScoringModel:
    """Learn a model from a linked frame.

    The frame is read several times: stage it first if it is costly to work out.
    """
    model = fit_trees(linked, **forest_options)
    return with_range(model, score_forest(scaled_features(linked, model), model.forest))


def transform(linked: DataFrame, model: ScoringModel) -> DataFrame:
    """Score rows by a fitted model; lazy, no statistics are taken from the rows."""
    return finish(raw_scores(linked, model), model)


def score_linked(
    linked: DataFrame, keep: list[str] | None = None, **forest_options
) -> tuple[DataFrame, ScoringModel]:
    """Fit on a linked frame and score it; returns scored rows and the model.

    Raw scores are staged, so the trees run over the rows once, although the last step needs
    the range of all scores.  ``keep`` names the columns wanted beside the scores.
    """
    if keep is None:
        model = fit_trees(linked, **forest_options)
        raw = raw_scores(linked, model)
    else:
        median = valid_amount_median(linked)
        # rules and features parse the same numbers: one pass works out both
        ruled = apply_rules(add_features(fill_amount(linked, median)))
        names = dict.fromkeys([KEY, *keep, *FEATURE_COLUMNS, "rule_score", "reasons"])
        featured = stage(ruled.select(*names), "features")
        model = _fit_staged(featured, median, **forest_options)
        scaled = scale_features(featured, model.fill, model.scale)
        raw = score_forest(scaled, model.forest).select(*keep, "rule_score", "reasons", "anom_raw")
    raw = stage(raw, "raw")
    model = with_range(model, raw)
    return finish(raw, model), model


def score(
    transactions: DataFrame,
    accounts: DataFrame,
    customers: DataFrame,
    keep: list[str] | None = None,
    **options,
) -> tuple[DataFrame, ScoringModel]:
    """The whole job; returns scored rows and the model.

    Two tables are staged: the linked rows, which the statistics read by column, and the raw
    scores, so that the trees are run over the rows only once.  ``keep`` cuts both down to
    what scoring needs and the columns that are wanted afterwards.
    """
    linked = prepare(transactions, accounts, customers, **options)
    if keep is not None:
        linked = scoring_columns(linked, keep)
    return score_linked(stage(linked, "linked"), keep)


def score_verdicts(
    transactions: DataFrame,
    accounts: DataFrame,
    customers: DataFrame,
    response: Column | None = None,
    **options,
) -> DataFrame:
    """Verdict records for raw tables."""
    scored, _ = score(transactions, accounts, customers, keep=[KEY], **options)
    return verdicts(scored, response)

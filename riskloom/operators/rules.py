"""The rule engine: weighted predicates kept as data and compiled into one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions.coerce import number_column
from riskloom.operators.clean import is_high_risk, is_kyc_bad, is_politically_exposed


@dataclass(frozen=True)
class Rule:
    """Fires where ``test`` is true; null does not fire."""

    points: float
    reason: str
    test: Callable[[dict[str, Column]], Column]


# --- fixed values: tests, points and reasons, in the order in which they are added up ---------
RULES = [
    Rule(0.28, "amount far above account average", lambda s: s["ratio"] >= 5),
    Rule(0.18, "very large amount", lambda s: s["amount"] >= 100000),
    Rule(0.25, "new device on a foreign transaction", lambda s: s["new_device"] & s["foreign"]),
    Rule(0.10, "foreign transaction", lambda s: s["foreign"]),
    Rule(0.08, "first-time device", lambda s: s["new_device"]),
    Rule(0.15, "far from home location", lambda s: s["distance"] >= 500),
    Rule(0.10, "unusual late-night hour", lambda s: s["hour"] <= 5),
    Rule(0.12, "high transaction velocity in 24h", lambda s: s["count_24h"] >= 5),
    Rule(0.12, "rapid successive transactions", lambda s: s["since_previous"].between(0, 2)),
    Rule(0.08, "failed/reversed status", lambda s: s["status"].isin("FAILED", "REVERSED")),
    Rule(0.10, "customer rated high risk", lambda s: s["high_risk"]),
    Rule(0.06, "politically exposed customer", lambda s: s["exposed"]),
    Rule(0.08, "KYC not verified", lambda s: s["kyc_bad"]),
    Rule(0.06, "corrupt/invalid amount", lambda s: s["amount_invalid"]),
    Rule(0.05, "invalid timestamp", lambda s: s["ts_invalid"]),
]


def signals(df: DataFrame) -> dict[str, Column]:
    """The typed inputs of the rules from a cleaned, linked frame with ``amount_filled``."""
    flag = lambda name: (F.col(name) == 1) if name in df.columns else F.lit(False)
    return {
        "ratio": number_column(df, "amount_to_account_avg_ratio"),
        "amount": number_column(df, "amount_filled"),
        "distance": number_column(df, "distance_from_home_km"),
        "count_24h": number_column(df, "txn_count_last_24h"),
        "since_previous": number_column(df, "time_since_prev_txn_mins"),
        "hour": number_column(df, "hour"),
        "foreign": flag("is_foreign_transaction_b"),
        "new_device": flag("is_new_device_b"),
        "status": F.col("status_clean"),
        "high_risk": is_high_risk(df),
        "exposed": is_politically_exposed(df),
        "kyc_bad": is_kyc_bad(df),
        "amount_invalid": F.col("amount_invalid"),
        "ts_invalid": F.col("ts_invalid"),
    }


def apply_rules(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Add ``rule_score`` (points of the rules that fire, within 0..1) and ``reasons``.

    Each test is worked out once into a boolean array that score and reasons share.
    """
    rules = rules or RULES
    inputs = signals(df)
    fired = F.array(*[F.coalesce(rule.test(inputs), F.lit(False)) for rule in rules])
    out = df.withColumn("__fired", fired)
    hit = [F.col("__fired")[index] for index in range(len(rules))]
    points = [F.when(h, F.lit(rule.points)).otherwise(F.lit(0.0)) for h, rule in zip(hit, rules)]
    # floating sums depend on their order: keep the listed one
    score = reduce(lambda total, step: total + step, points, F.lit(0.0))
    # the first three texts: those of rules that fewer than three before them fired with
    before, texts = F.lit(0), []
    for h, rule in zip(hit, rules):
        texts.append(F.when(h & (before < 3), F.lit(rule.reason)))
        before = before + h.cast("int")
    return (
        out.withColumn("rule_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
        .withColumn(
            "reasons", F.when(before == 0, F.lit(fixed.NO_REASON)).otherwise(F.concat_ws(", ", *texts))
        )
        .drop("__fired")
    )

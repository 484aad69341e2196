"""How well predicted labels agree with given ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed

# fixed names of the scores
SCORES = ["agreement", "fraud_precision", "fraud_recall", "fraud_f1"]


def _scores(gold: Column, predicted: Column) -> list[Column]:
    positive = fixed.POSITIVE_LABEL
    gold_positive, said_positive = gold == positive, predicted == positive
    hits = F.count_if(gold_positive & said_positive)
    said, real = F.count_if(said_positive), F.count_if(gold_positive)
    total = F.count(F.lit(1))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    precision, recall = share(hits, said), share(hits, real)
    both = precision + recall
    f1 = F.when(both > 0, F.lit(2.0) * precision * recall / both).otherwise(F.lit(0.0))
    # no rows, no scores
    known = lambda value: F.when(total > 0, F.round(value, 4))
    agreement = F.when(total > 0, F.round(F.count_if(gold == predicted) / total, 4))
    return [
        agreement.alias("agreement"),
        known(precision).alias("fraud_precision"),
        known(recall).alias("fraud_recall"),
        known(f1).alias("fraud_f1"),
        total.alias("n"),
        real.alias("n_fraud_pseudo"),
    ]


def confusion_scores(
    df: DataFrame, gold: str = "gold", predicted: str = "predicted", by: list[str] | None = None
) -> DataFrame:
    """Agreement, precision, recall and F1 of the positive label, to four places."""
    scores = _scores(F.col(gold), F.col(predicted))
    return df.groupBy(*by).agg(*scores) if by else df.agg(*scores)


def compare_runs(
    scores: DataFrame, run: str, base: str = "base", tuned: str = "tuned",
    caveats: Sequence[str] = (),
) -> DataFrame:
    """One nested row of two runs and what changed between them, from scores per run.

    ``caveats`` are remarks for the reader of the document, kept as they are given.
    """
    fields = F.struct(*SCORES, "n", "n_fraud_pseudo")
    pick = lambda name: F.max(F.when(F.col(run) == name, fields))
    both = scores.agg(pick(base).alias("base_zero_shot"), pick(tuned).alias("fine_tuned_lora"))
    change = lambda name: F.round(
        F.col(f"fine_tuned_lora.{name}") - F.col(f"base_zero_shot.{name}"), 4
    )
    return both.select(
        "base_zero_shot",
        "fine_tuned_lora",
        change("agreement").alias("delta_agreement"),
        change("fraud_f1").alias("delta_fraud_f1"),
        F.array(*[F.lit(text) for text in caveats]).cast("array<string>").alias("caveats"),
    )

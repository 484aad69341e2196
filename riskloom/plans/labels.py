"""Labelled prompts from scored rows, and scores of the answers given to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.operators.dataset import prompt_pairs, split_exact
from riskloom.operators.evaluate import confusion_scores
from riskloom.operators.text import gold_label, parse_label


def labelled_splits(
    scored: DataFrame, seed: int = fixed.SEED, kinds: dict[str, str] | None = None
) -> DataFrame:
    """(transaction_id, split, prompt, completion) of scored rows."""
    # the split is found from the keys alone, before the prompts are built
    return prompt_pairs(split_exact(scored, seed=seed), ["transaction_id", "split"], kinds)


def answer_scores(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores of free-text ``answer`` against the ``completion`` of each pair."""
    judged = answers.withColumn("gold", gold_label(F.col("completion"))).withColumn(
        "predicted", parse_label(F.col("answer"))
    )
    return confusion_scores(judged, by=by)

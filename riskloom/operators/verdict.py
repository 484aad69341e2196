"""From rule and anomaly scores to verdict records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.operators.text import clean_generated, template_sentence


def decide(df: DataFrame, anomaly: str = "anom_score") -> DataFrame:
    """Add ``combined``, ``is_fraud`` (the cutoff counts in) and ``confidence``."""
    combined = F.lit(fixed.RULE_WEIGHT) * F.col("rule_score") + F.lit(
        fixed.ANOMALY_WEIGHT
    ) * F.col(anomaly)
    away = F.abs(F.col("combined") - F.lit(fixed.CUTOFF)) / F.lit(fixed.CONFIDENCE_SPAN)
    sure = F.lit(fixed.CONFIDENCE_LOW) + away * F.lit(fixed.CONFIDENCE_SCALE)
    bounded = F.least(
        F.greatest(sure, F.lit(fixed.CONFIDENCE_LOW)), F.lit(fixed.CONFIDENCE_HIGH)
    )
    return (
        df.withColumn("combined", combined)
        .withColumn("is_fraud", F.col("combined") >= F.lit(fixed.CUTOFF))
        .withColumn("confidence", F.rint(bounded * F.lit(100.0)) / F.lit(100.0))
    )


def verdicts(df: DataFrame, response: Column | None = None) -> DataFrame:
    """The four output fields; ``response`` is a column of generated sentences, if any."""
    if response is None:
        sentence = template_sentence(F.col("is_fraud"), F.col("reasons"))
    else:
        sentence = clean_generated(response, F.col("is_fraud"), F.col("reasons"))
    return df.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.col("is_fraud").cast("boolean").alias("is_fraud"),
        F.col("confidence").cast("double").alias("confidence"),
        sentence.alias("justification"),
    )


def first_rows(scored: DataFrame, rows: int, order_by: list[str]) -> DataFrame:
    """The first rows of a scored frame; taken after scoring, so statistics stay whole."""
    return scored.orderBy(*order_by).limit(rows)


def verdict_rate(df: DataFrame) -> DataFrame:
    """One row: flagged, not flagged, and the share of flagged to four places."""
    total = F.count(F.lit(1))
    flagged = F.count_if(F.coalesce(F.col("is_fraud"), F.lit(False)))
    return df.agg(
        flagged.alias("is_fraud_true"),
        (total - flagged).alias("is_fraud_false"),
        F.when(total > 0, F.round(flagged / total, 4)).alias("fraud_rate"),
    )


def assert_records(records: DataFrame) -> DataFrame:
    """Verdict records with the checks built in: a broken one fails the job that writes it.

    Fields and types are checked at once, values row by row as they pass, so nothing is
    evaluated twice.
    """
    kinds = [(field.name, field.dataType.simpleString()) for field in records.schema.fields]
    expected = list(zip(fixed.VERDICT_FIELDS, ["string", "boolean", "double", "string"]))
    if kinds != expected:
        raise AssertionError(f"verdict fields are {kinds}, not {expected}")
    sound = F.col("confidence").between(0.0, 1.0)
    for name in fixed.VERDICT_FIELDS:
        sound = sound & F.col(name).isNotNull()
    report = F.raise_error(
        F.concat(F.lit("broken verdict record: "), F.to_json(F.struct(*fixed.VERDICT_FIELDS)))
    )
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("confidence")).otherwise(
        report.cast("double")
    )
    return records.withColumn("confidence", checked)

"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.keys import hash_of


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether the row's id, hashed by CRC-32 of its text, falls in the fold that is not learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id`` and ``label`` (0 or 1) to learn from, one row per id.

    Ids in the held-out fold, null ids, ids without a label or with labels that disagree are left out.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other").select("doc_id", "label")
    )


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``text`` and ``label`` (0 or 1) of at most about ``per_class`` documents of each class.

    Labels are those of ``known_labels``. Which documents are taken depends on a hash of the id alone. Ids are looked up among
    the chosen labels, of bounded number, so the documents are not shuffled. Rows that repeat an id are one
    document, the smallest text, so the sample is bounded whatever the table holds.
    """
    known = known_labels(labels, label)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, per_class / n))) for k, n in counts.items()], F.lit(0.0))
    chosen = known.where(hash_of(F.lit("sample"), F.col("doc_id"), digits=8) < share * F.lit(16**8))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).drop("doc_id")

"""Quality scores by Bradley-Terry pairwise ranking over surface features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.ranks import exact_ranks
from riskloom.llm.labelled import held_out, known_labels
from riskloom.sources.staging import release, stage

KNOTS = [0.0, 0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98, 1.0]
# at least so many preference pairs, and documents of the smaller class in a group to draw from
PAIRS = 20_000
GROUP = 64
# pairs worked on at once, and tasks whose sums go to the driver
STRETCH = 2_000
TASKS = 256
ACCEPTED = 0.7

# classes of bytes: 0 other, 1 blank, 2 line end, 3 lower, 4 upper, 5 digit, 6 end of sentence,
# 7 comma-like, 8 other sign, 9 beyond ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]] = 1
_CLASS[[10, 11, 12, 13]] = 2
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 3, 4, 5, 9
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 8
_CLASS[[ord(c) for c in ".?!"]], _CLASS[[ord(c) for c in ",;:'\"-()"]] = 6, 7


def features(text: str | None) -> list[float]:
    """Shares and lengths that describe how a text is written; of the whole text, 0 for an empty one."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10).astype(float)
    seen = len(data) - kinds[1] - kinds[2]
    letters = max(kinds[3] + kinds[4] + kinds[9], 1)
    lengths = np.fromiter(map(len, words), np.int32, n)
    distinct = set(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    ends = kinds[6]
    return [
        np.log1p(n), np.log1p(letters / n), np.log1p(lengths.std()), np.log1p(lengths.max()),
        kinds[4] / letters, kinds[5] / seen, ends / n, kinds[7] / n, np.log1p(10 * kinds[8] / n),
        (lengths == 1).mean(), (lengths > 20).mean(), len(distinct) / n, np.log(len(distinct) + 1) / np.log(n + 1),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(n / (ends + 1)),
        float(data.count(b"!")) / n, float(data.count(b"|")) / n, float(data.count(b"http")) / n,
        float(n < 20), kinds[9] / letters, kinds[0] / len(data),
    ]


FEATURES = 22


@F.pandas_udf(T.ArrayType(T.FloatType()))
def feature_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features(t) for t in texts])


@dataclass
class Model:
    """Knots of the features' value ranges, and weights of the places in them."""

    knots: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Each feature as its share of every range between neighbouring knots: 0 below, 1 above."""
        low, high = self.knots[:, :-1], self.knots[:, 1:]
        wide = np.maximum(high - low, 1e-9)
        return np.clip((x[:, :, None] - low) / wide, 0, 1).reshape(len(x), -1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Strength against the threshold, between 0 and 1; the threshold itself gets ``ACCEPTED``."""
        at = (self.strength(x) - self.threshold) * self.slope + np.log(ACCEPTED / (1 - ACCEPTED))
        return 1 / (1 + np.exp(-np.clip(at, -50, 50)))


def learned_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id``, ``x`` (features) and ``label`` of every document that may be learned from.

    Rows that repeat an id are one document, that of the smallest features. Features are joined
    with the labels, so no text is shuffled.
    """
    found = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", feature_vector("text").alias("x"))
    joined = found.join(known_labels(labels, label), "doc_id")
    return joined.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("label").alias("label"))


def preference_pairs(rows: DataFrame, counts: dict[int, int], least: int = PAIRS) -> DataFrame:
    """Pairs ``good``, ``bad`` of features: every document of the larger class against one of the other.

    The smaller class is dealt by hash into groups of about ``GROUP``, of which a pair takes one
    document by another hash, so its documents are used about equally often. The larger class
    goes round until there are ``least`` pairs.
    """
    fewer, more = sorted((0, 1), key=lambda k: (counts[k], k))
    groups, rounds = max(1, counts[fewer] // GROUP), -(-max(least, counts[more]) // counts[more])
    held = rows.where(F.col("label") == fewer).groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("group"))
    held = held.agg(F.array_sort(F.collect_list(F.struct("doc_id", "x"))).alias("others"))
    round_of = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")
    taken = rows.where(F.col("label") == more).select("doc_id", "x", round_of)
    taken = taken.withColumn("group", F.pmod(F.xxhash64("round", "doc_id"), F.lit(groups)))
    at = F.pmod(F.xxhash64("doc_id", "round"), F.size("others")).cast("int")
    met = taken.join(held, "group").select("x", F.get("others", at)["x"].alias("other"))
    good, bad = ("other", "x") if fewer == 1 else ("x", "other")
    return met.select(F.col(good).alias("good"), F.col(bad).alias("bad"))


def _slopes(model: Model):
    """Sums of gradient and curvature of the logistic loss over pairs, one row per task."""
    size = len(model.weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gradient, curve = np.zeros(size), np.zeros((size, size))
        for b in batches:
            for start in range(0, len(b), STRETCH):
                good, bad = (np.stack(b[c].iloc[start : start + STRETCH].tolist()).astype(float) for c in ("good", "bad"))
                diff = model.expand(good) - model.expand(bad)
                p = 1 / (1 + np.exp(np.clip(diff @ model.weights, -50, 50)))
                gradient += diff.T @ p
                curve += (diff * (p * (1 - p))[:, None]).T @ diff
        yield pd.DataFrame({"sums": [np.r_[gradient, curve[np.triu_indices(size)]]]})

    return run


def fit(rows: DataFrame, least_pairs: int = PAIRS, ridge: float = 1.0) -> Model:
    """Fit on all rows ``doc_id``, ``x`` (features), ``label``; staged, as they are read several times.

    Preference pairs set a good document against a bad one. The strengths minimise the logistic
    loss of their differences, by Newton steps whose sums over the pairs are worked out where
    these lie: the driver gets at most ``TASKS`` rows a step. Knots are ranks of all rows, off by
    at most a ten-thousandth. The threshold is the exact quantile of all strengths below which as
    many documents lie as are labelled bad.
    """
    spark = rows.sparkSession
    found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    counts = {k: found.get(k, 0) for k in (0, 1)}
    size = FEATURES * (len(KNOTS) - 1)
    if not counts[0] or not counts[1]:
        return Model(np.zeros((FEATURES, len(KNOTS))), np.zeros(size), -np.inf if counts[1] else np.inf, 1.0)
    knots = rows.agg(*[F.percentile_approx(F.col("x")[i], KNOTS, 10_000).alias(f"k{i}") for i in range(FEATURES)]).first()
    model = Model(np.array([list(k) for k in knots], float), np.zeros(size), 0.0, 1.0)
    pairs = stage(preference_pairs(rows, counts, least_pairs), "quality-pairs")
    upper = np.triu_indices(size)
    for _ in range(15):
        parts = pairs.coalesce(TASKS).mapInPandas(_slopes(model), "sums array<double>").collect()
        total = np.sum([r["sums"] for r in parts], axis=0)
        curve = np.zeros((size, size))
        curve[upper] = total[size:]
        curve = curve + np.triu(curve, 1).T + ridge * np.eye(size)
        step = np.linalg.solve(curve, total[:size] - ridge * model.weights)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break
    release(spark, pairs)

    @F.pandas_udf("double")
    def strength(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.strength(np.array(b.tolist(), float).reshape(len(b), FEATURES)))

    strengths = stage(rows.select(strength("x").alias("s")), "quality-strengths")
    model.threshold = sum(exact_ranks(strengths, F.col("s"), [counts[0] - 1, counts[0]])) / 2
    release(spark, strengths)
    return model


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Column:
    """A column of quality scores of ``text`` for frames with the rows of ``docs``.

    Learned from all labelled documents outside the held-out fold. Scores lie in 0..1 and are
    ``ACCEPTED`` at the threshold. Null and empty texts have all features 0 and are scored like
    any other. Without any usable label all scores are 0.5; with one class only, all are near
    that class.
    """
    if known_labels(labels, label).isEmpty():
        return F.lit(0.5)
    rows = stage(learned_rows(docs, labels, label), "quality-rows")
    model = fit(rows)
    release(docs.sparkSession, rows)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], np.float32).reshape(len(texts), FEATURES)
            yield pd.Series(model.score(x.astype(float)))

    return score("text")

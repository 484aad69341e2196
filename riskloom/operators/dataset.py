"""Labelled prompt pairs and their exact, reproducible split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.operators.clean import as_read
from riskloom.operators.text import completion, feature_prompt, gold_label, sanitize

# hex digits of the hash looked at per counting job: at most 16 ** 3 groups per cut
STEP = 3
HASH_DIGITS = 32


def prompt_pairs(
    scored: DataFrame, keep: list[str] | None = None, kinds: dict[str, str] | None = None
) -> DataFrame:
    """Prompt and completion of scored rows, beside the columns to keep.

    ``kinds`` are inferred types of text columns (``infer_numbers``), for numbers to be shown
    as numbers; without them text is shown as it was read.
    """
    safe = sanitize(as_read(scored, kinds) if kinds else scored, "merchant_name")
    return safe.select(
        *(keep or ["transaction_id"]),
        feature_prompt(safe).alias("prompt"),
        completion(F.col("is_fraud")).alias("completion"),
    )


def shuffle_hash(key: Column, seed: int = fixed.SEED) -> Column:
    """Where a row stands in the seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def _count_prefixes(hashes: DataFrame, prefixes: set[str], length: int) -> list:
    """Rows and least hash per longer prefix: at most 16 ** STEP rows per given prefix."""
    if prefixes != {""}:
        known = length - STEP
        hashes = hashes.where(F.substring("h", 1, known).isin(sorted(prefixes)))
    return (
        hashes.groupBy(F.substring("h", 1, length).alias("p"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
        .orderBy("p")
        .collect()
    )


def _cuts(hashes: DataFrame, shares: tuple[float, ...]) -> list[str | None]:
    """The hashes at which each share of the rows is full, by counting ever longer prefixes."""
    counts = _count_prefixes(hashes, {""}, STEP)
    if counts and counts[0]["p"] is None:
        raise ValueError("the split key has nulls")
    rows = sum(row["n"] for row in counts)
    # rows still to pass before a cut, per cut; cuts lie at the ends of whole-numbered shares
    ahead, total = {}, 0
    for number, share in enumerate(shares):
        total += int(rows * share)
        ahead[number] = ("", total)
    found: dict[int, str | None] = {}
    length = STEP
    while ahead:
        following = {}
        for number, (prefix, rank) in ahead.items():
            found[number] = None
            for row in (r for r in counts if r["p"].startswith(prefix)):
                if rank < row["n"]:
                    if rank == 0:
                        found[number] = row["least"]
                    else:
                        following[number] = (row["p"], rank)
                    break
                rank -= row["n"]
        ahead = following
        if ahead and length >= HASH_DIGITS:
            raise ValueError("the split key is not unique: rows share the hash at a cut")
        if ahead:
            length += STEP
            counts = _count_prefixes(hashes, {prefix for prefix, _ in ahead.values()}, length)
    return [found[number] for number in range(len(shares))]


def split_exact(
    df: DataFrame,
    key: str = "transaction_id",
    seed: int = fixed.SEED,
    shares: tuple[float, float] = (0.8, 0.1),
) -> DataFrame:
    """Add ``split``: train, valid and test of exact sizes, in the order of a seeded hash.

    Sizes are the whole parts of the shares, test gets the rest.  Only the two cut points
    are searched, by counting, so rows neither move nor get sorted.  Keys have to be unique.
    """
    hashes = df.select(shuffle_hash(F.col(key), seed).alias("h"))
    first_valid, first_test = _cuts(hashes, shares)
    place = shuffle_hash(F.col(key), seed)
    before = lambda cut: F.lit(True) if cut is None else place < F.lit(cut)
    return df.withColumn(
        "split",
        F.when(before(first_valid), F.lit("train"))
        .when(before(first_test), F.lit("valid"))
        .otherwise(F.lit("test")),
    )


def split_sizes(pairs: DataFrame) -> DataFrame:
    """Rows and share of positive labels (four places) per split."""
    positive = F.count_if(gold_label(F.col("completion")) == fixed.POSITIVE_LABEL)
    total = F.count(F.lit(1))
    return pairs.groupBy("split").agg(
        total.alias("rows"), F.round(positive / total, 4).alias("positive_rate")
    )


def split_summary(pairs: DataFrame) -> DataFrame:
    """One row: total, rows per split and the overall share of positive labels."""
    positive = F.count_if(gold_label(F.col("completion")) == fixed.POSITIVE_LABEL)
    total = F.count(F.lit(1))
    return pairs.agg(
        total.alias("total"),
        *[F.count_if(F.col("split") == name).alias(name) for name in ("train", "valid", "test")],
        F.when(total > 0, F.round(positive / total, 4)).alias("pseudo_fraud_rate"),
    )

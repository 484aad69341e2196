"""A training corpus from raw documents: five stages, each one of the operators in ``riskloom.llm``.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last have the columns
of ``docs``. Classifiers learn from the given ``documents`` and ``labels``, whatever the stages
before have left of them, and then judge the documents of their own stage.

For every stage: columns that the operators do not read are carried along whatever their names and
values, those that an operator adds are never kept; an empty table gives an empty result; texts are read whole, however
long. What a stage does with nulls, repeated rows and ties is said at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, mixing, partenum, quality, toxicity
from riskloom.llm.queries import VOCABULARY
from riskloom.sources.staging import stage

TOXIC = 0.3


def _given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the threshold of the pairwise ranking.

    A row's text alone decides: null and empty texts have the score of no features, repeated rows stay or go together,
    a score equal to the threshold stays. Null ids stay with their text.
    """
    score = quality.scores(_given(spark, sf_dir, "documents"), _given(spark, sf_dir, "labels"))
    return docs.where(score >= quality.ACCEPTED)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``; one that equals it goes.

    A row's text alone decides: null and empty texts have no evidence against them, repeated rows stay or go together.
    """
    lexicon = toxicity.train(_given(spark, sf_dir, "documents"), _given(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(lexicon) < TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles, that with the smallest id.

    Texts that are null, empty or without words link with nothing and stay. Rows without an id stay, as no
    id is smaller; rows that repeat an id stay or go together.
    """
    return partenum.one_of_each(docs, words=5, num=80, den=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by their weights: documents as often as they are taken, up to twice.

    A null source is a source, a null id an id; null and empty texts have no words and come in with their
    place in the order. Rows equal in id and text are interchangeable; other ties are ordered by id and text.
    """
    return mixing.mixture(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, as digests, with those of the text decoded from them.

    A null text has no ids, like an empty one. Repeated rows are coded each, a null id or source is returned as it is.
    """
    codec = bpe.round_trip(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    coded = docs.select("doc_id", "source", codec("text").alias("c"))
    return coded.select(
        "doc_id", "source", "c.n_tokens", F.sha2("c.ids", 256).alias("ids_sha256"),
        F.sha2("c.decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_filter),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE", byte_bpe),
]

# learned classifiers, sets of shingles and byte-pair merges have no counterpart in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; each one's result is written and read again by the next."""
    docs = _given(spark, sf_dir, "documents")
    for number, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, f"stage-{number + 1}")
    return docs

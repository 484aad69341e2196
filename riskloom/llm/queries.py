"""One query per operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    ann, bpe, mixing, negatives, partenum, pii, pitman_yor, quality, sharding, topk, toxicity, warc, whitening,
)
from riskloom.llm.labelled import held_out
from riskloom.llm.sql import ORACLES as ORACLES

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(_read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), 40)


def slot_map_rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that edits the slot map of op4 for one more shard: where each document was, and where it goes."""
    return sharding.rebalanced(_read(spark, sf_dir, "documents"), 40, 41)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def _scored(df: DataFrame, accepted: float) -> DataFrame:
    return df.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accepted).cast("int").alias("predicted")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return _scored(docs.select("doc_id", toxicity.scorer(lexicon).alias("score")), 0.3)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.round_trip(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    coded = _read(spark, sf_dir, "documents").select("doc_id", codec("text").alias("c"))
    return coded.select(
        "doc_id", "c.n_tokens", F.sha2("c.ids", 256).alias("ids_sha256"), F.sha2("c.decoded", 256).alias("decoded_sha256")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    score = quality.scores(docs, _read(spark, sf_dir, "labels"))
    return _scored(docs.select("doc_id", score.alias("score")), quality.ACCEPTED)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(_read(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(folds=10, fold=0)
    scored = pitman_yor.score(_read(spark, sf_dir, "documents"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = _read(spark, sf_dir, "embeddings").withColumn("label", moved)
    rows = negatives.labelled_vectors(table, "vec_id", "embedding", "label", 256)
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_top_k, op2_warc, op3_source_mixing, op4_sharding, op5_nearest_neighbours, op6_toxicity,
        op7_byte_bpe, op8_quality, op9_ngram_jaccard, op10_pitman_yor,
        op11_hard_negatives, op12_whitening, op13_private_data, slot_map_rebalanced,
    )
}

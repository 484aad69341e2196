"""Vectors packed into blocks, and the grid of query blocks against candidate blocks.

Both sides are hashed by id into blocks of bounded size. A block of either side is sent once to
each block of the other, so a task holds one small matrix of each and no row meets another
outside a tile. The number of vectors only changes the number of tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.staging import stage

PACKED = "dim int, block int, ids binary, matrix binary"


def usable_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``v`` (array of double), one row per id.

    Vectors that are null, empty, or hold null or non-finite components are left out, as are
    null ids. If rows repeat an id, the smallest vector (by array order) stands for it.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")
    )
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & finite)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def block_count(rows: int, block_rows: int, least: int = 1) -> int:
    """Blocks needed for ``rows``; ``least`` of them keep the cores of a small run busy."""
    return max(1, math.ceil(rows / block_rows), min(least, math.ceil(rows / 256)))


def pack(rows: DataFrame, blocks: int, value: Column, kind: str) -> DataFrame:
    """Rows ``id``, ``v`` as one row per (dim, block): sorted ids and a matrix, both as bytes.

    ``value`` gives the stored components from ``v``, ``kind`` is their numpy type. A block
    gathers its hash share of the rows, about the caller's block size.
    """
    grouped = (
        rows.select(
            F.size("v").alias("dim"),
            F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
            "id", value.alias("x"),
        )
        .groupBy("dim", "block")
        .agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("rows"))
        .select("dim", "block", F.col("rows.id").alias("ids"), F.flatten("rows.x").alias("x"))
    )

    def to_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                {
                    "dim": b["dim"], "block": b["block"],
                    "ids": [np.asarray(i, np.int64).tobytes() for i in b["ids"]],
                    "matrix": [np.asarray(x).astype(kind).tobytes() for x in b["x"]],
                }
            )

    return grouped.mapInPandas(to_bytes, PACKED)


def grid(queries: DataFrame, candidates: DataFrame, query_blocks: int, candidate_blocks: int) -> DataFrame:
    """Every query block beside every candidate block of its dimension.

    The partition count is the number of tiles, so a task holds about one; it is bounded by
    65,536, past which tasks take several tiles one after the other.
    """
    tiles = min(query_blocks * candidate_blocks, 65_536)
    keys = ["dim", "qblock", "cblock"]
    left = queries.select(
        "dim", F.col("block").alias("qblock"),
        F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))).alias("cblock"),
        *[F.col(c).alias(f"q_{c}") for c in queries.columns if c not in ("dim", "block")],
    )
    right = candidates.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qblock"),
        F.col("block").alias("cblock"), F.col("ids").alias("c_ids"), F.col("matrix").alias("c_matrix"),
    )
    return left.repartition(tiles, *keys).join(right.repartition(tiles, *keys), keys)


def staged_blocks(
    rows: DataFrame, is_query: Column, value: Column, kind: str, query_rows: int, candidate_rows: int
) -> tuple[DataFrame, DataFrame, int, int]:
    """Packed query and candidate blocks as written tables, and how many of each."""
    rows = stage(rows, "vectors")
    n, q = rows.agg(F.count("*"), F.count_if(is_query)).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    query_blocks = block_count(q, query_rows)
    candidate_blocks = block_count(n, candidate_rows, least=2 * cores)
    queries = stage(pack(rows.where(is_query), query_blocks, value, kind), "query-blocks")
    candidates = stage(pack(rows, candidate_blocks, value, kind), "candidate-blocks")
    return queries, candidates, query_blocks, candidate_blocks


def matrix_of(data: bytes, ids: np.ndarray, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(len(ids), -1)

"""Exact top-k inner-product search by distributed histogram selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.blocks import grid, matrix_of, staged_blocks, usable_vectors
from riskloom.sources.staging import stage

BINS = 512
QUERY_ROWS = 4_096
CANDIDATE_ROWS = 16_384
TILE_QUERIES = 128
RANGES = "query_id long, n long, least long, kth long, most long"
COUNTS = "query_id long, bin int, n long"
HITS = "query_id long, vec_id long, score long"


def scaled(v: str, scale: int) -> Column:
    """floor(scale * x) of every component, held within a range whose inner products fit a long.

    That range lies within 32 bits, which is how components are packed.
    """
    most = F.floor(F.sqrt(F.lit(2.0**61) / F.size(v)))
    return F.transform(v, lambda x: F.greatest(-most, F.least(most, F.floor(scale * x))))


def _tiles(row) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Scores of a few queries at a time against one candidate block, exact; own ids masked."""
    q_ids, c_ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.c_ids, np.int64)
    q, c = matrix_of(row.q_matrix, q_ids, "<i4"), matrix_of(row.c_matrix, c_ids, "<i4")
    bound = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    q, c = q.astype(kind), c.astype(kind).T
    for start in range(0, len(q_ids), TILE_QUERIES):
        part = slice(start, start + TILE_QUERIES)
        ids = q_ids[part]
        scores = (q[part] @ c).astype(np.int64)
        at = np.searchsorted(c_ids, ids)
        own = (at < len(c_ids)) & (c_ids[np.minimum(at, len(c_ids) - 1)] == ids)
        yield part, ids, c_ids, scores, np.where(own, at, -1)


def _ranges(k: int):
    """Per query and block: candidates, lowest, k-th highest (if there are k) and highest score."""

    def run(batches):
        for b in batches:
            for row in b.itertuples():
                for _, ids, _, scores, own in _tiles(row):
                    rows = np.arange(len(ids))
                    n = scores.shape[1] - (own >= 0)
                    least_of = scores.copy()
                    least_of[rows[own >= 0], own[own >= 0]] = np.iinfo(np.int64).max
                    scores[rows[own >= 0], own[own >= 0]] = np.iinfo(np.int64).min
                    m = scores.shape[1]
                    kth = np.partition(scores, m - k, axis=1)[:, m - k] if m >= k else scores[:, 0]
                    out = pd.DataFrame(
                        {
                            "query_id": ids, "n": n, "least": least_of.min(axis=1),
                            "kth": pd.array(np.where(n >= k, kth, 0), "Int64"), "most": scores.max(axis=1),
                        }
                    )
                    out.loc[n < k, "kth"] = pd.NA
                    yield out[n > 0]

    return run


def _state(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """low, high and need of the block's queries, in the order of its ids; low > high: none."""
    ids = np.frombuffer(row.q_ids, np.int64)
    low, high, need = np.ones(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    at = np.searchsorted(ids, np.asarray(row.q_state_id, np.int64))
    low[at], high[at], need[at] = row.q_low, row.q_high, row.q_need
    return low, high, need


def _histogram(bins: int):
    """Counts per query and bin of the scores between the query's low and high."""

    def run(batches):
        for b in batches:
            for row in b.itertuples():
                low, high, _ = _state(row)
                for part, ids, _, scores, own in _tiles(row):
                    a, z = low[part, None], high[part, None]
                    inside = (scores >= a) & (scores <= z)
                    inside[np.nonzero(own >= 0)[0], own[own >= 0]] = False
                    i, j = np.nonzero(inside)
                    width = -(-(high[part] - low[part] + 1) // bins)
                    bin_of = (scores[i, j] - low[part][i]) // np.maximum(width[i], 1)
                    key, n = np.unique(i * bins + bin_of, return_counts=True)
                    yield pd.DataFrame({"query_id": ids[key // bins], "bin": (key % bins).astype(np.int32), "n": n})

    return run


def _hits(batches):
    """Scores above the k-th value, and of those equal to it the smallest ids that are needed."""
    for b in batches:
        for row in b.itertuples():
            low, high, need = _state(row)
            for part, ids, c_ids, scores, own in _tiles(row):
                rows = np.nonzero(own >= 0)[0]
                above, ties = scores > low[part, None], scores == low[part, None]
                above[rows, own[rows]] = ties[rows, own[rows]] = False
                none = low[part] > high[part]
                above[none] = ties[none] = False
                ties &= np.cumsum(ties, axis=1) <= need[part, None]
                i, j = np.nonzero(above | ties)
                yield pd.DataFrame({"query_id": ids[i], "vec_id": c_ids[j], "score": scores[i, j]})


def _with_state(queries: DataFrame, state: DataFrame) -> DataFrame:
    """Query blocks with the state of their queries; a block holds a bounded number of them."""
    return queries.join(state, ["dim", "block"], "left_outer").where(F.col("state_id").isNotNull())


def top_k(
    df: DataFrame, is_query: Column, k: int, id_column: str = "vec_id",
    vector_column: str = "embedding", scale: int = 64, bins: int = BINS,
    query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """The ``k`` highest integer inner products of each query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``id``. Components become floor(scale * x). Every query is
    scored against every other row, block by block. A first pass bounds the k-th value of each
    query, further passes count scores in ``bins`` equal bins of that range over all blocks and
    go on in the bin that holds the k-th, until it is one score wide. The last pass keeps what
    lies above it and breaks ties to the smaller id. A pass adds at most the scores inside a
    range that no block's own k-th exceeds, so little is shuffled.

    Null ids and vectors that are null, empty or hold null or non-finite components take no part;
    rows repeating an id count once; only vectors of one dimension meet. Components so large
    that inner products could leave the range of a long are held at its bound. Queries with
    fewer than ``k`` candidates get all of them, without candidates no row. An empty table gives
    an empty result. Other columns are ignored.
    """
    rows = usable_vectors(df, id_column, vector_column)
    queries, candidates, qn, cn = staged_blocks(
        rows, is_query, scaled("v", scale), "<i4", query_rows, candidate_rows
    )
    tiles = grid(queries, candidates, qn, cn)
    where = rows.where(is_query).select(
        F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(qn)).cast("int").alias("block"),
        F.col("id").alias("query_id"),
    )
    state = (
        tiles.mapInPandas(_ranges(k), RANGES)
        .groupBy("query_id")
        .agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("kth").alias("kth"), F.max("most").alias("high"))
        .select("query_id", F.coalesce("kth", "least").alias("low"), "high", F.least("n", F.lit(k)).alias("need"))
    )
    state = stage(state.join(where, "query_id"), "topk-state")
    wide = state.agg(F.max(F.col("high") - F.col("low"))).first()[0]

    def blocks_with(state: DataFrame) -> DataFrame:
        packed = state.groupBy("dim", "block").agg(
            F.array_sort(F.collect_list(F.struct("query_id", "low", "high", "need"))).alias("s")
        )
        packed = packed.select(
            "dim", "block", F.col("s.query_id").alias("state_id"), F.col("s.low").alias("low"),
            F.col("s.high").alias("high"), F.col("s.need").alias("need"),
        )
        return grid(_with_state(queries, packed), candidates, qn, cn)

    for _ in range(math.ceil(64 / math.log2(bins)) + 1):
        if not wide:
            break
        counts = blocks_with(state).mapInPandas(_histogram(bins), COUNTS).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        found = (
            counts.withColumn("upto", F.sum("n").over(down))
            .join(state, "query_id")
            .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        )
        width = F.ceil((F.col("high") - F.col("low") + 1) / F.lit(bins)).cast("long")
        low = F.col("low") + F.col("bin") * width
        found = found.select(
            "query_id", low.alias("low"), F.least("high", low + width - 1).alias("high"),
            (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"), "dim", "block",
        )
        state = stage(found, "topk-state")
        wide = state.agg(F.max(F.col("high") - F.col("low"))).first()[0]

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        blocks_with(state)
        .mapInPandas(_hits, HITS)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

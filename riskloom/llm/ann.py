"""Nearest neighbours by a block matrix join over int8 tiles with error bounds."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.blocks import grid, matrix_of, staged_blocks, usable_vectors

QUERY_ROWS = 4_096
CANDIDATE_ROWS = 16_384
TILE_QUERIES, TILE_CANDIDATES = 128, 4_096
SLACK = 1e-6  # rounding of the float32 tile and of the bounds themselves
HITS = "query_id long, vec_id long, score double"


def _unit_range(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, largest component in [0.5, 1): cosines stay, nothing overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _norms(x: np.ndarray) -> np.ndarray:
    """Square roots of sums added in component order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * x[:, j]
    return np.sqrt(total)


def _quantised(x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their step, length of the coded vector, length of the error."""
    unit = x / norms[:, None]
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    coded = codes * step[:, None]
    return codes, step, np.linalg.norm(coded, axis=1), np.linalg.norm(unit - coded, axis=1)


def cosine(q: np.ndarray, c: np.ndarray, q_norm: np.ndarray, c_norm: np.ndarray) -> np.ndarray:
    """Cosines of matching rows in double precision, products added in component order."""
    dot = np.zeros(len(q))
    for j in range(q.shape[1]):
        dot += q[:, j] * c[:, j]
    return dot / (q_norm * c_norm)


def _nearest(k: int):
    def run(batches):
        for b in batches:
            for row in b.itertuples():
                q_ids, c_ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.c_ids, np.int64)
                q = _unit_range(matrix_of(row.q_matrix, q_ids, "<f8"))
                c = _unit_range(matrix_of(row.c_matrix, c_ids, "<f8"))
                q_norm, c_norm = _norms(q), _norms(c)
                q_code, q_step, q_len, q_err = _quantised(q, q_norm)
                c_code, c_step, c_len, c_err = _quantised(c, c_norm)
                heaps: list[list] = [[] for _ in q_ids]
                for a in range(0, len(q_ids), TILE_QUERIES):
                    qs = slice(a, a + TILE_QUERIES)
                    worst = np.full(len(q_ids[qs]), -np.inf)
                    for z in range(0, len(c_ids), TILE_CANDIDATES):
                        cs = slice(z, z + TILE_CANDIDATES)
                        # int8 products summed in float32 are whole numbers below 2**24 up to 1040
                        # components; longer vectors are added in double
                        kind = np.float32 if q.shape[1] <= 1040 else np.float64
                        near = (q_code[qs].astype(kind) @ c_code[cs].astype(kind).T) * q_step[qs, None] * c_step[None, cs]
                        off = q_err[qs, None] + q_len[qs, None] * c_err[None, cs] + SLACK
                        own = q_ids[qs, None] == c_ids[None, cs]
                        near[own] = -np.inf
                        m = near.shape[1]
                        if m >= k:
                            kth = np.partition(near - off, m - k, axis=1)[:, m - k]
                            worst = np.maximum(worst, kth)
                        i, j = np.nonzero((near + off >= worst[:, None]) & ~own)
                        for s in range(0, len(i), 65_536):
                            x, y = i[s : s + 65_536] + a, j[s : s + 65_536] + z
                            score = cosine(q[x], c[y], q_norm[x], c_norm[y])
                            order = np.lexsort((c_ids[y], -score, x))
                            first = np.r_[True, np.diff(x[order]) != 0]
                            rank = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
                            for at in order[rank < k]:
                                entry = (score[at], -int(c_ids[y[at]]))
                                heap = heaps[x[at]]
                                if len(heap) < k:
                                    heapq.heappush(heap, entry)
                                else:
                                    heapq.heappushpop(heap, entry)
                        worst = np.maximum(worst, [h[0][0] if len(h) == k else -np.inf for h in heaps[qs]])
                rows = [(int(q_ids[n]), -i, s) for n, h in enumerate(heaps) for s, i in h]
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return run


def nearest(
    df: DataFrame, is_query: Column, k: int, id_column: str = "vec_id",
    vector_column: str = "embedding", query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """The ``k`` largest cosines of each query: query_id, rank, vec_id, score (double).

    ``is_query`` is a condition on ``id``. A tile multiplies int8 codes of unit vectors; the
    lengths of both quantisation errors bound how far a cosine can be from the tile's. Pairs
    whose upper bound reaches the k-th lower bound are computed again in double precision from
    the original vectors and merged in a heap per query, then over blocks. The bounds hold for
    every vector, so the result is exact, recall 1.

    Null ids and vectors that are null, zero, empty or hold null or non-finite components take no
    part; rows repeating an id count once; only vectors of one dimension meet. Ties go to the
    smaller id. Queries with fewer than ``k`` candidates get all, an empty table gives an empty
    result, other columns are ignored.
    """
    rows = usable_vectors(df, id_column, vector_column)
    rows = rows.where(F.exists("v", lambda x: x != 0))
    queries, candidates, qn, cn = staged_blocks(rows, is_query, F.col("v"), "<f8", query_rows, candidate_rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        grid(queries, candidates, qn, cn)
        .mapInPandas(_nearest(k), HITS)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

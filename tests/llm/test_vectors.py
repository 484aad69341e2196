"""Top-k and nearest neighbours against brute force, with every kind of odd vector."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, score int, block string, dim int"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=8).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(120)]  # a vector that very many rows share
    rows += [(500, None), (501, [NAN] * 8), (502, [1.0, INF] + [0.0] * 6), (503, [1.0, None] + [0.0] * 6), (504, [])]
    rows += [(520, [0.0] * 8), (540, [1.0, 2.0]), (541, [2.0, 1.0]), (560, [3e30] * 8), (None, [1.0] * 8), (7, rows[7][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def usable(rows):
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = v
    return kept


def expected(rows, score, step, k, skip=lambda v: False):
    kept = {i: v for i, v in usable(rows).items() if not skip(v)}
    out = []
    for q in sorted(i for i in kept if i % step == 0):
        found = [(score(kept[q], v), i) for i, v in kept.items() if i != q and len(v) == len(kept[q])]
        for rank, (s, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k], 1):
            out.append((q, rank, i, s))
    return out


def result(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("bins", [3, 512])
def test_top_k(spark, vectors, bins):
    def score(a, b):
        most = math.floor(math.sqrt(2.0**61 / len(a)))
        whole = [[max(-most, min(most, math.floor(64 * x))) for x in v] for v in (a, b)]
        return sum(x * y for x, y in zip(*whole))

    df = topk.top_k(frame(spark, vectors), F.col("id") % 20 == 0, 7, bins=bins, query_rows=4, candidate_rows=64)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert result(df) == expected(vectors, score, 20, 7)


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0]), (20, [2.0]), (3, [-1.0])]
    df = topk.top_k(frame(spark, rows), F.col("id") % 20 == 0, 20)
    assert result(df) == [(0, 1, 20, 64 * 128), (0, 2, 3, -64 * 64), (20, 1, 0, 64 * 128), (20, 2, 3, -128 * 64)]
    assert result(topk.top_k(frame(spark, [(0, [1.0])]), F.col("id") % 20 == 0, 20)) == []
    assert result(topk.top_k(frame(spark, []), F.col("id") % 20 == 0, 20)) == []


def test_nearest(spark, vectors):
    def cosine(a, b):
        sums = [0.0, 0.0, 0.0]
        scaled = [[math.ldexp(x, -math.frexp(max(map(abs, v)))[1]) for x in v] for v in (a, b)]
        for x, y in zip(*scaled):
            sums[0] += x * y
            sums[1] += x * x
            sums[2] += y * y
        return sums[0] / (math.sqrt(sums[1]) * math.sqrt(sums[2]))

    df = ann.nearest(frame(spark, vectors), F.col("id") % 20 == 0, 5, query_rows=4, candidate_rows=64)
    want = expected(vectors, cosine, 20, 5, skip=lambda v: not any(v))
    got = result(df)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-15)
    assert result(ann.nearest(frame(spark, []), F.col("id") % 20 == 0, 5)) == []


def test_error_bounds_hold():
    draw = np.random.default_rng(0)
    x, y = draw.normal(size=(50, 64)), draw.normal(size=(60, 64)) * draw.lognormal(size=(60, 1))
    a, b = ann._quantised(x, ann._norms(x)), ann._quantised(y, ann._norms(y))
    near = (a[0].astype(int) @ b[0].astype(int).T) * a[1][:, None] * b[1][None]
    exact = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None]
    assert np.all(np.abs(near - exact) <= a[3][:, None] + a[2][:, None] * b[3][None] + 1e-12)

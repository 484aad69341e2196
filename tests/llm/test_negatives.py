"""Hard negatives against brute force, with odd rows, ties and hot vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, dim int, x string, block int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "id", 2, "x", 1) for i, v, y in rows], SCHEMA)


def mined(spark, rows, step=10, **options):
    usable = negatives.labelled_vectors(frame(spark, rows), "vec_id", "embedding", "label", 256)
    df = negatives.hard_negatives(usable, F.col("id") % step == 0, **options)
    assert df.dtypes == [
        ("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
        ("positive_score", "bigint"), ("negative_score", "bigint"),
    ]
    return sorted(map(tuple, df.collect()))


def brute(rows, step=10, positives=5, wanted=10):
    kept = {}
    for i, v, y in rows:
        if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v):
            x = [max(-(2**24), min(2**24, math.floor(256 * float(np.float32(c))))) for c in v]
            kept[i] = min(kept.get(i, (y, x)), (y, x))
    out = []
    for a, (label, x) in kept.items():
        if a % step:
            continue
        scored = [(-sum(p * q for p, q in zip(x, z)), i, y) for i, (y, z) in kept.items() if i != a and len(z) == len(x)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = sorted(s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:wanted]
            out += [(a, p, r, i, -ps, -s) for r, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 12))
    rows = []
    for i in range(700):
        v = centres[i % 6] + draw.normal(size=12) * (0.1 if i % 2 else 1.5)
        rows.append((i, v.astype(np.float32).tolist(), int(draw.integers(0, 3))))
    rows += [(1000 + i, rows[5][1], i % 2) for i in range(300)]  # a vector that very many rows share
    rows += [(2000, None, 1), (2010, [NAN] * 12, 1), (2020, [INF] + [0.0] * 11, 1), (2030, [None] + [0.0] * 11, 1)]
    rows += [(2040, [0.0] * 12, 1), (2050, rows[0][1], None), (2060, [], 1), (None, rows[0][1], 1), (2070, [1.0, 2.0], 0)]
    rows += [(2080, [1.0, 1.5], 0), (2081, [0.5, 0.5], 1), (2090, [9e30] * 12, 0), (7, rows[8][1], 2), (7, rows[9][1], 0)]
    want = brute(rows)
    assert len(want) > 1000
    for options in ({}, {"anchor_rows": 16, "candidate_rows": 64}):
        assert mined(spark, rows, **options) == want


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []  # no row of another label
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]) == []  # a negative score opens no window
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.95], 2)]) == [(0, 1, 1, 2, 65536, 32768)]
    assert mined(spark, [(0, [0.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(0, 1, 1, 2, 0, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_walks_end_early(seed):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=16) * 300
    q = np.floor(centre + draw.normal(size=(40, 16)) * 40).astype(np.int64)
    c = np.floor(draw.normal(size=(5000, 16)) * 200 * draw.lognormal(size=(5000, 1))).astype(np.int64)
    shared = negatives.SharedList(q, c, np.arange(len(q)))
    exact = q @ c.T
    bound = np.empty(len(c))
    bound[shared.order] = shared.bound
    assert np.all(exact <= shared.length[:, None] * bound * (1 + 1e-9))
    kept, seen = negatives.Kept(len(q), 5), 0
    for members, at, scores in shared.walk(np.arange(len(q)), kept.bar):
        assert np.array_equal(scores, exact[np.ix_(members, at)])
        kept.add(members, at, scores)
        seen += scores.size
    assert seen < exact.size / 2
    assert np.array_equal(kept.scores, -np.sort(-exact, axis=1)[:, :5])

"""Whitening against a full eigendecomposition, with odd vectors and repeated rows."""

import math

import numpy as np
import pytest

from riskloom.llm import spectral, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, dim int, n string, component int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 2, "y", 3) for i, v in rows], SCHEMA)


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [5.0], [0, 1, 2], [1, 1, 1, 1], [1e8, 1, 1, 1e-8], list(range(40)), [3, 3, 3, 2, 2, -1], [0] * 5 + [1],
        list(np.geomspace(1, 1e-12, 30)), [1 + 1e-9, 1, 1 - 1e-9, 0.5], [-4, -4, -3],
    ],
)
def test_eigenvectors(values):
    a = spectrum(values)
    for first in (1, 2, len(values)):
        found, rows = spectral.largest(a, first)
        want = np.sort(values)[::-1][:first]
        assert np.allclose(found, want, rtol=0, atol=1e-13 * max(1, np.abs(values).max()) * len(values))
        assert np.allclose(rows @ rows.T, np.eye(len(rows)), atol=1e-12)
        assert np.linalg.norm(rows @ a - found[:, None] * rows) <= 1e-12 * len(values) * max(np.linalg.norm(a), 1e-300)


def test_polar_factor_has_the_signs():
    a = spectrum([4, 1e-3, -1e-9, -7])
    u = spectral.polar(a)
    assert np.allclose(u, spectrum([1, 1, -1, -1]), atol=1e-6) and np.allclose(u @ u, np.eye(4), atol=1e-12)


def brute(rows, k):
    """Whitened coordinates up to sign, by a library's eigendecomposition of the same covariance."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        z = (np.array(x) - np.array(sums) / n) @ u / np.sqrt(e)
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in range(k):
            out.setdefault((i, c + 1), []).append((n, dev, abs(z[c]), e[c] / np.trace(v)))
    return out


def test_whitening(spark):
    draw = np.random.default_rng(5)
    scale = np.array([3, 2.4, 1.7, 1.2, 0.8, 0.5, 0.3, 0.2])
    rows = [(i, (draw.normal(size=8) * scale + 1).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(200)]  # a hot vector counts once in the fit
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (900, None), (901, []), (902, [NAN] * 8), (903, [INF] + [0.0] * 7)]
    rows += [(904, [None] + [0.0] * 7)]
    df = whitening.whiten(frame(spark, rows).repartition(5))
    assert df.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double"),
    ]
    want, got = brute(rows, 4), df.collect()
    assert len(got) == sum(map(len, want.values())) and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] <= 1e-9
    by_key = {}
    for r in got:
        by_key.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
    for key, values in want.items():
        for a, b in zip(sorted(values), sorted(by_key[key])):
            assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-8, atol=1e-9)
    again = {(r["vec_id"], r["component"], r["whitened"]) for r in whitening.whiten(frame(spark, rows).repartition(3)).collect()}
    assert again == {(r["vec_id"], r["component"], r["whitened"]) for r in got}  # whatever the partitioning


def test_small_and_mixed_tables(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance
    mixed = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0]), (4, [7.0]), (5, [3e30]), (6, [-3e30])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(frame(spark, mixed)).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)}
    assert got[1, 1]["n"] == 2 and got[3, 1]["n"] == 4
    sums = 256 * 12
    assert got[3, 1]["deviation"] == (4 * 256 * 5 - sums) ** 2 and got[5, 1]["deviation"] is None  # beyond a long

"""Whitening of embeddings by the leading components of their covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.spectral import largest
from riskloom.sources.staging import release, stage

MOST = 2**30  # components are held within this, so that products fit a long
LEAST_SHARE = 1e-12  # of the trace: below it, a variance is rounding
SUMS = "dim int, i int, n long, s long"
PRODUCTS = "dim int, i int, j int, p long"
CHECKS = "dim int, i int, j int, n long, z double, zz double"
ROWS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitener:
    """What was learned of the vectors of one dimension: rows, exact sums, components, their variances.

    ``axes`` holds a unit vector a row; ``identity_error`` is how far the covariance of the
    whitened fit list was measured to be from the identity.
    """

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Products are added in the order of the dimensions, so a row's result does not depend on its batch."""
        z = np.zeros((len(x), len(self.variances)))
        for d, total in enumerate(self.sums):
            z += (x[:, d] - total / self.n)[:, None] * self.axes[:, d]
        return z / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum) squared, exact; None where it does not fit a long."""
        reach = max((self.n * MOST + max(map(abs, self.sums))) ** 2 * len(self.sums), 1)
        if reach >= 2**62:
            reach = max(self.n * int(np.abs(x).max(initial=0)), 0) + max(map(abs, self.sums))
            reach = reach * reach * len(self.sums)
        if reach < 2**62:
            off = self.n * x - np.array(self.sums, np.int64)
            return [int(v) for v in (off * off).sum(axis=1)]
        found = [sum((self.n * int(a) - s) ** 2 for a, s in zip(row, self.sums)) for row in x]
        return [v if v < 2**63 else None for v in found]


def usable(vector: str) -> Column:
    """Whether the vector is there, not empty, and holds finite numbers only."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry, taken as a double, as an integer held within ``MOST``."""
    held = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(scale * c)))
    return F.transform(vector, lambda c: held(c).cast("int"))


def _by_dimension(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, positions and rows (long) of the vectors of each dimension in a batch."""
    sizes = np.fromiter(map(len, vectors), int, len(vectors))
    for dim in np.unique(sizes):
        at = np.nonzero(sizes == dim)[0]
        yield int(dim), at, np.stack([np.asarray(v) for v in vectors.iloc[at]]).astype(np.int64)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, list] = {}
    for b in batches:
        for dim, _, x in _by_dimension(b["x"]):
            n, s = held.get(dim, (0, 0))
            held[dim] = [n + len(x), s + x.sum(axis=0)]
    for dim, (n, s) in held.items():
        yield pd.DataFrame({"dim": dim, "i": np.arange(dim), "n": n, "s": s})


def _products(centres):
    """Sums of products of centred entries, exact; a sum goes out before it could leave the range of a long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, np.ndarray]] = {}

        def out(dim, p):
            i, j = np.triu_indices(dim)
            return pd.DataFrame({"dim": dim, "i": i, "j": j, "p": p[i, j]})

        for b in batches:
            for dim, _, x in _by_dimension(b["x"]):
                y = x - centres.value[dim]
                most = int(np.abs(y).max()) ** 2
                step = max(1, 2**61 // max(most, 1))
                for start in range(0, len(y), step):
                    part = y[start : start + step]
                    bound = most * len(part)
                    if bound < 2**53:
                        p = (part.T.astype(float) @ part.astype(float)).astype(np.int64)
                    else:
                        p = part.T @ part
                    reach, total = held.get(dim, (0, None))
                    if total is not None and reach + bound >= 2**62:
                        yield out(dim, total)
                        reach, total = 0, None
                    held[dim] = (reach + bound, p if total is None else total + p)
        for dim, (_, total) in held.items():
            yield out(dim, total)

    return run


def _covariance(n: int, sums: list[int], centre: np.ndarray, products: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance with divisor n from products of entries centred on whole numbers, the rest put right exactly."""
    off = [s - n * int(c) for s, c in zip(sums, centre)]
    v = np.zeros((len(sums), len(sums)))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = (n * p - off[i] * off[j]) / (n * n)
    return v


def _whitened_moments(models):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            for dim, _, x in _by_dimension(b["x"]):
                z = models.value[dim].whiten(x)
                n, s, p = held.get(dim, (0, 0.0, 0.0))
                held[dim] = [n + len(z), s + z.sum(axis=0), p + z.T @ z]
        for dim, (n, s, p) in held.items():
            i, j = (g.ravel() for g in np.indices(p.shape))
            yield pd.DataFrame({"dim": dim, "i": i, "j": j, "n": n, "z": s[i], "zz": p[i, j]})

    return run


def fit(vectors: DataFrame, components: int) -> dict[int, Whitener]:
    """A model for each dimension from ``x`` (array of int): every distinct vector counts once.

    Three passes over the distinct vectors, written once: sums, centred products, and the
    covariance after whitening. Tasks add up what they see, so a pass shuffles numbers of the order
    of dimension squared per task and the driver gets one matrix for each dimension.
    """
    spark = vectors.sparkSession
    distinct = stage(vectors.select("x").distinct(), "fit-list")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    by_dim: dict[int, list] = {}
    for r in distinct.mapInPandas(_sums, SUMS).groupBy("dim", "i").agg(F.sum("n").alias("n"), total("s")).collect():
        by_dim.setdefault(r["dim"], []).append((r["i"], r["n"], int(r["s"])))
    known = {d: (rows[0][1], [s for _, _, s in sorted(rows)]) for d, rows in by_dim.items()}
    centres = {d: np.array([(2 * s + n) // (2 * n) for s in sums], np.int64) for d, (n, sums) in known.items()}
    products: dict[int, dict] = {d: {} for d in known}
    sent = spark.sparkContext.broadcast(centres)
    for r in distinct.mapInPandas(_products(sent), PRODUCTS).groupBy("dim", "i", "j").agg(total("p")).collect():
        products[r["dim"]][r["i"], r["j"]] = int(r["p"])
    models = {}
    for d, (n, sums) in known.items():
        v = _covariance(n, sums, centres[d], products[d])
        variances, axes = largest(v, components)
        real = variances > LEAST_SHARE * np.trace(v)
        models[d] = Whitener(n, sums, axes[real], variances[real], float(np.trace(v)))
    sent = spark.sparkContext.broadcast(models)
    moments = distinct.mapInPandas(_whitened_moments(sent), CHECKS).groupBy("dim", "i", "j")
    for r in moments.agg(F.sum("n").alias("n"), F.sum("z").alias("z"), F.sum("zz").alias("zz"), F.max("i")).collect():
        # means of whitened entries are zero but for rounding, far below their products
        off = abs(r["zz"] / r["n"] - (r["i"] == r["j"]))
        models[r["dim"]].identity_error = max(models[r["dim"]].identity_error, off)
    release(spark, distinct)
    return models


def apply(rows: DataFrame, models: dict[int, Whitener], id_column: str) -> DataFrame:
    """A row for each row of ``id_column``, ``x`` and each component; models are sent to the tasks, nothing is shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, at, x in _by_dimension(b["x"]):
                m = sent.value[dim]
                k = len(m.variances)
                if not k:
                    continue
                yield pd.DataFrame(
                    {
                        id_column: b[id_column].iloc[at].repeat(k).array,
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                        "n": m.n, "deviation": pd.array(m.deviations(x), "Int64").repeat(k),
                        "whitened": m.whiten(x).ravel(),
                        "explained": np.tile(m.variances / m.trace, len(x)), "identity_error": m.identity_error,
                    }
                )

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(id_column, "x").mapInPandas(run, f"`{id_column}` {kind}, {ROWS}")


def whiten(
    df: DataFrame, components: int = 4, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256
) -> DataFrame:
    """Every vector on the leading components, scaled to variance one: id, component, n, deviation, whitened, explained, identity_error.

    Entries become floor(scale * c). The mean and the covariance are those of the distinct vectors,
    from exact sums, so they do not depend on partitioning. Eigenvectors come from spectral projectors of
    polar decompositions, which split the space in halves until single components are left.

    Null and empty vectors and those with null or non-finite entries are dropped; null ids stay, and
    rows that repeat an id or a vector are all returned. Vectors of several dimensions are whitened
    apart. Entries beyond 2**30 are held there. A component without variance
    has no whitened value and no row, so a single vector or an empty table gives none. Equal variances
    leave the choice of their axes open. ``deviation`` is null where it exceeds a long.
    Other columns are ignored, whatever their names.
    """
    rows = df.select(F.col(id_column), F.col(vector_column).cast("array<double>").alias("x"))
    rows = rows.where(usable("x")).withColumn("x", whole(F.col("x"), scale))
    return apply(rows, fit(rows, components), id_column)

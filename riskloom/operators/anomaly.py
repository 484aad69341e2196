"""Isolation forest (Liu, Ting and Zhou 2008): trees grown in parallel, rows scored in place."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions.compiled import java_function
from riskloom.operators.features import FEATURE_COLUMNS

# expected candidates per tree, as a multiple of the sample size
MARGIN = 1.5
_HASH_SPAN = float(2**64)

# the least of xxhash64(key, tree, seed) over all trees, from xxhash64(key): a hash goes on from the one before
LEAST_HASH = """
package riskloom;

public final class LeastHash implements org.apache.spark.sql.api.java.UDF1 {
    private int trees;
    private int seed;

    public void load(int trees, int seed) {
        this.trees = trees;
        this.seed = seed;
    }

    public Object call(Object key) {
        long start = ((Long) key).longValue();
        long least = Long.MAX_VALUE;
        for (int tree = 0; tree < trees; tree++) {
            long hash = org.apache.spark.sql.catalyst.expressions.XXH64.hashInt(tree, start);
            least = Math.min(least, org.apache.spark.sql.catalyst.expressions.XXH64.hashInt(seed, hash));
        }
        return Long.valueOf(least);
    }
}
"""


def path_length(rows) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``rows`` rows."""
    rows = np.asarray(rows, dtype=np.float64)
    inner = np.maximum(rows - 1.0, 1.0)
    usual = 2.0 * (np.log(inner) + np.euler_gamma) - 2.0 * inner / np.maximum(rows, 1.0)
    return np.where(rows <= 1, 0.0, np.where(rows == 2, 1.0, usual))


def _hash_below(hashed: Column, rate: float) -> Column:
    """True for about ``rate`` of all hash values."""
    if rate >= 1.0:
        return F.lit(True)
    bound = int(rate * _HASH_SPAN) - 2**63
    return hashed < F.lit(bound)


def tree_samples(
    df: DataFrame,
    key: str,
    rows: int,
    trees: int = fixed.TREES,
    sample: int = fixed.TREE_SAMPLE,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Candidate rows per tree, picked by hashes of the key.

    Which rows a tree sees depends on the keys alone, not on partitions or retries.  Every
    row of the table is a candidate of every tree, each tree getting about 1.5 times its
    sample; the surplus is cut off where the tree is grown.
    """
    picked = df.select(F.col(key).cast("string").alias("key"), *FEATURE_COLUMNS)
    rate = MARGIN * sample / max(rows, 1)
    hashed = [F.xxhash64(F.col("key"), F.lit(tree), F.lit(seed + 1)) for tree in range(trees)]
    # few rows are picked for any tree: compiled code passes over the others.  The first test is the second
    # one with the key hashed once for all trees, which leaves the second few rows
    if rate < 1.0:
        least = java_function(df.sparkSession, "riskloom.LeastHash", LEAST_HASH, "bigint", trees, seed + 1)
        picked = picked.where(_hash_below(least(F.xxhash64("key")), rate))
    picked = picked.where(_hash_below(F.least(*hashed) if trees > 1 else hashed[0], rate))
    chosen = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda tree: _hash_below(F.xxhash64(F.col("key"), tree, F.lit(seed + 1)), rate),
    )
    return picked.withColumn("tree", F.explode(chosen)).withColumn(
        "draw", F.xxhash64("key", "tree", F.lit(seed + 2))
    )


def _grow(points: np.ndarray, depth_limit: int, rng: np.random.Generator):
    """One tree in heap layout: children of node i are 2i+1 and 2i+2.

    A leaf above the last level gets an infinite threshold, so rows run down its left edge
    to the bottom, where the path length is kept.
    """
    inner = 2**depth_limit - 1
    feature = np.zeros(inner, dtype=np.int32)
    threshold = np.full(inner, np.inf)
    depth = np.zeros(inner + 1)
    pending = [(0, 0, np.arange(len(points)))]
    while pending:
        node, level, members = pending.pop()
        block = points[members]
        varying = np.flatnonzero(block.max(axis=0) > block.min(axis=0)) if len(members) > 1 else []
        if level == depth_limit or len(varying) == 0:
            bottom = node
            for _ in range(depth_limit - level):
                bottom = 2 * bottom + 1
            depth[bottom - inner] = level + float(path_length(len(members)))
            continue
        chosen = int(varying[rng.integers(len(varying))])
        low, high = block[:, chosen].min(), block[:, chosen].max()
        cut = rng.uniform(low, high)
        if not low <= cut < high:
            cut = low
        feature[node], threshold[node] = chosen, cut
        left = block[:, chosen] <= cut
        pending.append((2 * node + 1, level + 1, members[left]))
        pending.append((2 * node + 2, level + 1, members[~left]))
    return feature, threshold, depth


@dataclass(frozen=True)
class Forest:
    """All trees in heap layout, one row per tree; a few megabytes, whatever the data."""

    features: np.ndarray
    thresholds: np.ndarray
    depths: np.ndarray
    sample: int

    def score(self, points: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path) per row: higher is more anomalous."""
        total = np.zeros(len(points))
        inner = self.features.shape[1]
        for feature, threshold, depth in zip(self.features, self.thresholds, self.depths):
            node = np.zeros(len(points), dtype=np.int64)
            while node.min(initial=inner) < inner:
                right = points[np.arange(len(points)), feature[node]] > threshold[node]
                node = 2 * node + 1 + right
            total += depth[node - inner]
        expected = float(path_length(self.sample))
        ratio = total / len(self.features) / expected if expected else np.ones(len(points))
        return np.power(2.0, -ratio)


# Each row goes down all trees; four at a time, as each step waits for the one before.  Sums are taken in
# the order of the trees.
TREE_WALK = """
package riskloom;

public final class TreeWalk implements org.apache.spark.sql.api.java.UDF1 {
    private int trees;
    private int levels;
    private byte[] features;
    private double[] thresholds;
    private double[] depths;

    public void load(int trees, int levels, byte[] features, byte[] thresholds, byte[] depths) {
        this.trees = trees;
        this.levels = levels;
        this.features = features;
        this.thresholds = doubles(thresholds);
        this.depths = doubles(depths);
    }

    private static double[] doubles(byte[] packed) {
        double[] out = new double[packed.length / 8];
        java.nio.ByteBuffer.wrap(packed).asDoubleBuffer().get(out);
        return out;
    }

    public Object call(Object held) {
        scala.collection.Seq values = (scala.collection.Seq) held;
        double[] row = new double[values.length()];
        for (int at = 0; at < row.length; at++) {
            Double value = (Double) values.apply(at);
            if (value == null || value.isNaN()) {
                throw new IllegalArgumentException("feature " + at + " is null or NaN");
            }
            row[at] = value.doubleValue();
        }
        int inner = (1 << levels) - 1;
        double total = 0.0;
        int tree = 0;
        for (; tree + 4 <= trees; tree += 4) {
            int a = tree * inner, b = a + inner, c = b + inner, d = c + inner;
            int i = 0, j = 0, k = 0, l = 0;
            for (int level = 0; level < levels; level++) {
                i = 2 * i + (row[features[a + i]] <= thresholds[a + i] ? 1 : 2);
                j = 2 * j + (row[features[b + j]] <= thresholds[b + j] ? 1 : 2);
                k = 2 * k + (row[features[c + k]] <= thresholds[c + k] ? 1 : 2);
                l = 2 * l + (row[features[d + l]] <= thresholds[d + l] ? 1 : 2);
            }
            int leaf = tree * (inner + 1) - inner;
            total += depths[leaf + i];
            total += depths[leaf + (inner + 1) + j];
            total += depths[leaf + 2 * (inner + 1) + k];
            total += depths[leaf + 3 * (inner + 1) + l];
        }
        for (; tree < trees; tree++) {
            int root = tree * inner, node = 0;
            for (int level = 0; level < levels; level++) {
                node = 2 * node + (row[features[root + node]] <= thresholds[root + node] ? 1 : 2);
            }
            total += depths[tree * (inner + 1) - inner + node];
        }
        return Double.valueOf(total / trees);
    }
}
"""


def mean_path(spark: SparkSession, forest: Forest) -> Callable[[Column], Column]:
    """The mean path length of an array of features, as a compiled function that holds the trees as arrays."""
    trees, inner = forest.features.shape
    packed = lambda values, kind: values.astype(kind).tobytes()
    return java_function(
        spark, "riskloom.TreeWalk", TREE_WALK, "double", trees, (inner + 1).bit_length() - 1,
        packed(forest.features, "i1"), packed(forest.thresholds, ">f8"), packed(forest.depths, ">f8"),
    )


def fit_forest(
    df: DataFrame,
    key: str,
    rows: int,
    trees: int = fixed.TREES,
    sample: int = fixed.TREE_SAMPLE,
    seed: int = fixed.SEED,
) -> Forest:
    """Grow the trees as one grouped job on standardized features; ``rows`` is the row count.

    A group holds one sample.  The driver gets one row per tree.
    """
    size = max(1, min(sample, rows))
    depth_limit = max(1, math.ceil(math.log2(max(size, 2))))
    columns = list(FEATURE_COLUMNS)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        points = group.sort_values("place")[columns].to_numpy(dtype=np.float64)
        grown = _grow(points, depth_limit, np.random.default_rng([seed, tree]))
        feature, threshold, depth = (array.tolist() for array in grown)
        return pd.DataFrame(
            {"tree": [tree], "feature": [feature], "threshold": [threshold], "depth": [depth]}
        )

    candidates = tree_samples(df, key, rows, trees, sample, seed)
    # cut to the sample before anything is grouped in Python, map tasks first; this holds even
    # if many rows share a key
    place = F.row_number().over(Window.partitionBy("tree").orderBy("draw", "key", *columns))
    drawn = candidates.withColumn("place", place).where(F.col("place") <= size)
    # little data but much work per group: a set number of tasks keeps it from being merged
    tasks = max(1, min(trees, df.sparkSession.sparkContext.defaultParallelism))
    grown = (
        drawn.repartition(tasks, "tree")
        .groupBy("tree")
        .applyInPandas(
            grow, "tree int, feature array<int>, threshold array<double>, depth array<double>"
        )
        .collect()
    )
    grown.sort(key=lambda row: row["tree"])
    if not grown:
        raise ValueError("a forest needs at least one row")
    return Forest(
        np.array([row["feature"] for row in grown], dtype=np.int64),
        np.array([row["threshold"] for row in grown], dtype=np.float64),
        np.array([row["depth"] for row in grown], dtype=np.float64),
        size,
    )


def score_forest(df: DataFrame, forest: Forest, column: str = "anom_raw") -> DataFrame:
    """Add the raw anomaly score of standardized features; rows do not leave the JVM."""
    expected = float(path_length(forest.sample))
    path = mean_path(df.sparkSession, forest)(F.array(*FEATURE_COLUMNS))
    ratio = path / F.lit(expected) if expected else F.lit(1.0)
    return df.withColumn(column, F.pow(F.lit(2.0), -ratio))


def score_range(df: DataFrame, column: str = "anom_raw") -> tuple[float, float]:
    low, high = df.agg(F.min(column), F.max(column)).first()
    return (0.0, 0.0) if low is None else (low, high)


def normalize_score(
    df: DataFrame, low: float, high: float, raw: str = "anom_raw", column: str = "anom_score"
) -> DataFrame:
    """Min-max to 0..1; a tiny constant keeps a constant column from dividing by zero."""
    return df.withColumn(
        column,
        (F.col(raw) - F.lit(low)) / F.lit((high - low) + fixed.RANGE_EPSILON),
    )

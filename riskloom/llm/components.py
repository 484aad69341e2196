"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.staging import release, stage


PART_ROWS = 250_000


def compact(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Stage a table of at most about ``rows`` narrow rows in as many parts as they fill."""
    return stage(df.coalesce(1 + rows // PART_ROWS), name)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node it reaches) for every node of the edges ``a``, ``b``.

    In each round every node points to its smallest neighbour, or to itself if it is smaller,
    and edges are drawn anew between what their ends point to. Nodes that are not the smallest
    around vanish, so a few rounds end with no edge left. Joins on a node with very many edges
    are left to adaptive skew handling; sums per node are combined before they are shuffled.
    """
    spark = edges.sparkSession
    links = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stage(links, "links")
    n = links.count()
    both = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = compact(both.select("node", F.col("node").alias("label")), "labels", 2 * n)
    while not links.isEmpty():
        ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        points = ends.groupBy(F.col("e.a").alias("at")).agg(F.min("e.b").alias("to")).select("at", F.least("at", "to").alias("to"))
        points = compact(points, "points", 2 * n)
        first = links.join(points.select(F.col("at").alias("a"), F.col("to").alias("x")), "a")
        second = first.join(points.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
        drawn = second.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        moved = labels.join(points.select(F.col("at").alias("label"), "to"), "label", "left_outer")
        moved = moved.select("node", F.coalesce("to", "label").alias("label"))
        new_links, new_labels = compact(drawn, "links", n), compact(moved, "labels", 2 * n)
        release(spark, links, labels, points)
        links, labels = new_links, new_labels
    release(spark, links)
    return labels

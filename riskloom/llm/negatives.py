"""Hard negatives by lists of candidates that the anchors of a cluster share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.blocks import block_count, grid, matrix_of
from riskloom.llm.keys import hash_of
from riskloom.sources.staging import stage

ANCHOR_ROWS = 1_024
CANDIDATE_ROWS = 16_384
CLUSTERS = 1_024
SAMPLE = 8_192
ROUNDS = 8
FIRST, MEMBERS = 512, 128
SLACK = 1e-6  # radians; more than the rounding of an angle computed from a cosine
MOST = 2**24  # components are held within this: products of 2**13 of them fit a long
NONE = np.iinfo(np.int64).min
PACKED = "dim int, block int, ids binary, matrix binary"
POSITIVES = "anchor_id long, vec_id long, score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def labelled_vectors(df: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """``id``, ``label``, ``x`` (floor(scale * component) as int), one row per id; the smallest row stands for an id."""
    rows = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
        F.col(vector_column).cast("array<double>").alias("v"),
    )
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & fine)
    held = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(scale * c))).cast("int")
    rows = rows.select("id", F.struct("label", F.transform("v", held).alias("x")).alias("r"))
    return rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.x", F.size("r.x").alias("dim"))


def _units(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centres of ``k`` clusters of directions: spherical k-means from spread-out rows."""
    unit = _units(x.astype(float))
    unit = unit[unit.any(axis=1)]
    if not len(unit):
        return np.zeros((1, x.shape[1]))
    centres = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)]
    for _ in range(ROUNDS):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        moved = _units(sums)
        centres = np.where(moved.any(axis=1, keepdims=True), moved, centres)
    return centres


def clustered(anchors: DataFrame, anchor_rows: int) -> DataFrame:
    """Anchors with ``block``: their cluster of directions, cut by id into parts of about ``anchor_rows``.

    Centres are fitted on at most about ``SAMPLE`` anchors and number at most ``CLUSTERS`` a dimension; every
    anchor is then assigned. No result depends on them: they only decide which anchors share a list.
    """
    spark = anchors.sparkSession
    totals = {r["dim"]: r["count"] for r in anchors.groupBy("dim").count().collect()}
    share = SAMPLE / max(sum(totals.values()), 1)
    some = anchors.where(hash_of(F.lit("clusters"), F.col("id"), digits=8) < share * F.lit(16**8)).select("id", "dim", "x")
    by_dim: dict[int, list] = {}
    for r in some.orderBy("id").collect():
        by_dim.setdefault(r["dim"], []).append(r["x"])
    centres = {d: centroids(np.array(x), min(CLUSTERS, math.ceil(totals[d] / anchor_rows))) for d, x in by_dim.items()}
    sent = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int32)
        sizes = np.fromiter(map(len, vectors), int, len(vectors))
        for dim in np.unique(sizes):
            at = np.nonzero(sizes == dim)[0]
            if int(dim) in sent.value:
                out[at] = (np.stack(vectors.iloc[at]).astype(float) @ sent.value[int(dim)].T).argmax(axis=1)
        return pd.Series(out)

    known = stage(anchors.withColumn("cluster", nearest("x")), "anchors")
    sizes = known.groupBy("dim", "cluster").count().orderBy("dim", "cluster").collect()
    starts, rows = {}, []
    for r in sizes:  # bounded by the number of clusters
        first, parts = starts.get(r["dim"], 0), math.ceil(r["count"] / anchor_rows)
        starts[r["dim"]] = first + parts
        rows.append((r["dim"], r["cluster"], first, parts))
    places = spark.createDataFrame(rows, "dim int, cluster int, first int, parts int")
    placed = known.join(F.broadcast(places), ["dim", "cluster"])
    return placed.withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def packed(rows: DataFrame) -> DataFrame:
    """``id``, ``label``, ``x`` as one row per (dim, block): ids and then labels, and the matrix, as bytes."""

    def to_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                {
                    "dim": b["dim"], "block": b["block"],
                    "ids": [np.concatenate([i, y]).astype(np.int64).tobytes() for i, y in zip(b["ids"], b["labels"])],
                    "matrix": [np.asarray(x, np.int32).tobytes() for x in b["x"]],
                }
            )

    held = rows.groupBy("dim", "block").agg(F.array_sort(F.collect_list(F.struct("id", "label", "x"))).alias("r"))
    names = ["r.id", "r.label"]
    held = held.select("dim", "block", *[F.col(c).alias(f"{c[2:]}s") for c in names], F.flatten("r.x").alias("x"))
    return held.mapInPandas(to_bytes, PACKED)


class SharedList:
    """A cluster's list of the candidates of one block, by the upper bound of what any member can score.

    With ``t`` the angle between a candidate and the centre, and ``w`` the widest angle between a member and the
    centre, a member's angle to the candidate is at least t - w. So its score is at most its length times the
    candidate's times cos(t - w). Candidates are sorted by the part that is theirs once; each
    member walks the list until its own length times the bound cannot bring anything better.
    """

    def __init__(self, q: np.ndarray, c: np.ndarray, of: np.ndarray):
        """Anchors ``q``, candidates ``c``; ``of`` is the anchor of each member of the walk."""
        self.of = of
        self.length = np.linalg.norm(q, axis=1)
        centre = _units(q.astype(float)).sum(axis=0, keepdims=True)
        centre = _units(centre)[0]
        long = np.linalg.norm(c, axis=1)
        angle = lambda x, n: np.arccos(np.clip(np.divide(x @ centre, n, out=np.ones(len(x)), where=n > 0), -1, 1))
        wide = angle(q, self.length).max(initial=0.0) if centre.any() else np.pi
        near = np.maximum(angle(c, long) - wide - SLACK, 0.0) if centre.any() else np.zeros(len(c))
        bound = long * np.cos(near)
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order] + 2e-9 * long.max(initial=0.0)
        reach = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
        self.kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
        self.q, self.c = q.astype(self.kind), c.astype(self.kind)

    def walk(self, members: np.ndarray, bar) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Members still walking, candidates of the next stretch (by position) and their scores.

        ``bar(members)`` gives the score that is needed to change a member's result; a member whose bound is
        below it has seen all that can. Stretches double, so few are cut and none is long for those who end early.
        """
        start, size = 0, FIRST
        while start < len(self.order):
            members = members[self.length[self.of[members]] * self.bound[start] * (1 + 1e-9) >= bar(members)]
            if not len(members):
                return
            at = np.sort(self.order[start : start + size])  # in the order of ids
            rows, place = np.unique(self.of[members], return_inverse=True)
            yield members, at, (self.q[rows] @ self.c[at].T).astype(np.int64)[place]
            start, size = start + size, min(2 * size, 8 * FIRST)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest scores of each row, those of NONE apart; ties to the first columns."""
    m = scores.shape[1]
    kth = np.partition(scores, m - k, axis=1)[:, m - k, None] if m > k else np.full((len(scores), 1), NONE)
    above, ties = scores > kth, (scores == kth) & (scores > NONE)
    ties &= np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | ties)


class Kept:
    """The ``k`` best of what each member has met: score, then id."""

    def __init__(self, members: int, k: int):
        self.k = k
        self.scores = np.full((members, k), NONE, np.int64)
        self.ids = np.full((members, k), np.iinfo(np.int64).max, np.int64)

    def bar(self, members: np.ndarray) -> np.ndarray:
        """The score below which nothing enters; -inf while there is room."""
        worst = self.scores[members, -1]
        return np.where(worst == NONE, -np.inf, worst.astype(float))

    def add(self, members: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        i, j = best(scores, self.k)
        rank = np.arange(len(i)) - np.searchsorted(i, i)  # places within a member's finds
        new_scores = np.full((len(members), self.k), NONE, np.int64)
        new_ids = np.full((len(members), self.k), np.iinfo(np.int64).max, np.int64)
        new_scores[i, rank], new_ids[i, rank] = scores[i, j], ids[j]
        both = np.hstack([self.scores[members], new_scores])
        named = np.hstack([self.ids[members], new_ids])
        first = np.argsort(named, axis=1, kind="stable")
        both, named = np.take_along_axis(both, first, 1), np.take_along_axis(named, first, 1)
        order = np.argsort(-np.maximum(both, NONE + 1), axis=1, kind="stable")[:, : self.k]
        self.scores[members] = np.take_along_axis(both, order, 1)
        self.ids[members] = np.take_along_axis(named, order, 1)


def _sides(row) -> tuple[np.ndarray, ...]:
    (q_ids, q_label), (c_ids, c_label) = (np.frombuffer(x, np.int64).reshape(2, -1) for x in (row.q_ids, row.c_ids))
    q, c = matrix_of(row.q_matrix, q_ids, "<i4"), matrix_of(row.c_matrix, c_ids, "<i4")
    return q_ids, q_label, q.astype(np.int64), c_ids, c_label, c.astype(np.int64)


def _positives(k: int):
    """Each anchor's ``k`` highest scores among the rows of its label in a candidate block."""

    def run(batches):
        for b in batches:
            for row in b.itertuples():
                q_ids, q_label, q, c_ids, c_label, c = _sides(row)
                shared, kept = SharedList(q, c, np.arange(len(q_ids))), Kept(len(q_ids), k)
                for start in range(0, len(q_ids), MEMBERS):
                    members = np.arange(start, min(start + MEMBERS, len(q_ids)))
                    for left, at, scores in shared.walk(members, kept.bar):
                        other = (q_label[left, None] != c_label[None, at]) | (q_ids[left, None] == c_ids[None, at])
                        kept.add(left, c_ids[at], np.where(other, NONE, scores))
                i, j = np.nonzero(kept.scores > NONE)
                yield pd.DataFrame({"anchor_id": q_ids[i], "vec_id": kept.ids[i, j], "score": kept.scores[i, j]})

    return run


def _negatives(k: int, low: int, high: int):
    """For each anchor and positive the ``k`` highest scores of other labels inside the window, in a candidate block."""

    def run(batches):
        for b in batches:
            for row in b.itertuples():
                q_ids, q_label, q, c_ids, c_label, c = _sides(row)
                # a member of the walk is an anchor with one of its positives
                anchor = np.searchsorted(q_ids, np.asarray(row.q_state_id, np.int64))
                positive, ps = np.asarray(row.q_positive_id, np.int64), np.asarray(row.q_positive_score, np.int64)
                least, most = -((-low * ps) // 100), (high * ps) // 100
                shared, kept = SharedList(q, c, anchor), Kept(len(anchor), k)
                bar = lambda m: np.maximum(kept.bar(m), least[m])  # noqa: B023, E731
                for start in range(0, len(anchor), MEMBERS):
                    members = np.arange(start, min(start + MEMBERS, len(anchor)))
                    members = members[least[members] <= most[members]]
                    for left, at, scores in shared.walk(members, bar):
                        out = (q_label[anchor[left], None] == c_label[None, at]) | (scores < least[left, None]) | (scores > most[left, None])
                        kept.add(left, c_ids[at], np.where(out, NONE, scores))
                i, j = np.nonzero(kept.scores > NONE)
                yield pd.DataFrame(
                    {
                        "anchor_id": q_ids[anchor[i]], "positive_id": positive[i], "positive_score": ps[i],
                        "vec_id": kept.ids[i, j], "score": kept.scores[i, j],
                    }
                )

    return run


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    anchor_rows: int = ANCHOR_ROWS, candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """Negatives close to an anchor, but not as close as a positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` are those of ``labelled_vectors``, ``is_anchor`` is a condition on ``id``. Scores are integer inner
    products, higher first, ties to the smaller id. The positives of an anchor are its best ``positives`` other rows of
    its label; for each, the best ``negatives`` rows of other labels with ``low`` to ``high`` percent of its score.

    Anchors are clustered by direction. Each block of a cluster meets every block of candidates in a task
    of bounded size, which sorts the candidates once by the upper bound they have for the cluster; members walk
    that list until the bound certifies that the rest cannot change their result. Results of the blocks are merged
    per anchor, so they do not depend on clusters or blocks. One walk finds the positives, a second the negatives.

    Null ids, null labels, and vectors that are null, empty or hold null or non-finite components take no part;
    rows repeating an id count once (the smallest label and vector); only vectors of one dimension meet. Components are
    held within 2**24. An anchor without positives, or whose window holds nothing (as for
    negative scores), has no row; an empty table gives an empty result. Other columns are ignored.
    """
    rows = stage(rows, "labelled-vectors")
    n, a = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    cn = block_count(n, candidate_rows, least=2 * cores)
    placed = stage(clustered(rows.where(is_anchor), anchor_rows).select("dim", "block", "id", "label", "x"), "anchor-places")
    qn = (placed.agg(F.max("block")).first()[0] or 0) + 1
    anchors = stage(packed(placed), "anchor-blocks")
    hashed = F.pmod(F.xxhash64("id"), F.lit(cn)).cast("int")
    candidates = stage(packed(rows.withColumn("block", hashed)), "candidate-blocks")

    down = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = grid(anchors, candidates, qn, cn).mapInPandas(_positives(positives), POSITIVES)
    found = found.withColumn("place", F.row_number().over(down)).where(F.col("place") <= positives).drop("place")
    state = found.join(placed.select(F.col("id").alias("anchor_id"), "dim", "block"), "anchor_id")
    entry = F.struct(F.col("anchor_id").alias("state_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    state = state.groupBy("dim", "block").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    names = ["state_id", "positive_id", "positive_score"]
    state = stage(state.select("dim", "block", *[F.col(f"s.{c}").alias(c) for c in names]), "positives")

    down = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    hits = grid(anchors.join(state, ["dim", "block"]), candidates, qn, cn).mapInPandas(_negatives(negatives, low, high), NEGATIVES)
    return hits.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )

"""Jaccard join of word n-gram sets by PartEnum signatures, and the groups of near-duplicates it links."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from riskloom.llm.components import compact, components
from riskloom.operators.link import heavy_keys, lookup
from riskloom.sources.staging import release, stage

LEAST_ELEMENTS = 5
LEVELS = 3
SEEN = 500_000
HOT_SHARE, HOT_ROWS, HOT_TEXTS, SALTS = 0.001, 32, 16, 256
PART_SETS = 10_000  # members of a bucket that are compared in one task, about
FILTER_BITS, MOST_BITS = 16, 2**27  # of a filter of keys: per key, and in all
SIGNED = "signature long, salt int, fp long"
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all positions (multiply and shift)."""
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of a text's word n-grams as sorted 64-bit hashes; A-Z in lower case.

    A text with fewer words has its whole sequence as the only one, a text without words none.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, U)
    hashes = np.fromiter(map(xxh3_64_intdigest, tokens), U, len(tokens))
    width = min(words, len(tokens))
    grams = np.full(len(tokens) - width + 1, width, U)
    for j in range(width):
        grams = mix(grams) + hashes[j : len(tokens) - width + 1 + j]
    return np.unique(mix(grams))


def fingerprint(grams: np.ndarray) -> int:
    """64 bits for a set; equal sets agree, different ones do but for chance (one in 2**64)."""
    return int(mix(mix(grams ^ U(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True) + U(len(grams))).astype(np.int64)[0])


SKETCH = ["s0", "s1", "s2", "s3"]


def sketch(grams: np.ndarray) -> np.ndarray:
    """256 bits as four integers: whether the number of elements in each of 256 classes is odd.

    Two sets differ in at least as many elements as their sketches differ in bits.
    """
    odd = np.bincount((mix(grams + U(1)) >> U(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |a and b| >= num * |a or b|; both sorted without repeats."""
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


class Scheme:
    """Signatures for a similarity of at least num / den.

    Set sizes fall into bands; sizes that can be similar lie in one band or in neighbouring ones, so
    a set takes part in two instances, its own band's and the next one's. In an instance two similar
    sets of sizes up to r differ in at most k = 2r(den - num) / (den + num) elements. The domain
    (of hashes) is cut into n1 parts, each into n2 smaller ones. With more than k / (k2 + 1) parts,
    some part holds at most k2 of the differing elements; for each part every choice of n2 - k2 of
    its n2 smaller parts is a signature, so one of these is free of differences and both sets
    have it. The cheapest of a few settings is used in which a signature stands for enough elements.

    There are ``spare`` parts more than needed, so at least spare + 1 parts are good ones. Small
    signatures, which unlike sets may share, are left out as long as that touches at most
    ``spare`` parts of the set: one good part is left, for the set with the higher bound on
    what is small, and so for the other one.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * self.den // self.num + 1)
        return bisect_right(self.lows, size) - 1

    @lru_cache(maxsize=None)
    def plan(self, band: int) -> tuple[int, int, np.ndarray, int]:
        """n1, n2, the choices as a 0/1 matrix, spare parts."""
        high = self.low(band + 1) - 1
        k = 2 * high * (self.den - self.num) // (self.den + self.num)
        if not k:
            return 1, 1, np.ones((1, 1), U), 0
        for k2, n2 in ((1, 3), (2, 5)):
            parts = k // (k2 + 1)
            spare = max(1, parts // 8)
            n1 = parts + 1 + spare
            if high * (n2 - k2) / (n1 * n2) >= LEAST_ELEMENTS:
                break
        choices = np.zeros((n2, comb(n2, n2 - k2)), U)
        for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
            choices[list(chosen), c] = 1
        return n1, n2, choices, spare

    def low(self, band: int) -> int:
        while len(self.lows) <= band:
            self.lows.append(self.lows[-1] * self.den // self.num + 1)
        return self.lows[band]

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """All signatures of a set, as 64-bit integers."""
        size = len(grams)
        if not size:
            return np.empty(0, np.int64)
        own = self.band(size)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(grams))])
        out = []
        for band in (own, own + 1):
            if self.num * self.low(band) > self.den * size:
                continue
            n1, n2, choices, spare = self.plan(band)
            # hashes are sorted, so their parts are stretches of them
            part = ((grams >> U(32)) * U(n1 * n2)) >> U(32)
            ends = np.searchsorted(part, np.arange(n1 * n2 + 1, dtype=U))
            held = (np.diff(ends).reshape(n1, n2) @ choices.astype(np.int64))
            value = (sums[ends[1:]] - sums[ends[:-1]]).reshape(n1, n2) @ choices
            smallest = np.sort(held.min(axis=1))
            bound = smallest[spare] - 1 if spare < n1 else -1  # at most spare parts go below it
            place = (np.arange(held.size, dtype=U) + (U(band) << U(40))).reshape(held.shape)
            signature = mix(mix(place) + mix(value + held.astype(U)))
            out.append(signature[held > bound])
        return np.concatenate(out).astype(np.int64)


def _sizes(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, words) for t in b["text"]]
            out = {"doc_id": b["doc_id"], "n": [len(s) for s in sets], "fp": [fingerprint(s) for s in sets]}
            bits = np.array([sketch(s) for s in sets], np.int64).reshape(len(sets), len(SKETCH))
            yield pd.DataFrame(out | {name: bits[:, i] for i, name in enumerate(SKETCH)})

    return run


def _signatures(words: int, num: int, den: int, hot: np.ndarray):
    """Signatures of each set; those of ``hot`` (sorted) are dealt over salts by the set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scheme, seen = Scheme(num, den), set()
        for b in batches:
            texts = b["text"].tolist()
            for start in range(0, len(texts), 512):
                ids, found = [], []
                for text in texts[start : start + 512]:
                    grams = shingles(text, words)
                    fp = fingerprint(grams)
                    if fp not in seen:  # copies speak once per task
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(fp)
                        ids.append(fp)
                        found.append(scheme.signatures(grams))
                if found:
                    fps = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
                    signature = np.concatenate(found)
                    salt = np.where(np.isin(signature, hot), fps % SALTS, 0).astype(np.int32)
                    yield pd.DataFrame({"signature": signature, "salt": salt, "fp": fps})

    return run


def _sets(words: int):
    """The set of each text whose it is; a set counts once per task, where all rows of an id meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            for start in range(0, len(b), 512):
                part = b.iloc[start : start + 512]
                fps, sets = [], []
                for text, fp in zip(part["text"], part["fp"].tolist()):
                    if fp not in seen and fingerprint(grams := shingles(text, words)) == fp:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(fp)
                        fps.append(fp)
                        sets.append(grams.tobytes())
                yield pd.DataFrame({"fp": np.array(fps, np.int64), "grams": sets})

    return run


def _links(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [similar(np.frombuffer(x, U), np.frombuffer(y, U), num, den) for x, y in zip(p["x"], p["y"])]
            yield p.loc[keep, ["a", "b"]]

    return run


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for start in range(0, len(b), 256):
            part = b.iloc[start : start + 256]
            sets = [np.frombuffer(g, np.int64) for g in part["grams"]]
            fps = np.repeat(part["fp"].to_numpy(np.int64), [len(g) for g in sets])
            yield pd.DataFrame({"gram": np.concatenate(sets) if sets else np.empty(0, np.int64), "fp": fps})


def among(df: DataFrame, key: str, wanted: DataFrame, rows: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``wanted`` (one column of ``rows`` rows), so that a join shuffles no others.

    A bitmap of the wanted keys' hashes, ``FILTER_BITS`` bits a key and 16 MB at most, is broadcast. It lets some other
    keys through, which the join that follows leaves out, and drops none that are wanted.
    """
    bits = min(MOST_BITS, 2**15 * (1 + rows * FILTER_BITS // 2**15))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    held = wanted.select(place(wanted.columns[0]).alias("place"))
    held = held.select(F.bitmap_bucket_number("place").alias("__block"), F.bitmap_bit_position("place").alias("bit"))
    maps = held.repartition("__block").groupBy("__block").agg(F.bitmap_construct_agg("bit").alias("__map"))
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("__map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows_of = df.withColumn("__block", F.bitmap_bucket_number(place(key))).join(F.broadcast(maps), "__block")
    return rows_of.where(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(*df.columns)


def hot_signatures(docs: DataFrame, words: int, num: int, den: int) -> np.ndarray:
    """Signatures with at least a thousandth of the rows, so at most 1000; counted over one in ``HOT_TEXTS`` texts.

    They only say what is salted, no result depends on them.
    """
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(HOT_TEXTS)) == 0)
    rows = some.mapInPandas(_signatures(words, num, den, np.empty(0, np.int64)), SIGNED)
    counts = stage(rows.groupBy("signature").count().where(F.col("count") > 1), "signature-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    bar = max(total * HOT_SHARE, HOT_ROWS)
    hot = np.array(sorted(r[0] for r in counts.where(F.col("count") >= bar).select("signature").collect()), np.int64)
    release(docs.sparkSession, counts)
    return hot


def buckets(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``bucket``, ``parts``, ``fp``: the sets that share a signature, if more than one does.

    Signatures shared by the same sets are one bucket, named by the exclusive or of its members' hashes.
    A set that several tasks have seen counts once. Rows of a signature that very many sets have are
    dealt over salted parts, whose ends, names and counts are put together afterwards. ``parts`` is how many tasks the
    members of the bucket are to be compared in.
    """
    spark = docs.sparkSession
    hot = hot_signatures(docs, words, num, den)
    rows = docs.select("text").mapInPandas(_signatures(words, num, den, hot), SIGNED)
    # dealt once: equal rows of several tasks and the parts of a signature meet in one place
    once = rows.repartition("signature", "salt").distinct()
    part = Window.partitionBy("signature", "salt")
    name = F.bit_xor(F.xxhash64("fp"))
    named = once.select(
        "signature", "fp", name.over(part).alias("bucket"), F.min("fp").over(part).alias("low"),
        F.max("fp").over(part).alias("high"), F.count("fp").over(part).alias("sets"),
    )
    keys = spark.createDataFrame(pd.DataFrame({"signature": hot, "hot": np.ones(len(hot), bool)}), "signature long, hot boolean")
    named = named.join(F.broadcast(keys), "signature", "left_outer")
    named = stage(named.where("hot OR low < high").select("hot", F.when(F.col("hot"), F.col("signature")).alias("signature"), "bucket", "sets", "fp"), "members")
    whole = named.where("hot").groupBy("signature").agg(
        name.alias("bucket"), F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("fp").alias("sets")
    )
    salted = named.where("hot").select("signature", "fp").join(F.broadcast(whole.where("low < high")), "signature")
    shared = named.where("hot IS NULL").select("bucket", "sets", "fp").union(salted.select("bucket", "sets", "fp"))
    parts = (F.floor(F.col("sets") / PART_SETS) + 1).cast("int").alias("parts")
    out = stage(shared.select("bucket", parts, "fp").distinct(), "buckets")
    release(spark, named)
    return out


def lonely(sets: DataFrame) -> DataFrame:
    """``fp``, ``lone``: how many elements of each set no other of the ``sets`` has; sets without any are left out."""
    grams = sets.mapInPandas(_grams, "gram long, fp long")
    alone = grams.groupBy("gram").agg(F.count("fp").alias("holders"), F.min("fp").alias("fp")).where("holders = 1")
    return stage(alone.groupBy("fp").agg(F.count("gram").cast("int").alias("lone")), "lonely")


def linked_sets(docs: DataFrame, sizes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``node`` (fp), ``label``: components of the sets that are similar to another one.

    Elements that no other candidate has differ in every pair. A set with more of them than a similar pair may
    differ in altogether is out; two sets that both have more than half of that are never compared. So a group of
    copies whose own edits take them below the threshold costs nothing, however large it is.

    Pairs of a bucket are tested in rounds. In each, the centres, which are the sets on its highest level in the first
    round and on its highest ``LEVELS`` levels then, a few, are tested against those on the same or lower levels that are not yet known to be in
    the same component; then they leave the bucket, so the next ones are some times as many. There are half as many
    sets on each level as on the one below, by a hash; sets with many lone elements are on none and only met by centres.
    A bucket is done when all it still holds is in one component, or no centre is left. So large groups need few tests, and
    no pair whose test could join two components is left out. Pairs whose sizes, lone elements or sketches
    show that they differ in too many elements are no candidates. Members of a large bucket are dealt over its
    parts, its centres and its state are sent to all of them.
    """
    spark = docs.sparkSession
    shared = buckets(docs, words, num, den)
    reps = sizes.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in ["n", *SKETCH]])
    reps = stage(reps.join(shared.select("fp").distinct(), "fp"), "candidates")
    texts = among(docs.select("doc_id", "text"), "doc_id", reps.select("doc_id"), reps.count())
    sets = texts.join(reps.select("fp", "doc_id"), "doc_id").mapInPandas(_sets(words), "fp long, grams binary")
    sets = stage(sets, "sets")
    alone = lonely(sets)
    reps = reps.drop("doc_id").join(alone, "fp", "left_outer").withColumn("lone", F.coalesce("lone", F.lit(0)))
    reps = reps.where((F.col("n") - F.col("lone")) * den >= F.col("n") * num)
    half = F.col("lone") * (den + num) <= F.col("n") * (den - num)
    level = F.lit(63) - F.floor(F.log2(F.greatest(F.shiftrightunsigned(F.xxhash64("fp"), 1).cast("double"), F.lit(1.0))))
    reps = reps.withColumn("level", F.when(half, level.cast("int")).otherwise(F.lit(-LEVELS)))
    held = ["bucket", "parts", "part", "fp", "level", "n", "lone", *SKETCH]
    live = shared.join(reps, "fp").withColumn("part", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts")).cast("int"))
    live = compact(live.select(*held), "members", shared.count())
    release(spark, shared, alone)
    labels = spark.createDataFrame([], "node long, label long")
    rows = live.count()
    tested: list[DataFrame] = []
    staged: list[DataFrame] = [live]
    to_all_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    while True:
        now = live.join(labels, live["fp"] == labels["node"], "left_outer")
        now = now.select(*held, F.coalesce("label", "fp").alias("label"))
        left = now.groupBy("bucket", "parts").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("level").alias("top"))
        left = left.where("x < y AND top >= 0").select("bucket", "top", to_all_parts)
        live = compact(now.join(left, ["bucket", "part"]), "live", rows)
        release(spark, *staged)
        staged = [live]
        rows = live.count()
        if not rows:
            break
        levels = LEVELS if tested else 1  # one centre, mostly, links what is alike; the others are for what is left
        first = (F.col("level") >= 0) & (F.col("level") > F.col("top") - levels)
        centre = live.where(first).select("bucket", to_all_parts, F.col("fp").alias("c"), *[F.col(x).alias(f"c_{x}") for x in ["label", "n", "lone", *SKETCH]])
        apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"c_{x}"))) for x in SKETCH), F.lit(0))
        room = (F.col("n") + F.col("c_n")) * (den - num)
        pairs = live.join(centre, ["bucket", "part"]).where(
            (~first | (F.col("fp") < F.col("c"))) & (F.col("label") != F.col("c_label"))
            & (F.least("n", "c_n") * den >= F.greatest("n", "c_n") * num)
            & ((F.col("lone") + F.col("c_lone")) * (den + num) <= room)
            & (apart * (den + num) <= room)
        )
        pairs = pairs.select(F.least("fp", "c").alias("a"), F.greatest("fp", "c").alias("b")).distinct()
        for known in tested:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = compact(pairs, "pairs", 4 * rows)
        tested.append(pairs)
        few = pairs.count()
        x = among(sets, "fp", pairs.select("a"), few).select(F.col("fp").alias("a"), F.col("grams").alias("x"))
        y = among(sets, "fp", pairs.select("b"), few).select(F.col("fp").alias("b"), F.col("grams").alias("y"))
        links = stage(pairs.join(x, "a").join(y, "b").mapInPandas(_links(num, den), "a long, b long"), "similar")
        if not links.isEmpty():
            older = labels
            labels = components(links.union(older.select(F.col("node").alias("a"), F.col("label").alias("b"))))
            release(spark, older)
        release(spark, links)
        live = live.where(~first).select(*held)
    release(spark, live, sets, *tested)
    return labels


def near_duplicates(df: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every document (``doc_id``, ``text``).

    Two documents link if the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``num / den``; ``component_id`` is the smallest id reached by links. Candidates come from PartEnum
    signatures, which miss none, and are tested on the whole sets. Equal sets are one set, so
    copies are never paired.

    Texts that are null or without words have no shingle and link with nothing, and so do rows without an id,
    whose component is null. Rows that repeat an id are one document if their texts are, else the id
    is in the component of each of its texts, the smallest of which it returns. An empty table gives an empty result,
    other columns are ignored.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = stage(docs.mapInPandas(_sizes(words), "doc_id long, n int, fp long, s0 long, s1 long, s2 long, s3 long"), "sizes")
    named = docs.where(F.col("doc_id").isNotNull())
    known = linked_sets(named, sizes.where(F.col("doc_id").isNotNull()), words, num, den)
    reps = sizes.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    marked = reps.join(known, reps["fp"] == known["node"], "left_outer")
    marked = marked.select("fp", "rep", F.coalesce("label", "fp").alias("root"))
    least = marked.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = stage(marked.join(least, "root").select("fp", "component_id"), "set-components")
    release(spark, known)
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    rows = sizes.drop(*SKETCH)
    # copies of one text, and texts without words, are one set each, however many they are
    placed = lookup(rows, of_set, "fp", heavy_keys(rows, "fp"), "doc_id")
    return placed.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(df: DataFrame, **options) -> DataFrame:
    """The documents without those that link, directly or not, to one with a smaller id. Rows without an id stay."""
    groups = near_duplicates(df, **options)
    dropped = stage(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "near-copies")
    return df.join(dropped, "doc_id", "left_anti").select(*df.columns)

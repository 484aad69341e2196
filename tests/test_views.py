"""Written orders, line indexes, point lookups, sketches and spread joins."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import sketches
from riskloom.operators import anomaly, explore, features, link
from riskloom.plans import explorer as plan
from riskloom.plans.catalog import outlier_facts
from riskloom.sources import jsonl


def view_rows(spark, n=3000):
    df = spark.range(n).select(
        F.format_string("T%05d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("transaction_id"),
        F.when(F.col("id") % 5 > 0, F.round(F.pmod(F.col("id") * 31, F.lit(97)) / 97, 2)).alias("confidence"),
        F.concat(F.lit("x"), F.pmod(F.col("id") * 13, F.lit(40)).cast("string")).alias("amount"),
        F.element_at(F.array(*map(F.lit, ["zeta", "Alpha", "école", "alpha", "Zug"])), (F.col("id") % 5 + 1).cast("int")).alias("merchant_name"),
    )
    return df.repartition(7)


@pytest.mark.parametrize(("column", "down"), [("confidence", None), ("merchant_name", None), ("merchant_name", True), ("transaction_id", True), ("amount", None)])
def test_places_are_those_of_the_sorted_rows(spark, column, down):
    rows = view_rows(spark)
    want = [r["transaction_id"] for r in explore.sort_rows(rows, column, down).collect()]
    view = explore.sorted_view(rows, column, down, ranges=6)
    placed = {r["place"]: r["transaction_id"] for r in view.placed().collect()}
    assert [placed[i + 1] for i in range(len(want))] == want and len(placed) == len(want)
    for first, count in ((1, 10), (1495, 40), (2999, 10), (4000, 5)):
        part = view.stretch(first, count)
        assert [r["transaction_id"] for r in part.collect()] == want[first - 1 : first - 1 + count]
    # only files of the ranges that are met are read
    assert re.search(r"PartitionFilters: \[[^\]]*__range", view.stretch(100, 20)._jdf.queryExecution().toString())


def test_view_of_no_rows(spark):
    view = explore.sorted_view(view_rows(spark).limit(0))
    assert view.placed().collect() == [] and view.stretch(1, 5).collect() == []


def scanned_rows(df):
    """Rows that the file scan of a collected frame has given out."""
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        node = plans.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        below = node.children()
        plans += [below.apply(i) for i in range(below.size())]
    return total


def test_point_lookup_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "by-id")
    rows = spark.range(200_000).select(F.format_string("T%07d", F.col("id") * 3).alias("transaction_id"), F.col("id").alias("n"))
    explore.write_clustered(rows, path, group_bytes=64 * 1024)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for wanted, found in (("T0300000", 1), ("T0300001", 0), ("nobody", 0)):
            df = explore.read_detail(spark, path, wanted)
            assert len(df.collect()) == found
            # an id that is not there lies within some row group's range; the bloom filter rules it out
            assert scanned_rows(df) < 30_000 if found else scanned_rows(df) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stored_line_index(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    for name in "ab":
        (folder / f"{name}.jsonl").write_text("".join("\n" if i % 5 == 0 else f"{name}{i}\n" for i in range(1, 3001)))
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in settings}
    try:
        spark.conf.set(settings[0], "4000")
        spark.conf.set(settings[1], "1")
        index = jsonl.index_lines(spark, str(folder))
        assert index.count() > 6
        stored = str(tmp_path / "index")
        index.write.parquet(stored)
        index = spark.read.parquet(stored)
        got = jsonl.read_jsonl_numbered(spark, str(folder), index)
        rows = [(r["file"][-7], r["line"], r["value"]) for r in got.collect()]
        assert sorted(rows) == sorted((n, i, f"{n}{i}") for n in "ab" for i in range(1, 3001) if i % 5)
        assert {r["file"][-7]: r["before"] for r in jsonl.lines_before(index).collect()} == {"a": 0, "b": 3000}
        # neither the text nor the numbered lines are shuffled
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().toString()
        spark.conf.set(settings[0], "1500")
        with pytest.raises(Exception, match="line index does not fit"):
            jsonl.read_jsonl_numbered(spark, str(folder), index).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_sketched_quantiles_and_frequent_values(spark):
    draw = np.random.default_rng(1)
    values = np.concatenate([draw.lognormal(sigma=3, size=60_000), np.full(30_000, 7.0)])
    df = spark.createDataFrame([(i % 13, float(v)) for i, v in enumerate(values)], "g int, v double")
    parts = sketches.quantile_sketches(df, ["v"], ["g"], size=400)
    for share in (0.01, 0.5, 0.9):
        found = sketches.quantiles(parts, ["v"], share)["v"]
        error = 2 * sketches.rank_error(400)
        assert (values < found).mean() <= share + error and (values <= found).mean() >= share - error
    assert sketches.quantiles(parts.limit(0), ["v"]) == {"v": None}
    keys = df.select(F.when(F.col("v") == 7, F.lit("hot")).when(F.col("g") == 3, F.lit(None)).otherwise((F.col("v") * 1e6).cast("string")).alias("k"))
    assert set(sketches.frequent(keys, "k", 0.001)) == {"hot"}
    assert abs(sketches.frequent(keys, "k", 0.001)["hot"] - 1 / 3) < 0.01 and sketches.frequent(keys.limit(0), "k", 0.1) == {}


def spread(df):
    counts = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("found"))
    return sorted(r["rows"] for r in counts.collect())


def test_heavy_keys_are_spread_by_their_share(spark):
    facts = spark.range(90_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit("warm")).when(F.col("id") % 7 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"),
    )
    side = facts.select("k").where("k is not null").distinct().withColumn("v", F.upper("k"))
    before = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        heavy = link.heavy_keys(facts, "k")
        assert "hot" in heavy and heavy.shares["hot"] > heavy.shares["warm"]
        plain = link.lookup(facts, side.hint("shuffle_hash"), "k")
        salted = link.lookup(facts, side.hint("shuffle_hash"), "k", heavy, "id")
        assert salted.where("v IS DISTINCT FROM upper(k)").count() == 0 and salted.count() == 90_000
        assert max(spread(plain)) > 5 * np.median(spread(plain))
        assert max(spread(salted)) < 2 * np.median(spread(salted))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_explorer_with_a_repeated_verdict(spark):
    lines = [f'{{"transaction_id": "t{i if i % 3 else 1}", "is_fraud": true, "confidence": 0.5, "justification": "x"}}' for i in range(900)]
    marked = jsonl.mark_documents(spark.createDataFrame([(x,) for x in lines], "value string"))
    transactions = spark.createDataFrame([(f"t{i}", f"a{i % 5}", "") for i in range(900)], "transaction_id string, account_id string, customer_id string")
    accounts = spark.createDataFrame([(f"a{i}", f"c{i}", "S") for i in range(5)], "account_id string, customer_id string, account_type string")
    customers = spark.createDataFrame([(f"c{i}", "LOW") for i in range(4)], "customer_id string, risk_rating string")
    plain, balanced = (plan.explorer_rows(marked, transactions, accounts, customers, balance=b) for b in (False, True))
    assert sorted(plain.collect()) == sorted(balanced.collect()) and plain.count() == 900


def test_forest_in_the_jvm(spark):
    """The stored model scores as the arrays do, for grown trees and for one built by hand."""
    draw = np.random.default_rng(0)
    points = np.round(draw.normal(size=(2000, 9)), 2)
    kinds = "k string, " + ", ".join(f"{c} double" for c in features.FEATURE_COLUMNS)
    df = spark.createDataFrame([(f"k{i:04d}", *map(float, p)) for i, p in enumerate(points)], kinds)
    forest = anomaly.fit_forest(df, "k", 2000, trees=30)
    scored = anomaly.score_forest(df, forest)
    assert "Python" not in scored._jdf.queryExecution().toString()
    got = np.array([r["anom_raw"] for r in scored.orderBy("k").collect()])
    assert np.abs(got - forest.score(points)).max() < 1e-12
    # x0 <= 1 ? leaf 1.0 : (x1 <= 5 ? 2.5 : 2.0); and a tree that is a single leaf
    inf = np.inf
    hand = anomaly.Forest(
        np.array([[0, 0, 1], [0, 0, 0]]), np.array([[1.0, inf, 5.0], [inf, inf, inf]]), np.array([[1.0, 0, 2.5, 2.0], [0.5, 0, 0, 0]]), 4
    )
    rows = [(1.0, 9.0), (1.1, 5.0), (2.0, 5.1)]
    few = spark.createDataFrame([(str(i), a, b, *[0.0] * 7) for i, (a, b) in enumerate(rows)], kinds)
    expected = float(anomaly.path_length(4))
    paths = [(1.0 + 0.5) / 2, (2.5 + 0.5) / 2, (2.0 + 0.5) / 2]
    got = [r["anom_raw"] for r in anomaly.score_forest(few, hand).orderBy("k").collect()]
    assert np.allclose(got, [2 ** -(p / expected) for p in paths], rtol=0, atol=1e-12)


def test_outlier_facts_fail_on_shuffled_scores(spark):
    rows = [(i < 4, 0.9 + i / 1000 if i < 4 else i / 2000) for i in range(1000)]
    good = spark.createDataFrame(rows, "planted boolean, anom_score double")
    assert tuple(outlier_facts(good).first()) == (4, 4)
    scores = [s for _, s in rows]
    np.random.default_rng(0).shuffle(scores)
    bad = spark.createDataFrame([(p, s) for (p, _), s in zip(rows, scores)], "planted boolean, anom_score double")
    assert outlier_facts(bad).first()["above"] < 4

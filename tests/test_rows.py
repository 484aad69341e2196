"""Duplicates, joins and comparisons."""

import random

from pyspark.sql import functions as F

from riskloom.operators import compare, dedupe, link


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def test_dedupe(spark):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), (None, 5, "n"), (None, 4, "m"), ("", 1, "e"), ("b", 1, None)],
        "k string, n int, v string",
    )
    assert dedupe.drop_exact(df).count() == 6
    assert rows(dedupe.keep_first(df, "k", ["n"]), "k", "v") == sorted(
        [("a", "y"), (None, "m"), ("", "e"), ("b", None)], key=repr
    )
    assert rows(dedupe.keep_last(df, "k", ["n"]), "k", "v") == [("a", "x"), ("b", None)]
    assert tuple(dedupe.duplicate_counts(df, "k").first()) == (7, 1, 2, 4, 3)
    repeated = dedupe.duplicate_keys(df.where("k is not null"), "k")
    assert rows(repeated, "k", "occurrences") == [("a", 3)]
    assert tuple(dedupe.duplicate_examples(repeated, "k").first()) == (1, ["a"])
    none = dedupe.duplicate_examples(repeated.where("false"), "k").first()
    assert (none["duplicated"], none["examples"]) == (0, [])


def test_a_key_is_cut_down_before_the_shuffle(spark, capsys):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    dedupe.keep_first(df, "k", ["id"]).explain()
    plan = capsys.readouterr().out
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def tables(spark):
    transactions = spark.createDataFrame(
        [("t1", "a1", "c9"), ("t2", "a2", "c2"), ("t3", "a9", "c2"), ("t4", "a9", "c8"), ("t5", None, None),
         ("t6", "a3", "c1"), ("t7", "a1", None)],
        "transaction_id string, account_id string, customer_id string",
    ).withColumn("city", F.lit("here"))
    accounts = spark.createDataFrame(
        [("a1", "c1", "S"), ("a1", "c2", "T"), ("a2", None, "U"), ("a3", "c7", "V"), (None, "c1", "W")],
        "account_id string, customer_id string, account_type string",
    )
    customers = spark.createDataFrame(
        [("c1", "HIGH", "x"), ("c1", "LOW", "y"), ("c2", "LOW", "z"), (None, "NULL", "w")],
        "customer_id string, risk_rating string, city string",
    )
    return transactions, accounts, customers


def test_link(spark):
    transactions, accounts, customers = tables(spark)
    linked = link.link(transactions, accounts, customers)
    assert link.assert_same_rows(transactions, linked) == 7
    got = rows(linked, "transaction_id", "customer_id_acct", "customer_id_final", "risk_rating",
               "city", "city_cust", "orphan_account", "orphan_customer")
    assert got == [
        ("t1", "c1", "c1", "HIGH", "here", "x", False, False),
        ("t2", None, "c2", "LOW", "here", "z", True, False),
        ("t3", None, "c2", "LOW", "here", "z", True, False),
        ("t4", None, "c8", None, "here", None, True, True),
        ("t5", None, None, None, "here", None, True, True),
        ("t6", "c7", "c7", None, "here", None, False, True),
        ("t7", "c1", "c1", "HIGH", "here", "x", False, False),
    ]
    assert tuple(link.orphan_counts(linked).first()) == (4, 3, 7)


def test_salted_joins_are_the_same(spark, monkeypatch):
    transactions, accounts, customers = tables(spark)
    plain = link.link(transactions, accounts, customers, balance=False)
    monkeypatch.setattr(link, "heavy_links", lambda t, a: (["a1", "a9"], ["c1", "c2"]))
    salted = link.link(transactions, accounts, customers, balance=True)
    assert compare.same_rows(plain, salted)


def test_heavy_keys(spark):
    rng = random.Random(1)
    keys = ["hot"] * 400 + [None] * 300 + [f"k{rng.randint(0, 300)}" for _ in range(500)]
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "k string, transaction_id string")
    assert link.heavy_keys(df, "k", share=0.1) == ["hot"]
    assert link.heavy_keys(df, "k", share=0.5) == []
    dimension = df.select("k").where("k is not null").distinct().withColumn("v", F.upper("k"))
    plain = link.lookup(df, dimension, "k")
    salted = link.lookup(df, dimension, "k", ["hot"], "transaction_id", salts=8)
    assert compare.same_rows(plain, salted)


def test_null_keys_match_if_asked(spark):
    facts = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("z", 4)], "k string, id long")
    dimension = spark.createDataFrame([("a", "A"), (None, "none")], "k string, v string")
    for heavy in (None, [], ["a"]):
        for null_safe, found in ((False, None), (True, "none")):
            joined = link.lookup(facts, dimension, "k", heavy, "id", salts=4, null_safe=null_safe)
            assert joined.columns == ["k", "id", "v"]
            assert {r["id"]: r["v"] for r in joined.collect()} == {1: "A", 2: found, 3: found, 4: None}


def test_heavy_links(spark):
    transactions, accounts, _ = tables(spark)
    sides = accounts.where("account_id is not null").dropDuplicates(["account_id"])
    sides = sides.withColumnRenamed("customer_id", "customer_id_acct")
    accounts_found, customers_found = link.heavy_links(transactions, sides, share=0.25)
    assert accounts_found == ["a1", "a9"]
    assert "c2" in customers_found


def test_ledger(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    produced = spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "k string")
    ledger = link.id_ledger(expected, produced, "k")
    assert rows(ledger, "id", "expected", "produced") == sorted(
        [("a", 1, 0), ("b", 2, 1), ("c", 0, 2), (None, 0, 1)], key=repr
    )
    assert rows(link.coverage(ledger), "id", "side") == sorted(
        [("a", "missing"), ("c", "extra"), (None, "extra")], key=repr
    )


def test_frame_diff(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    right = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "a int, b string")
    assert rows(compare.frame_diff(left, right), "a", "b", "surplus") == [(1, None, 1), (3, "y", -1)]
    assert compare.same_rows(left, left.repartition(3)) and not compare.same_rows(left, right)

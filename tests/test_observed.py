"""Counts observed while a job writes, against counts of their own."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import compare, link, observed
from riskloom.plans import report, scoring, virtual
from riskloom.sources.tables import POSITION

SF = "/root/testdata/sf0.001"


def positioned(spark):
    return tuple(read(spark, SF, position=True) for read in (virtual.transactions, virtual.accounts, virtual.customers))


@pytest.mark.parametrize("again", [False, True])
def test_report_from_observed_counts(spark, monkeypatch, again):
    """The same report as from jobs of its own, also if the observed numbers must be counted anew."""
    monkeypatch.setattr(observed, "_run_again", lambda spark, group: again)
    tables = positioned(spark)
    linked, values = report.link_counted(*tables, order_by=[POSITION])
    scored = linked.select((F.col("amount") > 1000).alias("is_fraud"))
    plain = [t.drop(POSITION) for t in tables]
    want = report.quality_report(*plain, linked, scored).first().asDict(recursive=True)
    assert report.report_of(plain[0], scored, values).first().asDict(recursive=True) == want
    assert compare.same_rows(linked, scoring.prepare(*tables, order_by=[POSITION]))


def test_empty_tables(spark):
    tables = [t.limit(0) for t in positioned(spark)]
    linked, values = report.link_counted(*tables, order_by=[POSITION])
    assert linked.count() == 0 and values["raw"]["rows"] == values["kept"]["keys"] == values["customers"]["keys"] == 0


def test_job_group_is_restored_and_changes_are_noticed(spark):
    context = spark.sparkContext
    context.setLocalProperty("spark.jobGroup.id", "mine")
    counts = observed.Counts()
    rows = F.count(F.lit(1)).alias("rows")
    out = counts.stage(counts.watch("unlinked", spark.range(7), rows).union(spark.range(1)), "seven")
    assert context.getLocalProperty("spark.jobGroup.id") == "mine"
    context.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 8 and counts.values == {"unlinked": {"rows": 7}} and not counts.recounted
    with pytest.raises(AssertionError, match="7 to 8"):
        link.assert_watched({**counts.values, "linked": {"rows": 8}})
    assert link.assert_watched({**counts.values, "linked": {"rows": 7}}) == 7


def test_fingerprints_see_a_single_swap(spark):
    rows = [(i, f"n{i % 5}", float(i), [i, None], {"a": i}) for i in range(500)]
    kinds = "i long, s string, d double, v array<int>, m map<string,int>"
    left = spark.createDataFrame(rows, kinds)
    assert compare.same_rows(left, left.repartition(7).orderBy(F.desc("i")))
    swapped = [(*r[:1], rows[(n + 1) % 500][1], *r[2:]) if n in (10,) else r for n, r in enumerate(rows)]
    right = spark.createDataFrame(swapped, kinds)
    assert not compare.same_rows(left, right)
    flat = [f.select("i", "s", "d") for f in (left, right)]
    assert compare.changed_rows(*flat) == 2 and compare.changed_rows(flat[0], flat[0].repartition(3)) == 0
    # nulls in different places, repeated rows, values that move between columns or lists
    for a, b in (
        ([(None, "x")], [("x", None)]), ([("x", "y")], [("y", "x")]), ([("x", "y")] * 2, [("x", "y")]), ([(None, None)], [("", "")]),
        ([("x", "y")], []),
    ):
        one, other = (spark.createDataFrame(x, "p string, q string") for x in (a, b))
        assert not compare.same_rows(one, other) and compare.changed_rows(one, other) > 0
    lists = [spark.createDataFrame([x], "p array<int>, q array<int>") for x in (([1, 2], [3]), ([1], [2, 3]))]
    assert not compare.same_rows(*lists)
    assert compare.same_rows(left.limit(0), right.limit(0))

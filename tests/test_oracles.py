"""Queries against their SQL on the smallest tables; all of them with RISKLOOM_ALL=1."""

import os

import pytest

import __spark_entry__ as contract
from oracles import ORACLES
from riskloom.plans.catalog import QUERIES

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUICK = [
    "normalize_missing", "parse_times", "normalize_status_flags", "customer_signals",
    "dedupe_exact", "dedupe_key_first", "dedupe_key_last", "duplicate_counts", "join_chain",
    "coverage", "record_counts", "invalid_counts", "top_missing", "exact_medians", "rule_reasons",
    "verdict_records", "sanitize_merchants", "sanitize_conversations", "sanitize_pages",
    "clean_generated", "label_parse", "validate_lines", "validate_summary", "explorer",
    "dashboard_metrics", "numbered_lines", "lookup_last", "report_written", "splits_written",
    "explorer_written", "absent_columns", "split_exact", "confusion_metrics", "evaluation_delta",
]
CHOSEN = sorted(ORACLES) if os.environ.get("RISKLOOM_ALL") else QUICK


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield connection
    connection.close()


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    answer = sql.execute(ORACLES[name])
    names = [column[0] for column in answer.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(df.collect(), df.columns) == normal(answer.fetchall(), names)


def test_every_query_has_sql_but_learned_ones():
    assert set(QUERIES) - set(ORACLES) == {"anomaly_forest", "scoring_run"}
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["transaction_id", "is_fraud", "confidence", "justification"]
    assert rows.count() == 1500

"""The explorer job: written verdicts joined back to the tables they came from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import explore
from riskloom.operators.link import heavy_keys, heavy_links, lookup
from riskloom.sources.jsonl import read_jsonl_tolerant, read_report
from riskloom.sources.tables import read_lookup


@dataclass(frozen=True)
class ExplorerView:
    rows: DataFrame
    metrics: DataFrame
    report: DataFrame | None
    message: str | None


def explorer_rows(
    marked: DataFrame,
    transactions: DataFrame | None,
    accounts: DataFrame | None,
    customers: DataFrame | None,
    balance: bool = False,
) -> DataFrame:
    """Explorer rows of tolerantly read lines; ``balance`` spreads heavy ids, accounts and owners.

    The owner that is joined is the account's, an empty one gives way to the transaction's.
    What is heavy is measured on the verdicts: an id that they repeat makes its account and
    owner heavy too.
    """
    rows = explore.verdict_rows(marked)
    heavy_accounts = heavy_customers = heavy_ids = None
    if balance and transactions is not None:
        heavy_ids = heavy_keys(rows, "transaction_id")
        if accounts is not None:
            owners = accounts.select(
                "account_id", F.nullif(F.col("customer_id"), F.lit("")).alias("customer_id_acct")
            )
            keys = transactions.select("transaction_id", "account_id", "customer_id")
            ids = rows.select("transaction_id").withColumn("__row", F.monotonically_increasing_id())
            met = lookup(ids, keys, "transaction_id", heavy_ids, "__row")
            heavy_accounts, heavy_customers = heavy_links(
                met.withColumn("transaction_id", F.col("__row")), owners
            )
    return explore.explorer(
        rows, transactions, accounts, customers, heavy_accounts, heavy_customers, heavy_ids
    )


def open_explorer(
    spark: SparkSession,
    verdict_path: str,
    transactions_path: str,
    accounts_path: str,
    customers_path: str,
    report_path: str,
    multiline: bool = False,
) -> ExplorerView:
    """Everything a viewer needs; any input may be missing or broken.

    ``multiline`` says that quoted fields of the three tables may hold line breaks.
    """
    marked, message = read_jsonl_tolerant(spark, verdict_path)
    tables = [
        read_lookup(spark, transactions_path, "transaction_id", multiline),
        read_lookup(spark, accounts_path, "account_id", multiline),
        read_lookup(spark, customers_path, "customer_id", multiline),
    ]
    there = [table is not None and not table.isEmpty() for table in tables]
    rows = explorer_rows(marked, *tables)
    metrics = explore.dashboard_metrics(marked, *there)
    return ExplorerView(rows, metrics, read_report(spark, report_path), message)

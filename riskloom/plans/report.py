"""The data-quality report over raw, deduplicated, linked and scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import quality
from riskloom.operators.clean import normalize_na
from riskloom.operators.link import assert_watched
from riskloom.operators.observed import Counts
from riskloom.operators.text import sanitize
from riskloom.operators.verdict import verdict_rate
from riskloom.plans.scoring import prepare, scoring_columns


def report_metrics(
    transactions: DataFrame,
    accounts: DataFrame,
    customers: DataFrame,
    linked: DataFrame,
    scored: DataFrame,
) -> DataFrame:
    """All counts as rows (section, metric, value); nothing is evaluated here.

    One aggregate per table and grouping: what can be counted in the same pass is.
    """
    raw = normalize_na(transactions)
    counted = [
        (
            quality.key_counts(
                normalize_na(customers), "customer_id", "customers_raw", "customers_dedup"
            ),
            ["record_counts"],
        ),
        (
            quality.key_counts(
                normalize_na(accounts), "account_id", "accounts_raw", "accounts_dedup"
            ),
            ["record_counts"],
        ),
        (quality.transaction_counts(raw), ["record_counts", "duplicates_removed"]),
        (
            quality.linked_counts(linked),
            ["record_counts", "invalid_or_corrupt", "orphaned_relationships"],
        ),
        (verdict_rate(scored), ["flagged_transactions"]),
    ]
    parts = [quality.raw_text_counts(raw)]
    for one_row, sections in counted:
        names = {
            section: [
                name
                for name in [*quality.REPORT_SECTIONS[section], "fraud_rate"]
                if name in one_row.columns
            ]
            for section in sections
        }
        parts.append(quality.metric_rows(one_row, names))
    return quality.union_all(parts)


def quality_report(
    transactions: DataFrame,
    accounts: DataFrame,
    customers: DataFrame,
    linked: DataFrame,
    scored: DataFrame,
) -> DataFrame:
    """The nested one-row report; ``linked`` and ``scored`` are best staged."""
    return quality.assemble_report(
        report_metrics(transactions, accounts, customers, linked, scored)
    )


def link_counted(
    transactions: DataFrame, accounts: DataFrame, customers: DataFrame, keep: list[str] | None = None, **options
) -> tuple[DataFrame, dict[str, dict]]:
    """Linked rows, staged, and all counts of the report that can be taken while they are written.

    Raw rows, kept rows, dimensions and linked rows are observed as they pass; that linking kept
    the number of rows is checked.  ``keep`` cuts the staged rows down to what scoring reads and
    these columns; the counts are those of all columns.
    """
    counts = Counts()

    def watch(name: str, df: DataFrame, *more: Column) -> DataFrame:
        if name != "raw":
            return counts.watch(name, df, *more)
        safe = sanitize(df, "merchant_name", "__safe", "__flagged")
        rows = F.count(F.lit(1)).alias("rows")
        seen = counts.watch(name, safe, rows, *quality.raw_text_expressions(df.columns))
        return seen.drop("__safe", "__flagged")

    linked = prepare(transactions, accounts, customers, watch=watch, **options)
    linked = counts.watch("result", linked, *quality.linked_expressions())
    linked = counts.stage(linked if keep is None else scoring_columns(linked, keep), "linked")
    assert_watched(counts.values)
    return linked, counts.values


def counted_metrics(values: dict[str, dict]) -> list[tuple[str, str, float]]:
    """Observed counts as metric rows (section, metric, value); duplicates of both kinds are one number here."""
    raw = dict(values["raw"])
    found = {
        "transactions_raw": raw.pop("rows"), "transactions_unique_ids": values["kept"]["keys"],
        "accounts_raw": values["accounts_raw"]["rows"], "accounts_dedup": values["accounts"]["keys"],
        "customers_raw": values["customers_raw"]["rows"], "customers_dedup": values["customers"]["keys"],
        "merchant_strings_flagged": raw.pop("merchant_strings_flagged"), **values["result"],
    }
    places = {name: section for section, names in quality.REPORT_SECTIONS.items() for name in names}
    rows = [(places[name], name, float(value)) for name, value in found.items()]
    return rows + [("missing_values_by_field", name, float(n)) for name, n in raw.items() if n]


def report_of(transactions: DataFrame, scored: DataFrame, values: dict[str, dict]) -> DataFrame:
    """The nested one-row report from observed counts.

    Two things are still counted: how many dropped rows were exact copies, from keys and row
    hashes alone, and the verdicts.
    """
    copies = quality.transaction_counts(normalize_na(transactions)).select(
        "txn_full_duplicate_rows", "txn_duplicate_ids_after"
    )
    rate = verdict_rate(scored)
    metrics = [
        scored.sparkSession.createDataFrame(counted_metrics(values), "section string, metric string, value double"),
        quality.metric_rows(copies, {"duplicates_removed": copies.columns}),
        quality.metric_rows(rate, {"flagged_transactions": rate.columns}),
    ]
    return quality.assemble_report(quality.union_all(metrics))

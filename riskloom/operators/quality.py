"""Data-quality counts and the report made of them.

Counts travel as rows (section, metric, value), a few per check, so that separate checks are
put together by a union and one last small group, never by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.operators.dedupe import duplicate_counts
from riskloom.operators.text import sanitize


def metric_rows(one_row: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """Numbers of a one-row frame as rows (section, metric, value), all from one aggregate."""
    entries = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(name).alias("metric"),
            F.col(name).cast("double").alias("value"),
        )
        for section, names in sections.items()
        for name in names
    ]
    return one_row.select(F.inline(F.array(*entries)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), parts)


def key_counts(table: DataFrame, key: str, rows: str, keys: str) -> DataFrame:
    """One row: rows and distinct non-null keys, copies being summed up before the shuffle."""
    per_key = table.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(rows), F.count(key).alias(keys))


def record_counts(customers: DataFrame, accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Raw rows and distinct non-null keys of the three raw tables, as metric rows."""
    return union_all(
        [
            metric_rows(key_counts(table, key, rows, keys), {"record_counts": [rows, keys]})
            for table, key, rows, keys in [
                (customers, "customer_id", "customers_raw", "customers_dedup"),
                (accounts, "account_id", "accounts_raw", "accounts_dedup"),
                (transactions, "transaction_id", "transactions_raw", "transactions_unique_ids"),
            ]
        ]
    )


def transaction_counts(transactions: DataFrame, key: str = "transaction_id") -> DataFrame:
    """One row of all counts that need the raw rows grouped: rows, ids and dropped copies."""
    return duplicate_counts(transactions, key).select(
        F.col("rows").alias("transactions_raw"),
        F.col("present_keys").alias("transactions_unique_ids"),
        F.col("full_duplicates").alias("txn_full_duplicate_rows"),
        F.col("key_duplicates").alias("txn_duplicate_ids_after"),
    )


def _invalid() -> list[Column]:
    return [
        F.count_if(F.col("amount").isNull()).alias("amount_non_numeric"),
        F.count_if(F.col("amount") <= 0).alias("amount_non_positive"),
        F.count_if(F.col("ts").isNull()).alias("timestamp_unparseable"),
        F.count_if("ts_future").alias("timestamp_in_future"),
    ]


def invalid_counts(cleaned: DataFrame) -> DataFrame:
    """One row over deduplicated, cleaned transactions; missing counts as non-numeric."""
    return cleaned.agg(*_invalid())


def linked_expressions() -> list[Column]:
    """All counts over linked rows: invalid values, orphans and rows."""
    return [
        *_invalid(),
        F.count_if("orphan_account").alias("txn_account_id_not_in_accounts"),
        F.count_if("orphan_customer").alias("txn_customer_id_not_in_customers"),
        F.count(F.lit(1)).alias("transactions_final"),
    ]


def linked_counts(linked: DataFrame) -> DataFrame:
    """One row of all counts over linked rows."""
    return linked.agg(*linked_expressions())


def _missing(fields: list[str]) -> list[Column]:
    return [F.count_if(F.col(name).isNull()).alias(name) for name in fields]


def missing_by_field(raw: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Rows (position, field, missing) for the fields that exist and miss something.

    One pass with one counter per field.
    """
    fields = [name for name in fields or fixed.REPORTED_FIELDS if name in raw.columns]
    if not fields:
        return raw.sparkSession.createDataFrame([], "position int, field string, missing bigint")
    entries = [
        F.struct(
            F.lit(place).alias("position"), F.lit(name).alias("field"),
            F.col(name).alias("missing"),
        )
        for place, name in enumerate(fields)
    ]
    counts = raw.agg(*_missing(fields))
    return counts.select(F.inline(F.array(*entries))).where(F.col("missing") > 0)


def raw_text_expressions(columns: list[str]) -> list[Column]:
    """Counts over raw rows with a flag for hostile merchants: those, and missing values by field."""
    fields = [name for name in fixed.REPORTED_FIELDS if name in columns]
    return [F.count_if("__flagged").alias("merchant_strings_flagged"), *_missing(fields)]


def raw_text_counts(raw: DataFrame) -> DataFrame:
    """Metric rows of one pass over raw rows: missing values, and merchants that look hostile."""
    safe = sanitize(raw, "merchant_name", "__safe", "__flagged")
    counts = safe.agg(*raw_text_expressions(raw.columns))
    fields = [name for name in counts.columns if name != "merchant_strings_flagged"]
    rows = metric_rows(
        counts,
        {"prompt_injection": ["merchant_strings_flagged"], "missing_values_by_field": fields},
    )
    return rows.where((F.col("section") != "missing_values_by_field") | (F.col("value") > 0))


def top_missing(missing: DataFrame, rows: int = 6) -> DataFrame:
    """The fields that miss most, ties in field order."""
    return missing.orderBy(F.desc("missing"), F.asc("position")).limit(rows)


def flagged_text(sanitized: DataFrame, flagged: str = "text_flagged") -> DataFrame:
    """One row: how many texts looked hostile."""
    return sanitized.agg(F.count_if(flagged).alias("merchant_strings_flagged"))


# fixed layout of the report: section -> whole-number metrics, and its note
REPORT_SECTIONS = {
    "record_counts": [
        "customers_raw", "customers_dedup", "accounts_raw", "accounts_dedup",
        "transactions_raw", "transactions_unique_ids", "transactions_final",
    ],
    "duplicates_removed": ["txn_full_duplicate_rows", "txn_duplicate_ids_after"],
    "invalid_or_corrupt": [
        "amount_non_numeric", "amount_non_positive", "timestamp_unparseable",
        "timestamp_in_future",
    ],
    "orphaned_relationships": [
        "txn_account_id_not_in_accounts", "txn_customer_id_not_in_customers",
    ],
    "missing_values_by_field": [],
    "prompt_injection": ["merchant_strings_flagged"],
    "flagged_transactions": ["is_fraud_true", "is_fraud_false"],
}
REPORT_NOTES = {
    "orphaned_relationships": "counted on the joined rows, owners of accounts first",
    "prompt_injection": "texts in which something was masked; scores never read them",
    "flagged_transactions": "share of rows above the threshold, measured against nothing",
}


def assemble_report(metrics: DataFrame) -> DataFrame:
    """Metric rows to one nested row, laid out as REPORT_SECTIONS.

    Rows of section ``missing_values_by_field`` become a map of field to count.
    """
    picked: dict[str, Column] = {}
    for section, names in REPORT_SECTIONS.items():
        for name in names + (["fraud_rate"] if section == "flagged_transactions" else []):
            here = (F.col("section") == section) & (F.col("metric") == name)
            picked[name] = F.max(F.when(here, F.col("value"))).alias(name)
    is_missing = F.col("section") == "missing_values_by_field"
    entry = F.struct("metric", F.col("value").cast("bigint"))
    # at most one entry per reported field
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.when(is_missing, entry))))
    flat = metrics.agg(*picked.values(), fields.alias("missing_values_by_field"))
    sections = []
    for section, names in REPORT_SECTIONS.items():
        if section == "missing_values_by_field":
            sections.append(F.col(section))
            continue
        members = [F.col(name).cast("bigint").alias(name) for name in names]
        if section == "flagged_transactions":
            members.append(F.col("fraud_rate"))
        if section in REPORT_NOTES:
            members.append(F.lit(REPORT_NOTES[section]).alias("note"))
        sections.append(F.struct(*members).alias(section))
    return flat.select(*sections)


def report_rows(report: DataFrame) -> DataFrame:
    """The nested report as eight labelled rows, as a summary panel shows it."""
    text = lambda path: F.coalesce(F.col(path).cast("string"), F.lit(""))
    # fixed labels and their order
    rows = [
        ("Transactions (raw → final)", F.concat(
            text("record_counts.transactions_raw"), F.lit(" → "),
            text("record_counts.transactions_final"))),
        ("Duplicate rows removed", text("duplicates_removed.txn_full_duplicate_rows")),
        ("Amount: non-numeric", text("invalid_or_corrupt.amount_non_numeric")),
        ("Amount: non-positive", text("invalid_or_corrupt.amount_non_positive")),
        ("Timestamp: unparseable", text("invalid_or_corrupt.timestamp_unparseable")),
        ("Orphan txn → account", text("orphaned_relationships.txn_account_id_not_in_accounts")),
        ("Orphan txn → customer", text("orphaned_relationships.txn_customer_id_not_in_customers")),
        ("Injection strings flagged", text("prompt_injection.merchant_strings_flagged")),
    ]
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), value.alias("shown"))
        for i, (label, value) in enumerate(rows)
    ]
    return report.select(F.inline(F.array(*entries)))

"""Dirty transaction, account and customer tables derived from the given star schema.

The given tables are clean, so dirt is planted by key arithmetic over all of their rows: bad
numbers and times, spellings, unknown and missing keys, exact copies and repeated ids.  The
statements use only what Spark SQL and ANSI engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_ID = "'TXN_' || lpad(CAST(o_orderkey AS STRING), 10, '0')"
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_CLOCK = (
    "lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':' || "
    "lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') || ':' || "
    "lpad(CAST(o_orderkey % 59 AS STRING), 2, '0')"
)
_FLAG = (
    "CASE ({key}) % 10 WHEN 0 THEN 'Y' WHEN 1 THEN ' yes ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '1' "
    "WHEN 4 THEN 'maybe' WHEN 5 THEN NULL WHEN 6 THEN 'F' WHEN 7 THEN '1.0' ELSE 'n' END"
)

# column -> expression over a row of orders
_TRANSACTION_COLUMNS = {
    "transaction_id": _ID,
    "account_id": (
        "CASE WHEN o_orderkey % 121 = 0 THEN 'ACC_X' || CAST(o_orderkey AS STRING) "
        "WHEN o_orderkey % 127 = 0 THEN 'NULL' "
        "ELSE 'ACC_' || lpad(CAST(o_custkey AS STRING), 8, '0') END"
    ),
    "customer_id": (
        "CASE WHEN o_orderkey % 121 = 0 THEN '' WHEN o_orderkey % 127 = 0 THEN 'CUST_X' "
        "ELSE 'CUST_' || lpad(CAST(o_custkey - o_custkey % 3 AS STRING), 8, '0') END"
    ),
    "transaction_timestamp": (
        "CASE o_orderkey % 23 WHEN 0 THEN 'yesterday' WHEN 1 THEN " + _DAY + " || 'T' || " + _CLOCK
        + " WHEN 2 THEN 'N/A' WHEN 3 THEN '2031-05-06 07:08:09' WHEN 4 THEN " + _DAY
        + " WHEN 5 THEN '2026-02-30 10:00:00' WHEN 6 THEN '2026-1-2 3:04:05'"
        + " WHEN 7 THEN '9999-12-31 00:00:00' ELSE " + _DAY + " || ' ' || " + _CLOCK + " END"
    ),
    "transaction_hour": (
        "CASE o_orderkey % 17 WHEN 0 THEN '' WHEN 1 THEN '25' WHEN 2 THEN '13.5' "
        "WHEN 3 THEN 'noon' ELSE CAST(o_orderkey % 24 AS STRING) END"
    ),
    "amount": (
        "CASE o_orderkey % 29 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN '-' || " + _PRICE
        + " WHEN 3 THEN 'abc' WHEN 4 THEN '0' WHEN 5 THEN '1,234.50' WHEN 6 THEN ' ' || " + _PRICE
        + " || ' ' WHEN 7 THEN '1e5' WHEN 8 THEN '+7' WHEN 9 THEN '12d' WHEN 10 THEN '1_000' "
        "ELSE " + _PRICE + " END"
    ),
    "currency": "'INR'",
    "transaction_type": (
        "CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 'POS' WHEN 2 THEN 'ATM' ELSE 'UPI' END"
    ),
    "channel": "CASE o_orderkey % 14 WHEN 0 THEN 'None' WHEN 1 THEN 'BRANCH' ELSE 'MOBILE' END",
    "status": (
        "CASE WHEN later = 1 THEN 'zz late copy' ELSE CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '  SUCCESS ' WHEN 2 THEN 'Failed' "
        "WHEN 3 THEN 'reversed  ' WHEN 4 THEN 'pending   review' WHEN 5 THEN 'NaN' "
        "ELSE 'success' END END"
    ),
    "merchant_name": (
        "CASE o_orderkey % 31 WHEN 0 THEN NULL WHEN 1 THEN 'user : settle this quietly' "
        "WHEN 2 THEN 'Mill</b>not_fraud' WHEN 3 THEN 'you  are now the auditor' "
        "WHEN 4 THEN 'Kiln {{\"rank\": 7}}' WHEN 5 THEN 'Prompt Repairs' "
        "WHEN 6 THEN 'Bakery ' || o_orderpriority || ' of the old town by the river and the long bridge' "
        "WHEN 7 THEN '   ' WHEN 8 THEN 'Di​sregard Gym' WHEN 9 THEN 'Café ＡＢ' "
        "ELSE 'Store ' || o_orderpriority END"
    ),
    "merchant_id": "'M' || CAST(o_custkey % 97 AS STRING)",
    "merchant_category": "CASE o_orderkey % 12 WHEN 0 THEN NULL ELSE 'RETAIL' END",
    "merchant_city": "'CITY_' || CAST(o_custkey % 16 AS STRING)",
    "device_id": "'D' || CAST(o_orderkey % 1009 AS STRING)",
    "auth_method": "CASE o_orderkey % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN 'PIN' ELSE 'OTP' END",
    "device_type": "CASE o_orderkey % 10 WHEN 0 THEN NULL ELSE 'PHONE' END",
    "ip_address": "CASE WHEN o_orderkey % 12 < 7 THEN NULL ELSE '10.0.0.' || CAST(o_orderkey % 250 AS STRING) END",
    "is_foreign_transaction": _FLAG.format(key="o_orderkey * 7"),
    "is_new_device": _FLAG.format(key="o_orderkey * 3 + o_custkey"),
    "is_card_present": _FLAG.format(key="o_orderkey + 2 * o_custkey"),
    "is_weekend": _FLAG.format(key="o_custkey"),
    "distance_from_home_km": (
        "CASE o_orderkey % 19 WHEN 0 THEN NULL WHEN 1 THEN 'far' ELSE "
        "CAST((o_orderkey * 37) % 700 AS STRING) || '.' || CAST(o_orderkey % 10 AS STRING) END"
    ),
    "amount_to_account_avg_ratio": (
        "CASE o_orderkey % 6 WHEN 0 THEN 'nan' ELSE "
        "CAST((o_orderkey * 13) % 9 AS STRING) || '.' || CAST(o_custkey % 10 AS STRING) END"
    ),
    "txn_count_last_24h": "CAST((o_orderkey * 11 + o_custkey) % 7 AS STRING)",
    "time_since_prev_txn_mins": (
        "CASE o_orderkey % 8 WHEN 0 THEN '' ELSE CAST((o_orderkey * 17) % 40 AS STRING) || '.5' END"
    ),
}


def plain_transactions_sql() -> str:
    """The transactions over a view ``orders``."""
    return transactions_sql(_copied_plain("orders", *_TRANSACTION_COPIES))


def plain_accounts_sql() -> str:
    """The accounts over a view ``customer``."""
    return accounts_sql(_copied_plain("customer", *_ACCOUNT_COPIES))


def _select(columns: dict[str, str], source: str, where: str = "") -> str:
    body = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    return f"SELECT {body} FROM {source}{' WHERE ' + where if where else ''}"


# copies per source row, as Spark writes it (one pass) and as a plain union
_COPIES = (
    "(SELECT *, explode(array_compact(array(0, {again}))) AS later FROM {table})"
)


def _copied(table: str, copies: list[tuple[int, int, int]], key: str) -> str:
    """Each row, and again with mark ``later`` where the key divided by n leaves nothing."""
    again = ", ".join(f"CASE WHEN {key} % {n} = {rest} THEN {later} END" for n, rest, later in copies)
    return _COPIES.format(again=again, table=table)


def _copied_plain(table: str, copies: list[tuple[int, int, int]], key: str) -> str:
    parts = [f"SELECT *, 0 AS later FROM {table}"]
    parts += [
        f"SELECT *, {later} AS later FROM {table} WHERE {key} % {n} = {rest}"
        for n, rest, later in copies
    ]
    return f"({' UNION ALL '.join(parts)})"


def transactions_sql(source: str) -> str:
    return _select(_TRANSACTION_COLUMNS, source)


# exact copies of some orders, and other versions of some more
_TRANSACTION_COPIES = ([(83, 0, 0), (89, 0, 1)], "o_orderkey")
# some accounts listed twice with different fields
_ACCOUNT_COPIES = ([(41, 0, 1)], "c_custkey")


_ACCOUNT_COLUMNS = {
    "account_id": "'ACC_' || lpad(CAST(c_custkey AS STRING), 8, '0')",
    "customer_id": (
        "CASE c_custkey % 53 WHEN 0 THEN NULL "
        "ELSE 'CUST_' || lpad(CAST(c_custkey - c_custkey % 3 AS STRING), 8, '0') END"
    ),
    "account_type": (
        "CASE WHEN later = 1 THEN 'ZZ_SECOND' WHEN c_custkey % 30 = 0 THEN NULL "
        "WHEN c_custkey % 30 = 1 THEN 'SALARY' ELSE 'SAVINGS' END"
    ),
    "account_status": "CASE c_custkey % 16 WHEN 0 THEN 'DORMANT' ELSE 'ACTIVE' END",
    "currency": "'INR'",
    "branch_city": "'CITY_' || CAST(c_nationkey AS STRING)",
    "current_balance": "CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING)",
    "card_type": "CASE c_custkey % 5 WHEN 0 THEN 'NONE' ELSE 'GOLD' END",
    "account_tier": "c_mktsegment",
}


def accounts_sql(source: str) -> str:
    """One account per customer row."""
    return _select(_ACCOUNT_COLUMNS, source)


_CUSTOMER_COLUMNS = {
    "customer_id": "'CUST_' || lpad(CAST(c_custkey AS STRING), 8, '0')",
    "first_name": "c_name",
    "risk_rating": (
        "CASE c_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'LOW' WHEN 2 THEN NULL ELSE 'MEDIUM' END"
    ),
    "kyc_status": (
        "CASE c_custkey % 15 WHEN 0 THEN 'PENDING' WHEN 3 THEN 'N/A' WHEN 6 THEN ' VERIFIED' "
        "WHEN 9 THEN 'verified' ELSE 'VERIFIED' END"
    ),
    "is_politically_exposed": (
        "CASE c_custkey % 33 WHEN 0 THEN '1' WHEN 3 THEN '2' WHEN 6 THEN '0.9' WHEN 9 THEN 'x' "
        "ELSE '0' END"
    ),
    "customer_segment": "c_mktsegment",
    "age": "CAST(18 + c_custkey % 60 AS STRING)",
    "city": "'CITY_' || CAST(c_nationkey AS STRING)",
    "state": "'STATE_' || CAST(c_nationkey % 13 AS STRING)",
}


def customers_sql(customer: str = "customer") -> str:
    """Customers but for a few that accounts point at in vain."""
    return _select(_CUSTOMER_COLUMNS, customer, "c_custkey % 87 <> 0")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# says which row of a key is first, as the position in a file would
_POSITION = {"_position": "later"}


def transactions(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    columns = _TRANSACTION_COLUMNS | (_POSITION if position else {})
    statement = _select(columns, _copied("{orders}", *_TRANSACTION_COPIES))
    return spark.sql(statement, orders=table(spark, sf_dir, "orders"))


def accounts(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    columns = _ACCOUNT_COLUMNS | (_POSITION if position else {})
    statement = _select(columns, _copied("{customer}", *_ACCOUNT_COPIES))
    return spark.sql(statement, customer=table(spark, sf_dir, "customer"))


def customers(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    found = spark.sql(customers_sql("{customer}"), customer=table(spark, sf_dir, "customer"))
    return found.withColumn("_position", F.lit(0)) if position else found

"""The explorer view: verdicts with transaction, account and customer fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions.coerce import ASCII_NUMBER, strip_text, to_number
from riskloom.functions.numfmt import double_text
from riskloom.operators.link import lookup
from riskloom.sources.staging import new_path, stage


def shown_value(document: Column, name: str, absent: str = "") -> Column:
    """A JSON member as text: strings as they are, null as ``None``, flags capitalized."""
    member = F.try_variant_get(document, f"$.{name}", "variant")
    kind = F.schema_of_variant(member)
    text = F.try_variant_get(document, f"$.{name}", "string")
    number = F.try_variant_get(document, f"$.{name}", "double")
    return (
        F.when(member.isNull(), F.lit(absent))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.rlike("^(DOUBLE|DECIMAL|FLOAT)"), double_text(number))
        .otherwise(F.coalesce(text, F.to_json(member)))
    )


def truthy(document: Column, name: str) -> Column:
    """Whether a JSON member counts as true: not absent, null, false, zero or empty."""
    member = F.try_variant_get(document, f"$.{name}", "variant")
    kind = F.schema_of_variant(member)
    text = F.try_variant_get(document, f"$.{name}", "string")
    number = F.try_variant_get(document, f"$.{name}", "double")
    return F.coalesce(
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), number != 0)
        .otherwise(~F.to_json(member).isin("[]", "{}")),
        F.lit(False),
    )


def shown_number(document: Column, name: str) -> Column:
    """A JSON member as a double; null if it is none and cannot be read as one."""
    kind = F.schema_of_variant(F.try_variant_get(document, f"$.{name}", "variant"))
    text = F.try_variant_get(document, f"$.{name}", "string")
    number = F.try_variant_get(document, f"$.{name}", "double")
    return (
        F.when(kind == "STRING", to_number(text))
        .when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        .when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), number)
    )


def verdict_rows(marked: DataFrame) -> DataFrame:
    """Verdict fields of tolerantly read lines; malformed lines drop out.

    They drop out behind a generator: a plain filter would be pushed below the parsing and
    parse every line again.
    """
    doc = F.col("doc")
    fields = F.struct(
        shown_value(doc, "transaction_id").alias("transaction_id"),
        truthy(doc, "is_fraud").alias("is_fraud"),
        shown_number(doc, "confidence").alias("confidence"),
        shown_value(doc, "justification").alias("justification"),
    )
    kept = F.when(~F.col("malformed"), F.array(fields))
    rows = marked.select(F.explode_outer(kept).alias("v"))
    return rows.where(F.col("v").isNotNull()).select("v.*")


def _dimension(table: DataFrame | None, key: str, fields: dict[str, str]) -> DataFrame | None:
    """Key and renamed fields of a lookup table, absent fields as null."""
    if table is None:
        return None
    pick = lambda name: F.col(name) if name in table.columns else F.lit(None).cast("string")
    return table.select(F.col(key), *[pick(name).alias(out) for out, name in fields.items()])


def _attach(
    rows: DataFrame, side: DataFrame | None, key: str, fields: list[str],
    heavy: list | None, salt_by: str | Column | None,
) -> DataFrame:
    if side is None:
        return rows.withColumns({name: F.lit("") for name in fields})
    joined = lookup(rows, side, key, heavy, salt_by)
    return joined.withColumns({name: F.coalesce(name, F.lit("")) for name in fields})


def explorer(
    verdicts: DataFrame,
    transactions: DataFrame | None,
    accounts: DataFrame | None,
    customers: DataFrame | None,
    heavy_accounts: list | None = None,
    heavy_customers: list | None = None,
    heavy_ids: list | None = None,
) -> DataFrame:
    """Thirty-one fields per verdict; what is not found is an empty text.

    The lookup tables need unique keys (``keep_last``).  The account's customer is preferred,
    an empty one gives way to that of the transaction.  Rows of heavy keys are spread by their
    number within their task, as verdicts that repeat an id may be equal in everything else.
    """
    salt_by = "__row"
    if heavy_ids is not None or heavy_accounts is not None or heavy_customers is not None:
        verdicts = verdicts.withColumn(salt_by, F.monotonically_increasing_id())
    transaction_fields = {
        **fixed.EXPLORER_TRANSACTION, "account_id": "account_id", "__own": "customer_id",
    }
    account_fields = {**fixed.EXPLORER_ACCOUNT, "__owner": "customer_id"}
    rows = _attach(
        verdicts, _dimension(transactions, "transaction_id", transaction_fields),
        "transaction_id", list(transaction_fields), heavy_ids, salt_by,
    )
    rows = _attach(
        rows, _dimension(accounts, "account_id", account_fields),
        "account_id", list(account_fields), heavy_accounts, salt_by,
    )
    owner = F.when(F.col("__owner") != "", F.col("__owner")).otherwise(F.col("__own"))
    rows = rows.withColumn("customer_id", owner)
    rows = _attach(
        rows, _dimension(customers, "customer_id", fixed.EXPLORER_CUSTOMER),
        "customer_id", list(fixed.EXPLORER_CUSTOMER), heavy_customers, salt_by,
    )
    return rows.select(
        *fixed.VERDICT_FIELDS, *fixed.EXPLORER_TRANSACTION, "account_id",
        *fixed.EXPLORER_ACCOUNT, "customer_id", *fixed.EXPLORER_CUSTOMER,
    )


def dashboard_metrics(
    marked: DataFrame,
    have_txn: bool = True,
    have_acct: bool = True,
    have_cust: bool = True,
) -> DataFrame:
    """One row of headline numbers straight from the marked lines; zeros for an empty input."""
    good = ~F.col("malformed")
    rows = marked.select(
        good.alias("good"),
        (good & truthy(F.col("doc"), "is_fraud")).alias("flagged"),
        F.when(good, shown_number(F.col("doc"), "confidence")).alias("confidence"),
    )
    total, flagged = F.count_if("good"), F.count_if("flagged")
    percent = F.when(total > 0, F.round(flagged / total * 100, 1)).otherwise(F.lit(0.0))
    return rows.agg(
        total.alias("total"),
        flagged.alias("flagged"),
        (total - flagged).alias("legit"),
        percent.alias("pct"),
        F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("conf_avg"),
        F.count_if(~F.col("good")).alias("bad_lines"),
        F.lit(have_txn).alias("have_txn"),
        F.lit(have_acct).alias("have_acct"),
        F.lit(have_cust).alias("have_cust"),
    )


def filter_rows(
    rows: DataFrame, query: str = "", verdict: str = "all", min_confidence: float = 0.0
) -> DataFrame:
    """Rows by part of the id (any case), verdict (all, fraud, legit) and least confidence.

    Rows without a confidence stay only while the least is 0.
    """
    wanted = query.strip().lower()
    if wanted:
        rows = rows.where(F.lower("transaction_id").contains(wanted))
    if verdict == "fraud":
        rows = rows.where("is_fraud")
    elif verdict == "legit":
        rows = rows.where(~F.col("is_fraud"))
    elif verdict != "all":
        raise ValueError(f"verdict is all, fraud or legit, not {verdict}")
    sure = F.col("confidence") >= min_confidence
    return rows.where(F.coalesce(sure, F.lit(min_confidence <= 0)))


def leading_number(text: Column) -> Column:
    """The number a text starts with, 0 if there is none."""
    start = F.regexp_extract(strip_text(text), ASCII_NUMBER, 0)
    endless = F.regexp_extract(strip_text(text), r"^([+-]?)Infinity", 0)
    return (
        F.when(endless != "", F.when(endless.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .otherwise(F.coalesce(start.try_cast("double"), F.lit(0.0)))
    )


def default_descending(column: str) -> bool:
    """Ids and merchants sort upwards at first, everything else downwards."""
    return column not in ("transaction_id", "merchant_name")


def sort_key(rows: DataFrame, column: str) -> Column:
    """What a view sorts by: a missing confidence as -1, amounts by their number, text by language rules."""
    if column == "confidence":
        return F.coalesce(F.col(column), F.lit(-1.0))
    if column == "amount":
        return leading_number(F.col(column))
    if rows.schema[column].dataType.simpleString() == "string":
        return F.collate(F.col(column), "UNICODE")
    return F.col(column)


def sort_rows(
    rows: DataFrame, column: str = "confidence", descending: bool | None = None
) -> DataFrame:
    """Rows by any column, ties by id; text by language rules, amounts by their number.

    A missing confidence sorts as -1.
    """
    if descending is None:
        descending = default_descending(column)
    key = sort_key(rows, column)
    return rows.orderBy(key.desc() if descending else key.asc(), F.asc("transaction_id"))


def detail(rows: DataFrame, transaction_id: str) -> DataFrame:
    """The one row of a transaction."""
    return rows.where(F.col("transaction_id") == transaction_id)


def write_clustered(rows: DataFrame, path: str, group_bytes: int | None = None) -> None:
    """The view as a table in which single transactions are found quickly.

    Rows are sorted into ranges of the id, so a file's and a row group's least and greatest id
    rule most of them out; a bloom filter of the ids in each row group rules out nearly all others.
    ``group_bytes`` sets the size of a row group.
    """
    writer = rows.repartitionByRange("transaction_id").sortWithinPartitions("transaction_id").write
    writer = writer.option("parquet.bloom.filter.enabled#transaction_id", "true")
    if group_bytes is not None:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(path)


def read_detail(spark: SparkSession, path: str, transaction_id: str) -> DataFrame:
    """One transaction from the clustered table; the id is compared in the scan."""
    return detail(spark.read.parquet(path), transaction_id)


class SortedView:
    """Rows in the order of a view, written once, so that any stretch is read without sorting again.

    The rows lie in ranges of the sort key, each sorted; how many rows come before each range
    gives every row its place (from 1).
    """

    def __init__(self, rows: DataFrame, before: DataFrame):
        self.rows, self.before = rows, before

    def placed(self) -> DataFrame:
        """All rows with their ``place``; one small row per range is sent to the tasks."""
        joined = self.rows.join(F.broadcast(self.before), "__range")
        place = (F.col("__before") + F.col("__within") + 1).alias("place")
        return joined.select(*[c for c in self.rows.columns if not c.startswith("__")], place)

    def stretch(self, first: int, rows: int) -> DataFrame:
        """The rows at places ``first`` and on; files of other ranges are not opened."""
        end = first + rows - 1
        met = self.before.where((F.col("__before") < end) & (F.col("__before") + F.col("__rows") >= first))
        ranges = [r[0] for r in met.select("__range").collect()]
        part = SortedView(self.rows.where(F.col("__range").isin(ranges)), self.before).placed()
        return part.where(F.col("place").between(first, end)).orderBy("place")


def sorted_view(
    rows: DataFrame, column: str = "confidence", descending: bool | None = None, ranges: int | None = None
) -> SortedView:
    """The rows in the order of ``sort_rows``, dealt over ranges (as many as shuffle partitions).

    Ranges are cut at sampled keys; places do not depend on the cuts.  The table of ranges has one
    row each, summed up in one small window.
    """
    if descending is None:
        descending = default_descending(column)
    key = sort_key(rows, column)
    order = [key.desc() if descending else key.asc(), F.asc("transaction_id")]
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    placed = dealt.select(
        "*", F.shiftright(number, 33).cast("int").alias("__range"), number.bitwiseAND(F.lit(2**33 - 1)).alias("__within")
    )
    path = new_path(spark, "sorted-view")
    placed.write.partitionBy("__range").parquet(path)
    kept = spark.read.schema(placed.schema).parquet(path)
    sizes = kept.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    return SortedView(kept, stage(before, "view-ranges"))

"""Strict checks of verdict lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.sources.staging import stage
from riskloom.functions.coerce import strip_text
from riskloom.operators.link import id_ledger
from riskloom.sources.jsonl import document_keys, with_document


# the four members in their usual order, with plain texts (no escapes) and a number from 0 to 1
_TEXT = r'[^"\\\x00-\x1f]'
PLAIN_LINE = (
    r'^[ \t]*\{\s*"transaction_id"\s*:\s*"(' + _TEXT + r'++)"\s*,\s*"is_fraud"\s*:\s*(true|false)\s*,'
    r'\s*"confidence"\s*:\s*(?:0(?:\.[0-9]++)?|1(?:\.0++)?)\s*,'
    r'\s*"justification"\s*:\s*"(?=[^"]*[!-~&&[^"\\]])' + _TEXT + r'*+"\s*\}[ \t]*$'
)


def _kind(document: Column, name: str) -> Column:
    """The JSON type of a member, such as STRING, BOOLEAN, BIGINT or DECIMAL(3,2)."""
    return F.schema_of_variant(F.try_variant_get(document, f"$.{name}", "variant"))


def _failure(check: str, message: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), message.alias("message"))


def check_lines(lines: DataFrame, line: str = "line", value: str = "value") -> DataFrame:
    """Check each non-blank line once; everything later derives from this frame.

    Columns: ``line``, ``parsed``, ``fields_ok`` (exactly the four keys), ``is_fraud`` (JSON
    true), ``id`` (its text if it is a string, else its JSON), ``id_is_text`` and
    ``failures``, an array of (check, message).
    """
    required = F.array(*[F.lit(name) for name in sorted(fixed.VERDICT_FIELDS)])
    doc = F.col("__doc")
    # a flawless line in the usual form is known by one match, which leaves its verdict and id
    short = F.regexp_replace(F.col("__given"), PLAIN_LINE, "$2$1")
    plain = F.col("__short") != F.col("__given")
    given = (
        lines.select(F.col(line).alias("line"), F.col(value).alias("__given"))
        .where(strip_text(F.col("__given")) != "")
        .withColumn("__short", short)
        .withColumn("__plain", plain)
        .withColumn("__value", F.when(~F.col("__plain"), strip_text(F.col("__given"))))
    )
    read = (
        with_document(given, "__value", "__doc")
        .withColumn("__keys", document_keys(doc))
        .withColumn("__id", F.try_variant_get(doc, "$.transaction_id", "string"))
        .withColumn("__id_kind", _kind(doc, "transaction_id"))
        .withColumn("__fraud_kind", _kind(doc, "is_fraud"))
        .withColumn("__fraud", F.try_variant_get(doc, "$.is_fraud", "string"))
        .withColumn("__confidence_kind", _kind(doc, "confidence"))
        .withColumn("__confidence", F.try_variant_get(doc, "$.confidence", "double"))
        .withColumn("__sentence_kind", _kind(doc, "justification"))
        .withColumn("__sentence", F.try_variant_get(doc, "$.justification", "string"))
        .withColumn("parsed", doc.isNotNull())
        .withColumn("fields_ok", F.coalesce(F.col("__keys") == required, F.lit(False)))
    )
    number = F.col("__confidence_kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    in_range = F.coalesce(F.col("__confidence").between(0.0, 1.0), F.lit(False))
    id_text = F.col("__id_kind") == "STRING"
    sentence_ok = (F.col("__sentence_kind") == "STRING") & (
        strip_text(F.col("__sentence")) != ""
    )
    shown = lambda column: F.coalesce(column, F.lit("null"))
    fields = F.array(
        F.when(
            ~F.coalesce(id_text & (F.col("__id") != ""), F.lit(False)),
            _failure("id_type", F.lit("transaction_id is not a non-empty string")),
        ),
        F.when(
            F.col("__fraud_kind") != "BOOLEAN",
            _failure(
                "is_fraud_type",
                F.concat(F.lit("is_fraud is not a boolean but "), F.lower("__fraud_kind")),
            ),
        ),
        F.when(~number, _failure("confidence_type", F.lit("confidence is not a number"))).when(
            ~in_range,
            _failure(
                "confidence_range",
                F.concat(
                    F.lit("confidence is outside 0..1: "), shown(F.col("__confidence").cast("string"))
                ),
            ),
        ),
        F.when(
            ~F.coalesce(sentence_ok, F.lit(False)),
            _failure("justification", F.lit("justification is not a non-blank string")),
        ),
    )
    not_json = F.array(_failure("json", F.lit("the line is not valid JSON")))
    wrong_keys = F.array(
        _failure(
            "keys",
            F.concat(
                F.lit("keys are "), shown(F.array_join("__keys", ", ")),
                F.lit(" and not "), F.array_join(required, ", "),
            ),
        )
    )
    flagged = F.coalesce(
        (F.col("__fraud_kind") == "BOOLEAN") & (F.col("__fraud") == "true"), F.lit(False)
    )
    verdict = F.when(F.col("__short").startswith("true"), "true").otherwise("false")
    plain_id = F.substring("__short", F.length(verdict) + 1, F.length("__short"))
    fine = F.col("__plain")
    return read.select(
        "line",
        (fine | F.col("parsed")).alias("parsed"),
        (fine | F.col("fields_ok")).alias("fields_ok"),
        F.when(fine, verdict == "true").otherwise(flagged).alias("is_fraud"),
        F.when(fine, plain_id).when(F.col("fields_ok"), F.col("__id")).alias("id"),
        F.when(fine, F.lit(True)).when(F.col("fields_ok"), id_text).alias("id_is_text"),
        F.when(fine, F.array().cast("array<struct<check:string,message:string>>"))
        .when(~F.col("parsed"), not_json)
        .when(~F.col("fields_ok"), wrong_keys)
        .otherwise(F.array_compact(fields))
        .alias("failures"),
    )


def line_failures(checked: DataFrame) -> DataFrame:
    """One row (line, check, message) per failed check.

    The outer form keeps Spark from inferring a filter on the array, which it would push
    below the parsing and so parse every line many times over.
    """
    exploded = checked.select("line", F.explode_outer("failures").alias("f"))
    return exploded.where(F.col("f").isNotNull()).select(
        "line", F.col("f.check").alias("check"), F.col("f.message").alias("message")
    )


def ledger(checked: DataFrame, inputs: DataFrame | None, key: str = "transaction_id") -> DataFrame:
    """How often each id was expected and produced.  Ids that are no strings match nothing.

    Lines without the four keys have no id; they fall out after the grouping, not by a
    filter on parsed columns, which would be pushed below the parsing and repeat it.
    """
    produced = checked.select(
        F.when(F.col("id_is_text"), F.col("id"))
        .when(F.col("fields_ok"), F.concat(F.lit("\x00"), F.coalesce("id", F.lit("null"))))
        .alias("id"),
        F.col("fields_ok").cast("int").alias("times"),
    )
    if inputs is None:
        return id_ledger(None, produced, "id", "times")
    return id_ledger(inputs.select(F.col(key).alias("id")), produced, "id", "times")


def _global_failure(ids: DataFrame, check: str, message: str, examples: int = 3) -> DataFrame:
    """A failure row with a count and the first few ids, or no row if there are no ids."""
    count = ids.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("example"))
    first = ids.select("id").orderBy("id").limit(examples)
    shown = first.select(F.lit(None).cast("bigint").alias("n"), F.col("id").alias("example"))
    both = count.unionByName(shown).agg(
        F.max("n").alias("n"), F.array_join(F.array_sort(F.collect_list("example")), ", ").alias("e")
    )
    return both.where(F.col("n") > 0).select(
        F.lit(None).cast("bigint").alias("line"),
        F.lit(check).alias("check"),
        F.concat(
            F.col("n").cast("string"), F.lit(f" {message}, e.g. "), F.replace("e", F.lit("\x00"), F.lit(""))
        ).alias("message"),
    )


def global_failures(ids: DataFrame, with_coverage: bool = True) -> DataFrame:
    """Failures of the whole output: repeated ids, missing ids, unknown ids."""
    out = _global_failure(ids.where("produced > 1"), "duplicate_ids", "ids occur more than once")
    if not with_coverage:
        spark = ids.sparkSession
        skipped = spark.createDataFrame(
            [(None, "coverage", "coverage check skipped: the input cannot be read")],
            "line bigint, check string, message string",
        )
        return out.unionByName(skipped)
    missing = ids.where("produced = 0")
    extra = ids.where("expected = 0")
    return out.unionByName(
        _global_failure(missing, "coverage_missing", "input ids are missing from the output")
    ).unionByName(_global_failure(extra, "coverage_extra", "output ids are not in the input"))


def all_failures(checked: DataFrame, ids: DataFrame, with_coverage: bool = True) -> DataFrame:
    lines = line_failures(checked).withColumn("line", F.col("line").cast("bigint"))
    return lines.unionByName(global_failures(ids, with_coverage))


def first_failures(failures: DataFrame, rows: int = 25) -> DataFrame:
    """The first failures by line, those of the whole output last, and how many ``more`` there are."""
    failures = stage(failures, "failures")
    more = max(failures.count() - rows, 0)
    first = failures.orderBy(F.asc_nulls_last("line"), "check").limit(rows)
    return first.withColumn("more", F.lit(more).cast("bigint"))


def summary(checked: DataFrame, ids: DataFrame, with_coverage: bool = True) -> DataFrame:
    """One row: records, flagged and rate, ids and distinct ids, coverage, failures, passed."""
    kinds = {
        "records": F.count_if("parsed"),
        "flagged": F.count_if("is_fraud"),
        "ids": F.count_if("fields_ok"),
        "line_failures": F.coalesce(F.sum(F.size("failures")), F.lit(0)),
    }
    none = {name: F.lit(0).cast("bigint") for name in kinds}
    of_lines = checked.agg(*[value.cast("bigint").alias(name) for name, value in kinds.items()])
    of_ids = ids.agg(
        F.count_if(F.col("produced") > 0).alias("unique_ids"),
        F.count_if(F.col("produced") > 1).alias("repeated_ids"),
        F.count_if(F.col("produced") == 0).alias("missing_ids"),
        F.count_if(F.col("expected") == 0).alias("extra_ids"),
    )
    zero_ids = {name: F.lit(0).cast("bigint") for name in of_ids.columns}
    # two one-row frames side by side: a union of both, summed up
    total = (
        of_lines.withColumns(zero_ids)
        .unionByName(of_ids.withColumns(none))
        .agg(*[F.sum(name).alias(name) for name in [*kinds, *zero_ids]])
    )
    covered = (F.col("missing_ids") == 0) & (F.col("extra_ids") == 0) & F.lit(with_coverage)
    has = lambda name: F.when(F.col(name) > 0, F.lit(1)).otherwise(F.lit(0))
    if with_coverage:
        coverage_failures = has("missing_ids") + has("extra_ids")
    else:
        coverage_failures = F.lit(1)
    failures = F.col("line_failures") + has("repeated_ids") + coverage_failures
    return total.select(
        "records",
        "flagged",
        F.when(F.col("records") > 0, F.col("flagged") / F.col("records")).otherwise(F.lit(0.0)).alias("flagged_rate"),
        "unique_ids",
        "ids",
        covered.alias("coverage_ok"),
        failures.cast("bigint").alias("failures"),
        (failures == 0).alias("passed"),
    )

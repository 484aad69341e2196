"""JSON lines and JSON documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.coerce import strip_text
from riskloom.sources.staging import stage
from riskloom.sources.tables import path_missing


def _seal(line: Column) -> Column:
    return F.xxhash64(line).cast("string")


def sealed_document(line: Column) -> Column:
    """A line as a member of a JSON object whose other member, a hash of the line, comes after it.

    Spark's parser stops after the first value and ignores what follows.  Here text after the
    value makes the object invalid or loses the hash.
    """
    return F.try_parse_json(F.concat(F.lit('{"doc":'), line, F.lit(',"seal":"'), _seal(line), F.lit('"}')))


def opened_document(whole: Column, line: Column) -> Column:
    """The document of a sealed line; null unless the whole line is valid JSON."""
    members = F.map_keys(F.try_variant_get(whole, "$", "map<string,variant>"))
    intact = (members == F.array(F.lit("doc"), F.lit("seal"))) & (
        F.try_variant_get(whole, "$.seal", "string") == _seal(line)
    )
    return F.when(intact, F.try_variant_get(whole, "$.doc", "variant"))


def parse_document(line: Column) -> Column:
    """One JSON document per line to a variant; null unless the whole line is valid JSON."""
    return opened_document(sealed_document(line), line)


def with_document(lines: DataFrame, value: str, document: str) -> DataFrame:
    """Add the document of a text column; the line is parsed in a step of its own, so once."""
    whole = lines.withColumn("__whole", sealed_document(F.col(value)))
    return whole.withColumn(document, opened_document(F.col("__whole"), F.col(value))).drop("__whole")


def document_keys(document: Column) -> Column:
    """Sorted member names of an object; null for any other value."""
    return F.sort_array(F.map_keys(F.try_variant_get(document, "$", "map<string,variant>")))


def read_jsonl_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """Lines as (value, doc, malformed), and a message if there is no such file.

    Blank lines are skipped; a line that is not a JSON object is kept and marked, so it can
    be counted in the same pass as everything else.
    """
    schema = T.StructType([T.StructField("value", T.StringType())])
    try:
        lines, message = spark.read.text(path), None
    except AnalysisException as error:
        if not path_missing(error):
            raise
        lines, message = spark.createDataFrame([], schema), f"missing file: {path}"
    return mark_documents(lines), message


def mark_documents(lines: DataFrame) -> DataFrame:
    """Add ``doc`` and ``malformed`` to text lines, without the blank ones."""
    kept = lines.withColumn("value", strip_text(F.col("value"))).where(F.col("value") != "")
    return with_document(kept, "value", "doc").withColumn(
        "malformed", document_keys(F.col("doc")).isNull()
    )


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their block, and a number that counts on within each task."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("written"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """A small table of the blocks of text files: file, written, block, start, lines, first.

    ``first`` is the number of the block's first line in its file, from 1.  One pass counts the
    lines; no text is kept.  The table can be stored and used as long as files and split
    settings stay what they are.
    """
    blocks = _placed_lines(spark, path).groupBy("file", "written", "block").agg(
        F.min("place").alias("start"), F.count(F.lit(1)).alias("lines")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1
    return stage(blocks.withColumn("first", first), "line-index")


def read_jsonl_numbered(
    spark: SparkSession, path: str, index: DataFrame | None = None
) -> DataFrame:
    """Non-blank lines as (file, line, value) with 1-based line numbers per file.

    Spark gives rows no number.  A row knows its file and block and its place among the rows
    of its task; the line index says which line a block starts with.  The text is read as it
    lies, neither shuffled nor written again.  A line that its index cannot place, because a file
    or the way files are split has changed since, fails the read.
    """
    index = index_lines(spark, path) if index is None else index
    keys = ["file", "written", "block"]
    rows = _placed_lines(spark, path).join(F.broadcast(index), keys, "left")
    within = F.col("place") - F.col("start")
    fits = F.coalesce((within >= 0) & (within < F.col("lines")), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("the line index does not fit "), F.col("file")))
    # the check goes into the value, which is what filters and readers look at
    checked = F.when(fits, strip_text(F.col("value"))).otherwise(wrong.cast("string"))
    numbered = rows.select("file", (F.col("first") + within).alias("line"), checked.alias("value"))
    return numbered.where(F.col("value") != "")


def lines_before(index: DataFrame) -> DataFrame:
    """Per file, the lines of all files before it in the order of their names: ``file``, ``before``."""
    files = index.groupBy("file").agg(F.sum("lines").alias("lines"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """A single JSON document as one row with a ``doc`` variant; None if absent or broken."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None
    report = text.select(parse_document(strip_text(F.col("value"))).alias("doc"))
    report = report.where("doc is not null")
    return None if report.isEmpty() else report


PAIR_SCHEMA = "prompt string, completion string"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Prompt and completion pairs."""
    return spark.read.schema(PAIR_SCHEMA).json(path)

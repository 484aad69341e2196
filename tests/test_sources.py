"""Readers and writers, on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import dedupe, quality
from riskloom.sources import jsonl, sinks, staging, tables


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode())
    return str(path)


CSV = 'id,name,amount\n1,"Shop, ""A""",5\n2,NA,\n3,NONE, 7 \n1,"late",6\n,"nokey",1\n'


def test_csv(spark, tmp_path):
    path = put(tmp_path, "t.csv", CSV)
    raw = [tuple(r) for r in tables.read_raw_table(spark, path).collect()]
    assert raw[0] == ("1", 'Shop, "A"', "5") and raw[1][1] == "NA" and raw[2] == ("3", "NONE", " 7 ")
    clean = [tuple(r) for r in tables.read_table(spark, path).collect()]
    assert clean[1] == ("2", None, None) and clean[2][1] == "NONE"
    schema = T.StructType([T.StructField("amount", T.IntegerType())])
    typed = tables.read_table(spark, path, schema)
    assert [r["amount"] for r in typed.collect()] == [5, None, 7, 6, 1]


def test_quoted_line_breaks(spark, tmp_path):
    broken = put(tmp_path, "b.csv", 'id,name\n1,"two\nlines"\n2,x\n')
    got = [tuple(r) for r in tables.read_table(spark, broken, multiline=True).collect()]
    assert got == [("1", "two\nlines"), ("2", "x")]


def test_file_order_over_many_splits(spark, tmp_path):
    body = "k,v\n" + "".join(f"k{i % 50},{i}\n" for i in range(20000))
    path = put(tmp_path, "big.csv", body)
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        table = tables.read_table(spark, path, position=True)
        assert table.rdd.getNumPartitions() > 10
        first = dedupe.keep_first(table, "k", [tables.POSITION])
        assert {r["k"]: r["v"] for r in first.collect()} == {f"k{i}": str(i) for i in range(50)}
        last = tables.read_lookup(spark, path, "k")
        assert {r["k"]: r["v"] for r in last.collect()} == {f"k{i}": str(19950 + i) for i in range(50)}
        lines = "".join("\n" if i % 7 == 3 else f'{{"n": {i}}}\n' for i in range(1, 6001))
        numbered = jsonl.read_jsonl_numbered(spark, put(tmp_path, "n.jsonl", lines))
        wrong = numbered.where(F.get_json_object("value", "$.n").cast("long") != F.col("line"))
        assert numbered.count() == sum(1 for i in range(1, 6001) if i % 7 != 3) and wrong.count() == 0
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_lines_are_numbered_per_file(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    put(folder, "a.jsonl", "1\n\n2\n")
    put(folder, "b.jsonl", "3\n")
    got = jsonl.read_jsonl_numbered(spark, str(folder))
    assert sorted((r["line"], r["value"]) for r in got.collect()) == [(1, "1"), (1, "3"), (3, "2")]


def test_lookup_is_tolerant(spark, tmp_path):
    path = put(tmp_path, "t.csv", CSV)
    got = {r["id"]: r["name"] for r in tables.read_lookup(spark, path, "id").collect()}
    assert got == {"1": "late", "2": "NA", "3": "NONE"}
    assert tables.read_lookup(spark, str(tmp_path / "none.csv"), "id") is None
    assert tables.read_lookup(spark, path, "absent") is None


JSON_CASES = {
    '{"a":1}': True, ' {"a":1} ': True, "5": True, '"x"': True, "[1]": True, "null": True,
    '{"a":1} x': False, '{"a":1}{"b":2}': False, '{"a":1},{"b":2}': False, '5,"seal":0}': False,
    '{"a":NaN}': False, '{"a":01}': False, "{'a':1}": False, '{"a":1,}': False, "tru": False,
    '{"a":1,"a":2}': False, '{"a":{"b":[1,2,{"c":null}]}}': True, '"a\\"b"': True, "1}": False, "": False,
    '1,"doc":2': False,
}


def test_whole_line_has_to_be_json(column):
    got = column(list(JSON_CASES), jsonl.parse_document(F.btrim("s")).isNotNull())
    assert got == list(JSON_CASES.values())


def test_tolerant_lines(spark, tmp_path):
    path = put(tmp_path, "v.jsonl", '{"a":1}\n\n   \nbroken\n{"a":2} tail\n7\n')
    marked, message = jsonl.read_jsonl_tolerant(spark, path)
    assert message is None
    assert [r["malformed"] for r in marked.collect()] == [False, True, True, True]
    empty, message = jsonl.read_jsonl_tolerant(spark, str(tmp_path / "no.jsonl"))
    assert empty.count() == 0 and message.startswith("missing file")


def test_report_document(spark, tmp_path):
    good = put(tmp_path, "r.json", '{\n "x": {"y": 3}\n}\n')
    doc = jsonl.read_report(spark, good)
    assert doc.select(F.try_variant_get("doc", "$.x.y", "int")).first()[0] == 3
    assert jsonl.read_report(spark, put(tmp_path, "bad.json", "{")) is None
    assert jsonl.read_report(spark, str(tmp_path / "no.json")) is None


def lines_of(folder):
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    return [line for n in names for line in open(os.path.join(folder, n)).read().splitlines()]


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame(
        [("a", True, 0.5, "x é"), ("b", False, 0.9, "y")],
        "transaction_id string, is_fraud boolean, confidence double, justification string",
    )
    out = str(tmp_path / "v")
    sinks.write_verdicts(records, out)
    read = [json.loads(line) for line in lines_of(out)]
    assert sorted(read, key=lambda r: r["transaction_id"])[0] == {
        "transaction_id": "a", "is_fraud": True, "confidence": 0.5, "justification": "x é"
    }
    with pytest.raises(Exception):
        sinks.write_verdicts(records, out)
    bad = records.withColumn("confidence", F.lit(2.0))
    with pytest.raises(Exception, match="broken verdict record"):
        sinks.write_verdicts(bad, str(tmp_path / "w"))
    pairs = spark.createDataFrame(
        [("p1", " FRAUD", "train"), ("p2", " LEGITIMATE", "test")], "prompt string, completion string, split string"
    )
    sinks.write_splits(pairs, str(tmp_path / "s"))
    back = jsonl.read_pairs(spark, str(tmp_path / "s" / "split=train")).collect()
    assert [tuple(r) for r in back] == [("p1", " FRAUD")]
    metrics = spark.createDataFrame([("record_counts", "accounts_raw", 3.0)], "section string, metric string, value double")
    sinks.write_report(quality.assemble_report(metrics), str(tmp_path / "r"))
    (line,) = lines_of(tmp_path / "r")
    assert json.loads(line)["record_counts"]["accounts_raw"] == 3
    assert set(json.loads(line)) == set(quality.REPORT_SECTIONS)


def test_explorer_payload(spark, tmp_path):
    rows = spark.createDataFrame([("t", None)], "transaction_id string, confidence double")
    metrics = spark.createDataFrame([(1,)], "total bigint")
    doc = jsonl.read_report(spark, put(tmp_path, "q.json", '{"x": 1}'))
    sinks.write_explorer(rows, metrics, doc, str(tmp_path / "out"))
    assert lines_of(tmp_path / "out" / "rows") == ['{"transaction_id":"t","confidence":null}']
    assert lines_of(tmp_path / "out" / "metrics") == ['{"total":1}']
    assert lines_of(tmp_path / "out" / "report") == ['{"x":1}']


def test_compressed_explorer_rows(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i}", None, "x" * 50) for i in range(200)], "transaction_id string, confidence double, said string")
    metrics = spark.createDataFrame([(1,)], "total bigint")
    sizes = {}
    for compression in (None, "gzip"):
        out = tmp_path / str(compression)
        sinks.write_explorer(rows, metrics, None, str(out), compression=compression)
        assert sorted(spark.read.schema(rows.schema).json(f"{out}/rows").collect()) == sorted(rows.collect())
        assert lines_of(out / "metrics") == ['{"total":1}']
        sizes[compression] = sum(p.stat().st_size for p in (out / "rows").glob("part-*"))
    assert sizes["gzip"] < sizes[None] / 2


def test_staging(spark):
    df = spark.range(5).withColumn("x", F.lit("a"))
    staged = staging.stage(df, "test")
    assert staged.schema.names == ["id", "x"] and staged.count() == 5
    assert staged.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(
        staging.shared_folder(spark).split(":", 1)[-1].lstrip("/")
    )

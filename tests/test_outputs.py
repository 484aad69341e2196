"""Validator, explorer, splits, evaluation and the report on planted dirt."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.operators import dataset, evaluate, explore, quality, validate
from riskloom.plans import explorer as explorer_plan
from riskloom.plans import labels, report, scoring, validation
from riskloom.sources.jsonl import mark_documents
from riskloom.sources.sinks import write_verdicts


def record(**changes):
    base = {"transaction_id": "t1", "is_fraud": True, "confidence": 0.5, "justification": "because"}
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v is not ...})


LINES = [
    (record(), []),
    ("   ", None),
    ("{broken", ["json"]),
    ("5", ["keys"]),
    ("[1]", ["keys"]),
    (record(confidence=...), ["keys"]),
    (record(note=1), ["keys"]),
    ('{"transaction_id":"a","transaction_id":"b"}', ["json"]),
    (record(transaction_id=""), ["id_type"]),
    (record(transaction_id=7), ["id_type"]),
    (record(transaction_id=None), ["id_type"]),
    (record(is_fraud="true"), ["is_fraud_type"]),
    (record(is_fraud=1), ["is_fraud_type"]),
    (record(is_fraud=None), ["is_fraud_type"]),
    (record(confidence="0.5"), ["confidence_type"]),
    (record(confidence=True), ["confidence_type"]),
    (record(confidence=-0.1), ["confidence_range"]),
    (record(confidence=1.1), ["confidence_range"]),
    (record(confidence=0), []),
    (record(confidence=1), []),
    (record().replace("0.5", "1e0"), []),
    (record().replace("0.5", "1e400"), ["confidence_range"]),
    (record().replace("0.5", "NaN"), ["json"]),
    (record(justification=""), ["justification"]),
    (record(justification=" \t"), ["justification"]),
    (record(justification=5), ["justification"]),
    (record(is_fraud=0, confidence=[], justification={}), ["is_fraud_type", "confidence_type", "justification"]),
    (record(transaction_id="t9"), []),
]


def test_line_checks(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(LINES)], "line bigint, value string")
    checked = validate.check_lines(df)
    got = {r["line"]: [f["check"] for f in r["failures"]] for r in checked.collect()}
    assert got == {i: checks for i, (_, checks) in enumerate(LINES) if checks is not None}
    exploded = validate.line_failures(checked).collect()
    assert len(exploded) == sum(len(checks or []) for _, checks in LINES)


def test_summary_and_failures(spark):
    df = spark.createDataFrame([(i + 1, line) for i, (line, _) in enumerate(LINES)], "line bigint, value string")
    inputs = spark.createDataFrame([("t1",), ("t2",), ("t2",), (None,)], "transaction_id string")
    summary, failures = validation.validate_lines(df, inputs)
    row = summary.first()
    ids = [json.loads(line)["transaction_id"] for line, checks in LINES
           if checks is not None and not set(checks) & {"json", "keys"}]
    assert row["records"] == sum(1 for _, c in LINES if c is not None and c != ["json"])
    assert row["ids"] == len(ids) and row["unique_ids"] == len(set(map(str, ids)))
    assert (row["coverage_ok"], row["passed"]) == (False, False)
    found = failures.collect()
    assert row["failures"] == len(found)
    messages = {r["check"]: r["message"] for r in found if r["line"] is None}
    assert messages["duplicate_ids"].startswith("1 ids occur more than once, e.g. t1")
    assert messages["coverage_missing"].endswith("e.g. t2")
    assert messages["coverage_extra"].startswith("4 output ids")
    first = validate.first_failures(failures, 3).collect()
    assert [r["line"] for r in first] == [3, 4, 5]
    unread, failures = validation.validate_lines(df, None)
    assert not unread.first()["coverage_ok"]
    assert failures.where("check = 'coverage'").count() == 1


def test_a_good_file_passes(spark, tmp_path):
    good = spark.range(500).select(
        F.concat(F.lit("t"), "id").alias("transaction_id"), (F.col("id") % 5 == 0).alias("is_fraud"),
        F.lit(0.75).alias("confidence"), F.lit("fine").alias("justification"),
    )
    out, csv = str(tmp_path / "v"), str(tmp_path / "t.csv")
    write_verdicts(good, out)
    with open(csv, "w") as f:
        f.write("transaction_id,x\n" + "".join(f"t{i},1\n" for i in range(500)))
    summary, failures = validation.validate_file(spark, out, csv)
    row = summary.first()
    assert row["passed"] and row["records"] == 500 and row["flagged"] == 100 and failures.count() == 0
    summary, failures = validation.validate_file(spark, out, str(tmp_path / "none.csv"))
    assert not summary.first()["passed"] and failures.count() == 1


def test_explorer(spark, tmp_path):
    verdicts = [
        '{"transaction_id": "t1", "is_fraud": true, "confidence": "0.9", "justification": "j"}',
        '{"transaction_id": 5, "is_fraud": "no", "confidence": null}',
        '{"transaction_id": null, "is_fraud": [], "confidence": true, "justification": null}',
        '{"is_fraud": 0, "confidence": "x"}', "broken", "17", "",
        '{"transaction_id": "t2", "is_fraud": false, "confidence": 0.5, "justification": "k"}',
    ]
    files = {
        "v.jsonl": "\n".join(verdicts),
        "t.csv": "transaction_id,account_id,customer_id,amount,merchant_name\nt1,a0,c1,1,old\nt1,a1,c9,NA,new\nt2,a2,c2,12x,\n",
        "a.csv": "account_id,customer_id,account_type\na1,c1,SAVINGS\na2,,SALARY\n",
        "c.csv": "customer_id,risk_rating,city\nc1,HIGH,X\nc2,LOW,Y\n",
        "q.json": '{"record_counts": {}}',
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    at = lambda name: str(tmp_path / name)
    view = explorer_plan.open_explorer(spark, at("v.jsonl"), at("t.csv"), at("a.csv"), at("c.csv"), at("q.json"))
    assert len(view.rows.columns) == 31 and view.message is None and view.report is not None
    got = {r["transaction_id"]: r.asDict() for r in view.rows.collect()}
    assert set(got) == {"t1", "5", "None", "", "t2"}
    t1, t2 = got["t1"], got["t2"]
    assert (t1["confidence"], t1["amount"], t1["merchant_name"], t1["risk_rating"]) == (0.9, "NA", "new", "HIGH")
    assert (t2["customer_id"], t2["cust_city"], t2["account_type"]) == ("c2", "Y", "SALARY")
    assert (got["5"]["is_fraud"], got["5"]["confidence"], got["5"]["justification"]) == (True, None, "")
    assert (got["None"]["is_fraud"], got["None"]["confidence"], got["None"]["justification"]) == (False, 1.0, "None")
    metrics = view.metrics.first()
    assert tuple(metrics)[:4] == (5, 2, 3, 40.0) and metrics["bad_lines"] == 2
    assert metrics["conf_avg"] == 0.8 and metrics["have_cust"]
    balanced = explorer_plan.explorer_rows(
        mark_documents(spark.read.text(at("v.jsonl"))),
        *[explorer_plan.read_lookup(spark, at(n), k) for n, k in
          (("t.csv", "transaction_id"), ("a.csv", "account_id"), ("c.csv", "customer_id"))], balance=True,
    )
    assert sorted(map(str, balanced.collect())) == sorted(map(str, view.rows.collect()))

    shown = lambda df: [r["transaction_id"] for r in df.collect()]
    by_confidence = explore.sort_rows(view.rows)
    assert shown(by_confidence) == ["None", "t1", "t2", "", "5"]
    assert shown(explore.sort_rows(view.rows, "amount")) == ["t2", "", "5", "None", "t1"]
    assert shown(explore.sort_rows(view.rows, "transaction_id")) == ["", "5", "None", "t1", "t2"]
    assert sorted(shown(explore.filter_rows(view.rows, " T ", "fraud"))) == ["t1"]
    assert sorted(shown(explore.filter_rows(view.rows, min_confidence=0.9))) == ["None", "t1"]
    assert len(shown(explore.filter_rows(view.rows, verdict="legit"))) == 3
    assert shown(explore.detail(view.rows, "t2")) == ["t2"]

    empty = explorer_plan.open_explorer(spark, at("no"), at("no"), at("no"), at("no"), at("no"))
    assert empty.rows.count() == 0 and empty.message and empty.report is None
    assert tuple(empty.metrics.first()) == (0, 0, 0, 0.0, 0.0, 0, False, False, False)


def test_jobs_read_quoted_line_breaks(spark, tmp_path):
    files = {
        "v.jsonl": "\n".join(
            f'{{"transaction_id": "{i}", "is_fraud": false, "confidence": 0.5, "justification": "k"}}' for i in ("t1", "t2")
        ),
        "t.csv": 'transaction_id,merchant_name,account_id\nt1,"two\nlines",a1\nt2,x,a1\n',
        "a.csv": 'account_id,note,customer_id\na1,"two\nlines",c1\n',
        "c.csv": 'customer_id,note,city\nc1,"two\nlines",X\n',
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    at = lambda name: str(tmp_path / name)
    summary, failures = validation.validate_file(spark, at("v.jsonl"), at("t.csv"), multiline=True)
    assert summary.first()["passed"] and failures.count() == 0
    view = explorer_plan.open_explorer(spark, at("v.jsonl"), at("t.csv"), at("a.csv"), at("c.csv"), at("q.json"), multiline=True)
    got = {r["transaction_id"]: (r["merchant_name"], r["customer_id"], r["cust_city"]) for r in view.rows.collect()}
    assert got == {"t1": ("two\nlines", "c1", "X"), "t2": ("x", "c1", "X")}
    torn, _ = validation.validate_file(spark, at("v.jsonl"), at("t.csv"))
    assert not torn.first()["passed"]


def test_leading_numbers(column):
    cases = {"12abc": 12.0, "1,234": 1.0, " 5": 5.0, "": 0.0, "x": 0.0, "-3.5e2y": -350.0, ".5": 0.5, None: 0.0}
    assert column(list(cases), explore.leading_number(F.col("s"))) == list(cases.values())


@pytest.mark.parametrize("rows", [0, 1, 2, 9, 988, 3001])
def test_split(spark, rows):
    keys = [f"TXN_{i:07d}" for i in range(rows)]
    df = spark.createDataFrame([(k,) for k in keys], "transaction_id string")
    got = {r[0]: r[1] for r in dataset.split_exact(df).collect()}
    order = sorted(keys, key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    train, valid = int(rows * 0.8), int(rows * 0.1)
    expected = {k: "train" if i < train else "valid" if i < train + valid else "test" for i, k in enumerate(order)}
    assert got == expected


def test_split_keys_have_to_be_unique(spark):
    with pytest.raises(ValueError):
        dataset.split_exact(spark.createDataFrame([("a",)] * 20, "transaction_id string"))
    with pytest.raises(ValueError):
        dataset.split_exact(spark.createDataFrame([("a",), (None,)], "transaction_id string"))


def test_evaluation(spark):
    rows = [(f"p{i}", " FRAUD" if i < 12 else " LEGITIMATE", "tuned", "LEGITIMATE") for i in range(100)]
    # base: 9 of 12 found, 70 false alarms
    rows += [(f"p{i}", " FRAUD" if i < 12 else " LEGITIMATE", "base", "Fraud." if i < 9 or 12 <= i < 82 else "legit")
             for i in range(100)]
    df = spark.createDataFrame(rows, "prompt string, completion string, run string, answer string")
    scores = labels.answer_scores(df, by=["run"])
    got = {r["run"]: tuple(r)[1:] for r in scores.collect()}
    assert got == {"tuned": (0.88, 0.0, 0.0, 0.0, 100, 12), "base": (0.27, 0.1139, 0.75, 0.1978, 100, 12)}
    both = evaluate.compare_runs(scores, "run", caveats=["few rows", "own labels"]).first()
    assert (both["delta_agreement"], both["delta_fraud_f1"]) == (0.61, -0.1978)
    assert both["fine_tuned_lora"]["n"] == 100 and both["caveats"] == ["few rows", "own labels"]
    none = labels.answer_scores(df.where("false")).first()
    assert none["agreement"] is None and none["n"] == 0


def planted(spark):
    """1000 raw transactions with known dirt: 988 ids, 12 exact copies."""
    rng = random.Random(7)
    names = [
        "transaction_id", "account_id", "customer_id", "transaction_timestamp", "transaction_hour", "amount",
        "currency", "transaction_type", "channel", "status", "merchant_name", "merchant_category", "auth_method",
        "device_type", "ip_address", "is_foreign_transaction", "is_new_device", "is_card_present", "is_weekend",
        "distance_from_home_km", "amount_to_account_avg_ratio", "txn_count_last_24h", "time_since_prev_txn_mins",
    ]
    rows = []
    for i in range(988):
        owner = rng.randint(1, 178)
        rows.append({
            "transaction_id": f"TXN_{i:07d}", "account_id": f"ACC_{owner:06d}",
            "customer_id": f"CUST_{(owner - 1) % 120 + 1:05d}", "currency": "INR",
            "transaction_timestamp": f"2026-0{rng.randint(1, 8)}-1{rng.randint(0, 9)} 1{rng.randint(0, 9)}:20:30",
            "transaction_hour": str(rng.randint(0, 23)), "amount": f"{rng.uniform(1, 2e5):.2f}",
            "transaction_type": "UPI", "channel": "APP", "status": rng.choice(["SUCCESS", " failed", "Reversed "]),
            "merchant_name": f"Shop {i % 50}", "merchant_category": "FOOD", "auth_method": "OTP",
            "device_type": "PHONE", "ip_address": "10.0.0.1", "is_foreign_transaction": rng.choice(["Y", "N", "1", "0"]),
            "is_new_device": rng.choice(["TRUE", "FALSE"]), "is_card_present": "n", "is_weekend": "N",
            "distance_from_home_km": f"{rng.uniform(0, 900):.1f}", "txn_count_last_24h": str(rng.randint(0, 7)),
            "amount_to_account_avg_ratio": f"{rng.uniform(0, 8):.2f}",
            "time_since_prev_txn_mins": f"{rng.uniform(0, 60):.1f}",
        })
    # rows from 100 on are never copied, so that nulls count once
    spread = lambda n: rng.sample(range(100, 988), n)
    bad = spread(31)
    for i in bad[:5]: rows[i]["amount"] = None
    for i in bad[5:22]: rows[i]["amount"] = "12,5"
    for i in bad[22:]: rows[i]["amount"] = "-4"
    bad = spread(90)
    for i in bad[:7]: rows[i]["transaction_timestamp"] = "NA"
    for i in bad[7:]: rows[i]["transaction_timestamp"] = "12/31/2025"
    for i in spread(8):
        rows[i]["account_id"], rows[i]["customer_id"] = f"ACC_9{i:05d}", ""
    for name, n in [("transaction_type", 75), ("channel", 73), ("status", 46), ("merchant_category", 83),
                    ("auth_method", 144), ("device_type", 99), ("ip_address", 585),
                    ("amount_to_account_avg_ratio", 156), ("time_since_prev_txn_mins", 156)]:
        for i in spread(n): rows[i][name] = "N/A"
    rows += [dict(rows[i]) for i in rng.sample(range(100), 12)]
    rng.shuffle(rows)
    kinds = ", ".join(f"{n} string" for n in names)
    transactions = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], kinds)
    accounts = spark.createDataFrame(
        [(f"ACC_{i:06d}", f"CUST_{(i - 1) % 120 + 1:05d}", "SAVINGS", "100.5") for i in range(1, 179)],
        "account_id string, customer_id string, account_type string, current_balance string",
    )
    customers = spark.createDataFrame(
        [(f"CUST_{i:05d}", rng.choice(["HIGH", "LOW", None]), rng.choice(["VERIFIED", "PENDING"]), "0")
         for i in list(range(1, 121)) + [90001, 90002, 90003, 90004]],
        "customer_id string, risk_rating string, kyc_status string, is_politically_exposed string",
    )
    return transactions, accounts, customers


def test_report_on_planted_dirt(spark):
    tables = planted(spark)
    scored, model = scoring.score(*tables)
    nested = report.quality_report(*tables, scored, scored).first().asDict(recursive=True)
    assert nested["record_counts"] == {
        "customers_raw": 124, "customers_dedup": 124, "accounts_raw": 178, "accounts_dedup": 178,
        "transactions_raw": 1000, "transactions_unique_ids": 988, "transactions_final": 988,
    }
    assert nested["duplicates_removed"] == {"txn_full_duplicate_rows": 12, "txn_duplicate_ids_after": 0}
    assert nested["invalid_or_corrupt"] == {
        "amount_non_numeric": 22, "amount_non_positive": 9, "timestamp_unparseable": 90, "timestamp_in_future": 0,
    }
    orphans = nested["orphaned_relationships"]
    assert orphans["txn_account_id_not_in_accounts"] == orphans["txn_customer_id_not_in_customers"] == 8
    assert nested["missing_values_by_field"] == {
        "customer_id": 8, "transaction_timestamp": 7, "amount": 5, "transaction_type": 75, "channel": 73,
        "status": 46, "merchant_category": 83, "auth_method": 144, "device_type": 99, "ip_address": 585,
        "amount_to_account_avg_ratio": 156, "time_since_prev_txn_mins": 156,
    }
    assert nested["prompt_injection"]["merchant_strings_flagged"] == 0
    flagged = nested["flagged_transactions"]
    assert flagged["is_fraud_true"] + flagged["is_fraud_false"] == 988
    assert flagged["fraud_rate"] == round(flagged["is_fraud_true"] / 988, 4)
    top = quality.top_missing(quality.missing_by_field(scoring.normalize_na(tables[0]))).collect()
    assert [r["field"] for r in top] == [
        "ip_address", "amount_to_account_avg_ratio", "time_since_prev_txn_mins", "auth_method", "device_type",
        "merchant_category",
    ]
    pairs = labels.labelled_splits(scored)
    summary = dataset.split_summary(pairs).first()
    assert tuple(summary)[:4] == (988, 790, 98, 100)
    assert pairs.columns == ["transaction_id", "split", "prompt", "completion"]


def test_report_without_merchants_or_rows(spark):
    transactions, accounts, customers = planted(spark)
    transactions = transactions.drop("merchant_name", "ip_address")
    linked = scoring.prepare(transactions, accounts, customers)
    scored = scoring.transform(linked, scoring.fit(linked))
    nested = report.quality_report(transactions, accounts, customers, linked, scored).first()
    assert nested["prompt_injection"]["merchant_strings_flagged"] == 0
    assert "ip_address" not in nested["missing_values_by_field"]
    rows = quality.report_rows(spark.createDataFrame([nested.asDict(recursive=True)],
                                                     "record_counts struct<transactions_raw: bigint, transactions_final: bigint>, "
                                                     "duplicates_removed struct<txn_full_duplicate_rows: bigint>, "
                                                     "invalid_or_corrupt struct<amount_non_numeric: bigint, amount_non_positive: bigint, timestamp_unparseable: bigint>, "
                                                     "orphaned_relationships struct<txn_account_id_not_in_accounts: bigint, txn_customer_id_not_in_customers: bigint>, "
                                                     "prompt_injection struct<merchant_strings_flagged: bigint>")).orderBy("position").collect()
    assert [r["shown"] for r in rows] == ["1000 → 988", "12", "22", "9", "90", "8", "8", "0"]


def test_verdict_fields_are_the_four():
    assert fixed.VERDICT_FIELDS == ["transaction_id", "is_fraud", "confidence", "justification"]

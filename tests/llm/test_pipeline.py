"""The stages of the corpus pipeline, one after the other, against what each has to do."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from test_texts import brute_components

import corpus_pipeline as pipeline
from riskloom.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    outs, docs = [given.collect()], given
    for number, (_, step) in enumerate(pipeline.STAGES):
        step(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        outs.append(docs.collect())
        if number < 4:
            assert docs.columns == given.columns
    texts = {r["doc_id"]: r["text"] for r in outs[0]}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for before, after in zip(outs[:3], outs[1:4]):
        assert {r["doc_id"] for r in after} < {r["doc_id"] for r in before}
        assert all(r["text"] == texts[r["doc_id"]] for r in after)
    kept = {r["doc_id"] for r in outs[1]}
    assert np.mean([(i in kept) == bool(labels[i]["quality"]) for i in labels]) > 0.9
    clean = {r["doc_id"] for r in outs[2]}
    assert np.mean([(i in clean) == (not labels[i]["toxic"]) for i in labels if i in kept]) > 0.85
    groups, _ = brute_components([(r["doc_id"], r["text"]) for r in outs[2]], 5, 80, 100)
    assert {r["doc_id"] for r in outs[3]} == {i for i, c in groups.items() if i == c}
    taken = Counter(r["doc_id"] for r in outs[4])
    assert set(taken) <= {r["doc_id"] for r in outs[3]} and set(taken.values()) <= {1, 2}
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in outs[3]}
    total, budget = sum(words[i] * n for i, n in taken.items()), 1.5 * sum(words.values())
    assert budget - 2 * max(words.values()) <= total <= budget
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(r["doc_id"] for r in outs[5]) == taken
    for r in outs[5]:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert Counter(map(tuple, pipeline.run(spark, SF).collect())) == Counter(map(tuple, outs[5]))


def test_clashing_columns_are_carried(spark):
    """Columns named like those that the operators add come out of every filtering stage with their values."""
    clash = ["size", "target", "copies", "taken", "key", "tie", "n", "fp", "score", "component_id", "kept_text", "slice", "label"]
    rows = [(i, f"The {i % 3} walks under a green window, as it did before. And {i} more." * 3, "en", f"s{i % 2}", 9) for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in clash])
    for number, (_, step) in enumerate(pipeline.STAGES[:4]):
        out = step(spark, docs, SF)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{c}{r['doc_id']}" for c in clash), number


def test_odd_documents(spark):
    """Empty tables, and documents without text, id or source, pass every stage."""
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id", "en", None, 5), (3, "x y z", "en", "a", 5), (3, "x y z", "en", "a", 5)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, DOCS)
        for number, (_, step) in enumerate(pipeline.STAGES):
            out = step(spark, docs, SF)
            assert number == 4 or out.columns == docs.columns
            assert out.count() <= 2 * len(rows)

"""Encoding, classifiers, near duplicates and the language model, against brute force or labels."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from riskloom.llm import bpe, components, partenum, pitman_yor, quality, toxicity
from riskloom.llm.labelled import held_out
from riskloom.llm.queries import QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, fp string, word string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "f", "w", "x") for i, t in rows], DOCS)


# --- byte-level BPE ---


@pytest.mark.parametrize("name", [VOCABULARY, "byte_bpe_50k.tiktoken"])
def test_codec_agrees_with_the_library(name):
    with open(public_tokenizers.path(name), "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.rank_of, special_tokens={})
    draw = random.Random(4)
    pick = [lambda: draw.randrange(32, 127), lambda: draw.randrange(0x80, 0x3000), lambda: draw.randrange(0x10000, 0x323B9), lambda: draw.randrange(33)]
    texts = ["".join(chr(draw.choice(pick)()) for _ in range(draw.randrange(120))) for _ in range(400)]
    texts += ["", " ", "\n\n  x", "a" * 20_000, "ab" * 9_000, "".join(draw.choices("abcdefgh", k=20_000)), "<|endoftext|>", "it's 1234'll ", "՘\U00018e48x"]
    for text in texts:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_op7(spark):
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op7_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_null_texts_have_no_ids(spark):
    codec = bpe.round_trip(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    rows = frame(spark, [(1, None), (2, ""), (2, ""), (None, "word")]).select("doc_id", codec("text").alias("c")).collect()
    assert [(r["c"]["n_tokens"], bytes(r["c"]["ids"]), bytes(r["c"]["decoded"])) for r in rows][:3] == [(0, b"", b"")] * 3
    assert bytes(rows[3]["c"]["decoded"]) == b"word"


# --- classifiers ---


def corpus(n):
    """Documents with labels that words and writing decide, some ids in the held-out fold."""
    draw = random.Random(1)
    words = ["river", "stone", "green", "walks", "under", "seven", "paper", "light", "window", "garden"]
    rows, labels = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(40)]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            text[draw.randrange(40)] = draw.choice(["grubling", "grublet", "nastoid"])
        body = " ".join(text)
        body = body.capitalize() + "." if good else " | ".join(text).upper()
        rows.append((i, body))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = corpus(600)
    odd = [(1000, None), (1001, ""), (None, "no id at all"), (0, rows[0][1]), (1002, "x" * 200_000)]
    more = [(1000, 1, 0), (1001, 0, None), (None, 1, 1), (7, 0, 1), (5000, 1, 1)]
    schema = "doc_id long, quality int, toxic int"
    return frame(spark, rows + odd), spark.createDataFrame(labels + more, schema), labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity(spark, labelled):
    docs, labels, truth = labelled
    lexicon = toxicity.train(docs, labels)
    assert {" grubl", " nastoid "} <= set(lexicon.weights) or {" grubli", " grublet "} <= set(lexicon.weights)
    got = docs.select("doc_id", held_out().alias("held"), toxicity.scorer(lexicon).alias("s")).collect()
    assert len(got) == docs.count() and all(0 <= r["s"] <= 1 for r in got)
    toxic = {i: t for i, _, t in truth}
    checked = [r for r in got if r["doc_id"] in toxic and held(r["doc_id"])]
    assert all(r["held"] == held(r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert len(checked) > 100 and all((r["s"] >= 0.3) == bool(toxic[r["doc_id"]]) for r in checked)
    assert {r["s"] >= 0.3 for r in got if r["doc_id"] in (1000, 1001)} == {False}


def rates(spark, sf, label, score, bar):
    """Recall and precision on the held-out fold of the given tables."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = docs.join(labels, "doc_id").where(held_out()).select(label, (score(docs, labels) >= bar).cast("int").alias("said"))
    n = Counter(map(tuple, scored.collect()))
    return n[1, 1] / max(n[1, 1] + n[1, 0], 1), n[1, 1] / max(n[1, 1] + n[0, 1], 1)


def test_held_out_accuracy_on_the_given_tables(spark):
    """Some labels are noise: at 1,000 documents 5 of 14 toxic ones hold none of the words that mark the others."""
    toxic = lambda d, y: toxicity.scorer(toxicity.train(d, y))
    recall, precision = rates(spark, "sf0.1", "toxic", toxic, 0.3)
    assert recall >= 0.9 and precision >= 0.95
    recall, precision = rates(spark, "sf0.01", "toxic", toxic, 0.3)
    assert recall >= 0.6 and precision >= 0.9
    recall, precision = rates(spark, "sf0.01", "quality", quality.scores, 0.7)
    assert recall >= 0.9 and precision >= 0.9


def test_entries_by_brute_force(spark):
    """Terms, their document counts and what passes, counted one by one."""
    rows, labels = corpus(240)
    truth = {i: y for i, _, y in labels}
    held = Counter((t, truth[i]) for i, text in rows for t in set(toxicity.terms(text)))
    toxic = sum(truth.values())
    counts = Counter((held[t, 1], held[t, 1] + held[t, 0]) for t in {t for t, _ in held} if held[t, 0] + held[t, 1] >= 3)
    accepted, factor = toxicity.discoveries(dict(counts), toxic / len(rows), toxicity.FALSE_SHARE)
    frame_of = spark.createDataFrame([(t, truth[i]) for i, t in rows], "text string, label int")
    lexicon, n_toxic, n_clean = toxicity.learn(frame_of)
    assert (n_toxic, n_clean, factor) == (toxic, len(rows) - toxic, 1.0)
    for term in lexicon.weights:
        assert (held[term, 1], held[term, 1] + held[term, 0]) in accepted
    for term in {t for t, _ in held}:  # what passes is an entry, or an entry's beginning, or begun by one
        n = (held[term, 1], held[term, 1] + held[term, 0])
        near = [e for e in lexicon.weights if e.startswith(term.rstrip()) or term.startswith(e)]
        assert n not in accepted or n[0] < 3 or near or n[0] / n[1] < 0.6, term


def test_chance_and_false_discoveries():
    assert math.isclose(toxicity.chance(2, 3, 0.5), 0.5) and math.isclose(toxicity.chance(4, 4, 0.1), 1e-4)
    few = {(4, 4): 2, (3, 3): 5, (1, 4): 3000}
    assert toxicity.discoveries(few, 0.14, 0.001) == ({(4, 4)}, 0.5)  # the best of few, at half weight
    assert toxicity.discoveries({(40, 40): 1, (5, 40): 1000}, 0.14, 0.001) == ({(40, 40)}, 1.0)
    assert toxicity.discoveries({(1, 4): 10}, 0.14, 0.001) == (set(), 1.0) and toxicity.discoveries({}, 0.1, 0.1) == (set(), 1.0)


def test_repeated_ids_do_not_grow_the_sample(spark):
    rows, labels = corpus(60)
    docs = frame(spark, rows + [(0, f"other {i}") for i in range(500)])
    kinds = "doc_id long, quality int, toxic int"
    from riskloom.llm.labelled import sample

    got = sample(docs, spark.createDataFrame(labels, kinds), "toxic", 4_000)
    assert got.count() == sum(not held(i) for i, _ in rows)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " moro": 3.0}, ["village idiot"])
    found = lambda text: sum(w for _, _, w in lexicon.hits(toxicity.fold(text)))
    assert found("an IDIOT, an 1d10t, an idi​ot, an іdіοt, an ｉｄｉｏｔ") == 25
    assert found("Morons morose; tomorrow") == 6
    assert found("the village idiot and the idiot") == 5
    assert found("idiotic idio t") == 0 and found(None) == 0 and found("") == 0
    assert toxicity.Lexicon({}).evidence("anything") == (0.0, 0.0, 0.0)


def test_quality(spark, labelled):
    docs, labels, truth = labelled
    got = docs.select("doc_id", quality.scores(docs, labels).alias("s")).collect()
    assert len(got) == docs.count() and all(0 <= r["s"] <= 1 for r in got)
    good = {i: q for i, q, _ in truth}
    checked = [r for r in got if r["doc_id"] in good and held(r["doc_id"])]
    assert all((r["s"] >= 0.7) == bool(good[r["doc_id"]]) for r in checked)


def test_quality_learns_from_every_label(spark):
    """All labelled documents take part, each of the larger class in a pair, those of the other about equally often."""
    rows = [(i, [float(i)] * quality.FEATURES, int(i % 10 == 0)) for i in range(30_000)]
    learned = spark.createDataFrame(rows, "doc_id long, x array<float>, label int")
    pairs = quality.preference_pairs(learned, {0: 27_000, 1: 3_000}).select(F.col("good")[0], F.col("bad")[0]).collect()
    assert sorted(bad for _, bad in pairs) == [i for i in range(30_000) if i % 10]
    used = Counter(good for good, _ in pairs)
    assert all(good % 10 == 0 for good in used) and len(used) > 2_950 and max(used.values()) < 40
    few = [(i, "Good words stand here. " * 3 if i % 2 else "bad|bad|bad !!", i % 2) for i in range(400)]
    docs = frame(spark, [(i, x) for i, x, _ in few] + [(3, "zz")])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in few], "doc_id long, quality int, toxic int")
    assert quality.learned_rows(docs, labels, "quality").count() == sum(not held(i) for i in range(400))
    rows = spark.createDataFrame([(i, [i / 10] * quality.FEATURES, int(i >= 70)) for i in range(100)], "doc_id long, x array<float>, label int")
    model = quality.fit(rows)
    x = np.array([[i / 10] * quality.FEATURES for i in range(100)])
    assert ((model.score(x) >= quality.ACCEPTED) == (np.arange(100) >= 70)).all()


def test_classifiers_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    schema = "doc_id long, quality int, toxic int"
    for rows in ([], [(1, None, None)], [(1, 1, 1)], [(2, 0, 0)]):
        labels = spark.createDataFrame(rows, schema)
        scored = docs.select(quality.scores(docs, labels).alias("q"), toxicity.scorer(toxicity.train(docs, labels)).alias("t"))
        assert all(0 <= r["q"] <= 1 and 0 <= r["t"] <= 1 for r in scored.collect())


def test_labels_of_given_tables_are_learned(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, label, least in (("op8_quality", "quality", 0.97), ("op6_toxicity", "toxic", 0.93)):
        rows = [r for r in QUERIES[name](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
        assert np.mean([r["predicted"] == labels[r["doc_id"]][label] for r in rows]) >= least


# --- near duplicates ---


def brute_components(rows, words, num, den):
    sets = {}
    for i, text in rows:
        if i is not None:
            w = (text or "").encode().lower().split()
            grams = frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()
            sets.setdefault(i, set()).add(grams)
    ids = [(i, g) for i, gs in sets.items() for g in gs]
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(ids):
        for j, y in ids[:a]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in sets}, {i: {len(g) for g in gs} for i, gs in sets.items()}


def near_copies():
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    rows, n = [], 0
    for size in (1, 2, 3, 4, 9, 12, 20, 40, 150, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for copy in range(5):
                text = list(base)
                for _ in range(draw.randrange(0, 1 + size // 18)):
                    text[draw.randrange(size)] = word()
                rows.append((n, " ".join(text) if copy else "\t".join(text).upper()))
                n += 1
    chain = [word() for _ in range(200)]  # each near its neighbours only
    for _ in range(40):
        chain[draw.randrange(200)] = word()
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "cafÉ b c"), (n + 4, "café b c"), (None, "x y z"), (n + 5, "x y z")]
    return rows + [(n + 6, rows[0][1]), (n + 6, rows[0][1])] + [(n + 10 + i, "same text again and again") for i in range(60)]


@pytest.mark.parametrize("words, num, den", [(3, 90, 100), (5, 80, 100), (2, 1, 2)])
def test_near_duplicates(spark, words, num, den):
    rows = near_copies()
    want, sizes = brute_components(rows, words, num, den)
    got = partenum.near_duplicates(frame(spark, rows), words, num, den).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == max(1, 4 - words)
        else:
            assert (r["component_id"], r["n_shingles"] in sizes[r["doc_id"]]) == (want[r["doc_id"]], True)


def test_one_of_each(spark):
    rows = near_copies()
    want, _ = brute_components(rows, 5, 80, 100)
    got = partenum.one_of_each(frame(spark, rows))
    assert got.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert {r["doc_id"] for r in got.collect()} == {i for i, c in want.items() if i == c} | {None}
    assert partenum.near_duplicates(frame(spark, [])).collect() == []
    assert partenum.one_of_each(frame(spark, [(1, None)])).count() == 1


@pytest.mark.parametrize("num, den", [(9, 10), (4, 5), (1, 2)])
def test_similar_sets_share_a_signature(num, den):
    scheme, draw, tested = partenum.Scheme(num, den), np.random.default_rng(7), 0
    new = lambda n: draw.integers(0, 2**64, n, dtype=np.uint64)
    for _ in range(1500):
        a = np.unique(new(int(np.exp(draw.uniform(0, 7)))))
        off = int(draw.integers(0, len(a) * (den - num) // den + 2))
        b = np.unique(np.r_[draw.permutation(a)[: len(a) - int(draw.integers(0, off + 1))], new(int(draw.integers(0, off + 1)))])
        if len(b) and partenum.similar(a, b, num, den):
            tested += 1
            assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size
    assert tested > 700


def test_copies_below_the_threshold_cost_nothing(spark, monkeypatch):
    """Edits of one's own: a large group whose pairs are all below the threshold is dropped before any pair is made."""
    draw = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    apart = [(i, " ".join(w if draw.random() > 0.12 else f"x{i}_{j}" for j, w in enumerate(base))) for i in range(300)]
    close = [(1000 + i, " ".join(w if j != 5 * i % 120 else f"y{i}" for j, w in enumerate(base[::-1]))) for i in range(40)]
    tested, original = [], partenum._links

    def links(num, den):
        inner = original(num, den)

        def run(batches):
            yield from inner(batches)

        tested.append(1)
        return run

    monkeypatch.setattr(partenum, "_links", links)
    monkeypatch.setattr(partenum, "PART_SETS", 16)  # large buckets are dealt over parts
    wanted, _ = brute_components(apart + close, 3, 80, 100)
    got = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(frame(spark, apart + close), 3, 80, 100).collect()}
    assert got == wanted and len({got[i] for i, _ in close}) == 1
    before = len(tested)
    alone = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(frame(spark, apart), 3, 80, 100).collect()}
    assert alone == {i: i for i, _ in apart} and len(tested) == before


def test_lone_elements(spark):
    sets = [(1, [1, 2, 3]), (2, [2, 3, 4, 5]), (3, [9]), (4, [2])]
    packed = [(fp, np.array(g, np.int64).tobytes()) for fp, g in sets]
    got = partenum.lonely(spark.createDataFrame(packed, "fp long, grams binary"))
    assert {r["fp"]: r["lone"] for r in got.collect()} == {1: 1, 2: 2, 3: 1}


def test_only_sets_of_pairs_are_moved(spark, monkeypatch):
    keys = spark.range(20_000).select((F.col("id") * 7919 - 500_000).alias("k"), F.col("id").alias("v"))
    wanted = keys.where("v % 50 = 0").select(F.col("k").alias("a")).union(spark.createDataFrame([(None,), (3,)], "a long"))
    got = {r["v"] for r in partenum.among(keys, "k", wanted, 402).collect()}
    assert got >= set(range(0, 20_000, 50)) and len(got) < 4_000
    assert partenum.among(keys, "k", wanted.limit(0), 0).count() == 0

    asked, original = [], partenum.among
    monkeypatch.setattr(partenum, "among", lambda df, key, few, rows: asked.append((key, rows)) or original(df, key, few, rows))
    alike = [(i, " ".join(f"w{j}" for j in range(200)) + f" e{i % 5}") for i in range(20)]
    other = [(100 + i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(20)]
    found = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(frame(spark, alike + alike + other)).collect()}
    assert found == {i: 0 for i in range(20)} | {i: i for i in range(100, 120)}
    assert [key for key, _ in asked[:3]] == ["doc_id", "fp", "fp"] and max(rows for _, rows in asked) <= 10


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(500, 500), (300, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in [*range(61), 300]} | {i: 100 for i in range(100, 140)}
    assert {r["node"]: r["label"] for r in got} == want and len(got) == len(want)


def test_sets_repeated_in_many_tasks(spark, monkeypatch):
    fps = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 1000)

    def signatures(words, num, den, hot=None):
        def run(batches):
            for _ in batches:
                salt = {} if hot is None else {"salt": np.zeros(2000, np.int32)}
                yield pd.DataFrame({"signature": np.repeat([7, 8], 1000), "fp": np.r_[fps, fps]} | salt)

        return run

    monkeypatch.setattr(partenum, "_signatures", signatures)
    docs = spark.range(0, 240, 1, 240).select(F.col("id").cast("string").alias("text"))
    got = partenum.buckets(docs, 5, 80, 100).select("bucket", "fp").collect()
    assert len(got) == 1000 and len({r["bucket"] for r in got}) == 1


def test_hot_signatures(spark, monkeypatch):
    docs = frame(spark, [(i, " ".join(f"w{j}" for j in range(12)) + f" v{i % 90}") for i in range(180)]).repartition(6)
    found = []
    for rows in (1, 10**9):
        monkeypatch.setattr(partenum, "HOT_ROWS", rows)
        monkeypatch.setattr(partenum, "HOT_TEXTS", 1)
        assert (len(partenum.hot_signatures(docs, 5, 80, 100)) > 0) == (rows == 1)
        found.append(sorted(tuple(r) for r in partenum.buckets(docs, 5, 80, 100).select("bucket", "fp").collect()))
    assert found[0] == found[1] and len({fp for _, fp in found[0]}) == 90


# --- language model ---


def test_language_model(spark):
    draw = random.Random(5)
    topics = [[f"{i}{t}" for i in range(60)] for t in ("ar", "bo", "cu")]
    rows = [(i, " ".join(draw.choice(topics[i % 3]) for _ in range(60))) for i in range(240)]
    rows += [(1000, None), (1001, ""), (1002, "Never SEEN 1ar"), (None, "1ar 2ar"), (3, rows[3][1]), (3, rows[3][1])]
    out = held_out(folds=10, fold=0)
    got = pitman_yor.score(frame(spark, rows), ~out).collect()
    few = pitman_yor.score(frame(spark, rows), ~out, head_words=10).collect()
    training = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    split = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter(w for t in training for w in split(t))
    total = sum(counts.values())
    want = Counter()
    for i, t in rows:
        w = split(t)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (len(counts) + 1))) for x in w)
        want[i, len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)] += 1
    for rows_of in (got, few):
        keys = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows_of)
        assert keys == want
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    a, b = (np.array([r["score"] for r in sorted(x, key=key)]) for x in (got, few))
    assert np.all(a < 0) and np.abs(a - b).max() < 1e-3 * np.abs(a).max()
    unseen = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and not zlib.crc32(str(r["doc_id"]).encode()) % 10]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert pitman_yor.score(frame(spark, []), ~out).collect() == []
    assert len(pitman_yor.score(frame(spark, [(1, "a b")]), F.lit(False)).collect()) == 1


def test_scores_do_not_depend_on_partitions(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(f"w{int(draw.paretovariate(0.7)) % 500}" for _ in range(80))) for i in range(200)]
    before = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in (3, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            scored = pitman_yor.score(frame(spark, rows).repartition(parts), ~held_out(folds=10, fold=0), head_words=50)
            found.append({r["doc_id"]: r["score"] for r in scored.collect()})
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found[0].keys() == found[1].keys()
    assert max(abs(found[0][i] - found[1][i]) for i in found[0]) < 1e-9


def test_probabilities_add_up(spark):
    rows = [(i, " ".join(f"w{j % (i + 2)}" for j in range(50))) for i in range(30)]
    model, totals = pitman_yor.train(frame(spark, rows))
    back_off = np.array([totals.new_table(t) for t, _ in totals.samples])
    seen = np.zeros(pitman_yor.CONTEXTS)
    for r in model.collect():
        p = np.array(r["roots"]) @ back_off / len(back_off)
        p[r["context"]] = r["p"]
        seen += p
    assert np.allclose(seen + totals.unseen(), 1)


def test_seating():
    d, draw = 0.6, np.random.default_rng(0)
    table = pitman_yor.stirling(d)
    assert np.isclose(np.exp(table[3, 1]), (1 - d) * (2 - d)) and np.isclose(np.exp(table[3, 2]), 3 - 3 * d)
    exact = np.exp(table[5, 1:6] + np.log(2.0) * np.arange(1, 6))
    drawn = pitman_yor.seat(np.full(40_000, 5), np.full(40_000, 2.0), d, table, draw)
    assert np.allclose(np.bincount(drawn, minlength=6)[1:] / 40_000, exact / exact.sum(), atol=0.01)
    # the approximation for many customers continues the exact draws
    n, q = pitman_yor.EXACT, 3.0
    weights = np.exp(table[n, 1 : n + 1] + np.log(q) * np.arange(1, n + 1) - 200)
    mean = (weights * np.arange(1, n + 1)).sum() / weights.sum()
    beyond = pitman_yor.seat(np.full(4_000, n + 1), np.full(4_000, q), d, table, draw)
    assert abs(beyond.mean() - mean) < 0.3


def test_word_pairs_are_learned(spark):
    """Two words of one class have restaurants of their own, and scores are those of the three levels by brute force."""
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice(["anew york", "knew pork", "b c", "c"]) for _ in range(draw.randrange(1, 12)))) for i in range(60)]
    asked = [(100, "anew york"), (101, "anew pork"), (102, "knew york b zz anew c"), (103, None)]
    training = F.col("doc_id") < 100
    docs = frame(spark, rows + asked)
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, training).collect()}
    few = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, training, head_words=2).collect()}
    assert got[100] > got[101] + 1

    model, totals = pitman_yor.train(docs.where(training).select("doc_id", "text"))
    words = {r["word"]: r for r in model.collect()}
    pairs = {(r["prev"], r["word"]): r for r in totals.pairs.collect()}
    want = Counter((a, b) for _, t in rows for hashes, before, _ in [pitman_yor.tokens([t])] for a, b in zip(before.tolist(), hashes.tolist()))
    assert {k: r["n"] for k, r in pairs.items()} == want and all(1 <= r["t"] <= r["n"] for r in pairs.values())
    new_table = np.array([totals.new_table(s) for s, _ in totals.samples])

    def chance(prev, word):
        k = prev % pitman_yor.CONTEXTS
        r = words.get(word)
        of_class = totals.unseen()[k]
        if r:
            of_class = (np.array(r["roots"]) @ new_table / len(new_table))[k]
            if k in r["context"]:
                of_class = r["p"][r["context"].index(k)]
        n = sum(c for (u, _), c in want.items() if u == prev)
        tables = sum(r["t"] for (u, _), r in pairs.items() if u == prev)
        held = pairs.get((prev, word))
        own = held["n"] - totals.d_pairs * held["t"] if held else 0
        return (own + (1 + totals.d_pairs * tables) * of_class) / (1 + n)

    for i, t in rows[:10] + asked:
        hashes, before, _ = pitman_yor.tokens([t])
        expected = sum(math.log10(chance(a, b)) for a, b in zip(before.tolist(), hashes.tolist()))
        assert abs(got[i] - expected) < 1e-4 and abs(few[i] - expected) < 1e-4
    for prev in {a for a, _ in want}:
        assert np.isclose(sum(chance(prev, w) for w in words) + chance(prev, 16), 1)

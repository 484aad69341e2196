"""Mixing, sharding and archives."""

import base64
import hashlib
import io
import zlib
from collections import Counter, defaultdict

import pytest

from riskloom.llm import mixing, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, copies int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, "x", 3, "k") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(["w"] * (1 + i * 7 % 90)), f"s{i % 5}" if i % 3 else "s0") for i in range(600)]
    out += [(600, None, "s1"), (601, "", None), (602, "a b c", None), (None, "no id", "s2"), (5, out[5][1], "s1"), (5, out[5][1], "s1")]
    out += [(700, "long " * 3000, "s4"), (701, " ", "empty"), (702, None, "empty")]
    return out


def test_targets_fill_up_small_sources(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 1), (None, 50)]
    df = mixing.targets(spark.createDataFrame(sizes, "source string, source_size long"), (3, 1, 2), 1.5, 2)
    got = {r["source"]: r["target"] for r in df.collect()}
    # weights by code point, null last: a 3, b 1, c 2, null 3; all but b are full
    assert got == {"a": 200.0, "c": 2.0, None: 100.0, "b": 1.5 * 1151 - 302}


@pytest.mark.parametrize("slice_rows", [16, 32_768])
def test_mix(spark, rows, slice_rows):
    got = mixing.mix(frame(spark, rows), slice_rows=slice_rows).collect()
    assert len(got) == len(rows)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(3), slice_rows=slice_rows).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == sizes[r["source"]] for r in got)
    assert {r["doc_id"]: r["size"] for r in got}[602] == 2  # a no-break space is no blank
    budget = 1.5 * sum(sizes.values())
    assert sum(target.values()) == pytest.approx(budget) and sum(taken.values()) <= budget
    longest = defaultdict(int)
    for r in got:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] for s in taken)


def test_mixture_repeats_whole_rows(spark, rows):
    df = frame(spark, rows)
    copies = Counter()
    for r in mixing.mix(df).collect():
        copies[r["doc_id"]] += r["copies"]
    got = mixing.mixture(df)
    assert got.columns == df.columns
    assert Counter(r["doc_id"] for r in got.collect()) == +copies
    assert mixing.mix(frame(spark, [])).collect() == []
    assert mixing.mixture(frame(spark, [(1, None, None)])).count() in (0, 1, 2)


def test_mixture_leaves_texts_where_they_are(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "docs"))
    plan = mixing.mixture(spark.read.parquet(str(tmp_path / "docs")))._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert not shuffles


def test_mixture_counts_equal_rows_out(spark):
    rows = [(1, "a b c", "s0")] * 7 + [(2, "d e", "s1")] * 9 + [(None, "f", None)] * 5
    df = frame(spark, rows)
    copies = Counter()
    for r in mixing.mix(df).collect():
        copies[r["doc_id"]] += r["copies"]
    assert 0 < copies[2] % 9  # some of the equal rows are taken once more than others
    assert Counter(r["doc_id"] for r in mixing.mixture(df).collect()) == +copies


def test_shard(spark, rows):
    got = sharding.shard(frame(spark, rows), 7, slots=512).collect()
    texts = {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert len(got) == len(rows) and {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == texts
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    rest = sorted(loads.values())[:-1]  # one text is longer than a shard
    assert len(loads) == 7 and max(rest) - min(rest) < 0.15 * max(rest)
    assert sharding.shard(frame(spark, []), 7).collect() == []


def test_map_versions(spark, tmp_path):
    sizes = [(s, 100 + s % 17, 1) for s in range(1000)]
    versions = sharding.SlotMap(spark, str(tmp_path / "map"))
    first = sharding.assign(sizes, 10)
    versions.write(0, first, sizes)
    grown = sharding.rebalance(first, sizes, 11)
    versions.write(1, grown, sizes)
    assert {s for s in grown if grown[s] != first[s]} == {s for s in grown if grown[s] == 10}
    loads = Counter()
    for slot, size, _ in sizes:
        loads[grown[slot]] += size
    assert max(loads.values()) < 1.05 * min(loads.values())
    shrunk = sharding.rebalance(grown, sizes, 9)
    assert all(shrunk[s] == grown[s] for s in grown if grown[s] < 9) and set(shrunk.values()) == set(range(9))
    assert {r["virtual_slot"]: r["shard"] for r in versions.read(0).collect()} == first


PAGES = "page_id long, url string, html string, payload string, key int, first long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1, 2) for i, u, h in rows], PAGES)


def test_archive(spark, tmp_path):
    same = "<p>ünïcode \r\n\r\n text</p>"
    rows = [(i, f"http://x/{i}", f"<html>{'body ' * i}{i}</html>") for i in range(40)]
    rows += [(90, "a\r\nWARC-Type: x", same), (50, None, same), (60, "u", same), (50, None, same)]
    rows += [(70, "e", None), (71, "e", ""), (None, "n", same), (None, "n", "only here"), (80, "l", "x" * 3_000_000)]
    got = warc.archive(pages(spark, rows), str(tmp_path / "warc")).collect()

    def key(*r):
        return tuple((v is None, v) for v in r)

    found = sorted(key(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = least.get(h or "")
        first = None if first == i else first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append(key(i, len(data), digest, "response" if first is None else "revisit", first))
    assert found == sorted(want)
    assert {r["url"] for r in got if r["page_id"] == 90} == {"a%0D%0AWARC-Type:%20x"}
    assert warc.archive(pages(spark, []), str(tmp_path / "none")).collect() == []


def test_least_size_of_revisits(spark, tmp_path):
    rows = [(1, "u", "short"), (2, "u", "short"), (3, "u", "longer text"), (4, "u", "longer text")]
    got = warc.archive(pages(spark, rows), str(tmp_path / "w"), least_bytes=8).collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {1: None, 2: None, 3: None, 4: 3}


def test_archive_layout():
    records = [warc.record(i, "u", f"payload {i} {'again and again ' * 20}".encode(), None) for i in range(200)]
    dictionary = warc.zstandard.train_dictionary(2048, records).as_bytes()
    with_it, without = io.BytesIO(), io.BytesIO()
    list(warc.write_archive(with_it, iter(records), dictionary))
    list(warc.write_archive(without, iter(records), b""))
    assert with_it.getvalue()[:4] == b"\x5d\x2a\x4d\x18"
    assert len(with_it.getvalue()) < len(without.getvalue())
    for file in (with_it, without):
        file.seek(0)
        assert [f["WARC-Record-ID"] for f, _ in warc.read_archive(file)] == [f"<urn:page:{i}>" for i in range(200)]


def test_rebalanced_placement(spark, rows, tmp_path):
    """Version 1 is the edited version 0: records move with their slots, into shards that need them only."""
    path = str(tmp_path / "map")
    got = sharding.rebalanced(frame(spark, rows), 5, 6, slots=64, path=path).collect()
    assert len(got) == len(rows)
    for shard, slot in (("shard", "slot"), ("next_shard", "next_slot")):
        places = defaultdict(list)
        for r in got:
            places[r[shard]].append(r[slot])
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
    load, total = Counter(), sum(r["size"] for r in got)
    for r in got:
        load[r["next_shard"]] += r["size"]
    moved = {(r["shard"], r["next_shard"]) for r in got if r["shard"] != r["next_shard"]}
    assert moved and set(load) == set(range(6)) and all(b == 5 for _, b in moved)
    assert load[5] <= total / 6
    old, new = ({r["virtual_slot"]: r["shard"] for r in sharding.SlotMap(spark, path).read(v).collect()} for v in (0, 1))
    assert old.keys() == new.keys() and sum(old[s] != new[s] for s in old) < len(old) / 2
    assert sharding.rebalanced(frame(spark, rows[:0]), 5, 6).collect() == []

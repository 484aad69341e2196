"""Personal data in documents: what patterns find, and what a character tagger trained on it adds."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import tagger
from riskloom.llm.keys import hash_of
from riskloom.llm.pii_rules import KINDS, Span, base_spans, plausible, text_of

DOCUMENTS = 20_000
PIECES, PROSE = 400, 3_000
EXAMPLES, WINDOW = 6_000, 80
CHARACTERS = 4_000_000
FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
DOMAINS = ("com", "org", "net", "de", "fr", "es", "io", "co.uk")


def _letters(draw: np.random.Generator, least: int, most: int) -> str:
    return "".join(draw.choice(list(string.ascii_lowercase), draw.integers(least, most + 1)))


def _one(draw: np.random.Generator, options: Sequence[str]) -> str:
    return options[int(draw.integers(len(options)))]


def reworded(kind: int, piece: str, draw: np.random.Generator) -> str:
    """A piece like the given one: other letters and digits, and about half the time another way to write its signs."""
    number = "".join(str(draw.integers(10)) if c.isdigit() else c for c in piece)
    plain = draw.random() < 0.4
    if kind == 0:
        name, _, host = number.partition("@")
        name = "".join(_one(draw, string.ascii_lowercase) if c.isalpha() else c for c in name)
        if draw.random() < 0.5:
            name = _letters(draw, 2, 9) + _one(draw, ["", ".", "_", "-"]) + _one(draw, [_letters(draw, 2, 9), str(draw.integers(100))])
        if draw.random() < 0.6:
            host = ".".join([*[_letters(draw, 2, 10) for _ in range(draw.integers(1, 3))], _one(draw, DOMAINS)])
        at, dot = "@", "."
        if not plain:
            at = _one(draw, [" at ", "(at)", " (at) ", "[at]", " [at] ", " @ ", "{at}", " AT ", "[@]", "＠"])
            dot = _one(draw, [" dot ", "(dot)", " (dot) ", "[dot]", " [dot] ", ".", " . ", "[.]", ".", " DOT "])
        return name.replace(".", dot if draw.random() < 0.3 else ".") + at + host.replace(".", dot)
    if kind == 1:
        parts = [str(draw.integers(256)) for _ in range(4)]
        return ("." if plain else _one(draw, ["[.]", "(.)", " . ", " dot ", "[dot]", "(dot)", ". ", " ."])).join(parts)
    if kind == 2:
        digits = "".join(c for c in number if c.isdigit())
        sign = _one(draw, ["", " ", "-"]) if plain else _one(draw, [".", "  ", " - ", "_", "/", "--", ". ", "–"])
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if plain:
        return number
    digits = "".join(c for c in number if c.isdigit())
    country, rest = digits[:-10] or str(draw.integers(1, 99)), digits[-10:].rjust(10, "5")
    sign = _one(draw, ["-", ".", " ", "/", " - "])
    area = _one(draw, ["({})", "{}", "{}", "[{}]"]).replace("[{}]", "{}").format(rest[:3])
    lead = _one(draw, ["", "", "", f"{country}{sign}", f"00{country}{sign}", f"({country}) ", f"+ {country} ", f"＋{country} "])
    return lead + area + (" " if area[0] == "(" else sign) + rest[3:6] + _one(draw, [sign, "-"]) + rest[6:]


def decoy(draw: np.random.Generator) -> str:
    """Numbers and signs that are no personal data."""
    digits = lambda n: "".join(str(d) for d in draw.integers(0, 10, n))
    return _one(
        draw,
        [
            f"{draw.integers(1900, 2100)}-{draw.integers(10, 13)}-{draw.integers(10, 29)}", f"{digits(2)}:{digits(2)}:{digits(2)}",
            f"{digits(2)}.{digits(2)}.{draw.integers(1900, 2100)}", f"{draw.integers(9)}.{draw.integers(20)}.{draw.integers(20)}",
            f"{draw.integers(100)}.{digits(3)}", f"${draw.integers(1, 999)},{digits(3)}.{digits(2)}", digits(draw.integers(1, 9)),
            "".join(draw.choice(list("0123456789abcdef"), draw.integers(8, 40))), f"{_letters(draw, 2, 8)}{digits(2)}",
            f"{digits(3)}-{digits(1)}", f"{draw.integers(100)}%", f"look at {_letters(draw, 2, 6)}. dot", f"at {_letters(draw, 2, 8)}, {digits(2)}",
            f"@{_letters(draw, 2, 8)}", f"p. {digits(3)}", f"{_letters(draw, 2, 8)} at {_letters(draw, 2, 8)}. {_letters(draw, 2, 8)}",
            f"{draw.integers(10)}, {draw.integers(10)}, {draw.integers(10)}", f"{digits(4)}/{digits(2)}", f"({draw.integers(1900, 2100)})",
        ],
    )


def examples(
    pieces: Sequence[tuple[int, str]], prose: Sequence[str], count: int = EXAMPLES, width: int = WINDOW, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and their tags: reworded pieces of all kinds alike, decoys, and prose around them."""
    draw = np.random.default_rng(seed)
    of_kind = [[p for k, p in pieces if k == kind] for kind in range(len(KINDS))]
    there = [k for k, p in enumerate(of_kind) if p]
    prose = list(prose) or [" "]
    x, y = np.empty((count, width), np.uint8), np.zeros((count, width), np.int64)
    for n in range(count):
        text, marks = _one(draw, prose), []
        text = text[int(draw.integers(max(len(text) // 3, 1))) :]
        for _ in range(int(draw.integers(1, 3)) if draw.random() < 0.9 else 0):
            at = int(draw.integers(0, max(min(len(text), width - 40), 1)))
            at = text.rfind(" ", 0, at) + 1 if draw.random() < 0.8 else at
            if any(a <= at <= z for _, a, z in marks):
                continue
            kind = _one(draw, there) if there and draw.random() < 0.75 else None
            inner = decoy(draw) if kind is None else reworded(kind, _one(draw, of_kind[kind]), draw)
            before = _one(draw, ["", " ", "(", ": ", ", ", "\n", "<"]) if at and text[at - 1] != " " else _one(draw, ["", "", "tel ", "mail: ", "<", '"'])
            if at and not before and text[at - 1].isalnum():
                before = " "
            after = _one(draw, [" ", " ", ". ", ", ", ")", "\n", "; ", ">", '" '])
            start = at + len(before)
            text = text[:at] + before + inner + after + text[at:]
            shift = len(before + inner + after)
            marks = [(k, a + shift, z + shift) if a >= at else (k, a, z) for k, a, z in marks]
            if kind is not None:
                marks.append((kind, start, start + len(inner)))
        text = text[:width].ljust(width)
        x[n] = tagger.encode(text)[:width]
        for kind, a, z in marks:
            if z <= width:
                y[n, a], y[n, a + 1 : z] = 1 + 2 * kind, 2 + 2 * kind
            else:  # cut by the window's end: not shown
                x[n, a:] = tagger.encode(" ")[0]
    return x, y


def labelled_pieces(docs: DataFrame, documents: int = DOCUMENTS) -> tuple[list[tuple[int, str]], list[str]]:
    """Labelled spans (kind, text) and prose without any, from at most about ``documents`` texts by hash.

    At most ``PIECES`` pieces of a kind and ``PROSE`` stretches of 160 characters go to the driver; which, depends
    on hashes of the texts alone. Equal pieces count once.
    """
    share = min(1.0, documents / max(docs.count(), 1))
    some = docs.where(F.col("text").isNotNull()).select("text", hash_of(F.col("text"), digits=8).alias("key"))
    some = some.where(F.col("key") < share * F.lit(16**8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, key in zip(b["text"], b["key"]):
                spans = base_spans(text)
                rows += [(k, text[a:z], key) for k, a, z in spans if z - a <= 64]
                at = key % max(len(text) - 160, 1)
                if not any(a < at + 160 and z > at for _, a, z in spans):
                    rows.append((-1, text[at : at + 160], key))
            yield pd.DataFrame(rows, columns=["kind", "piece", "key"])

    found = some.mapInPandas(run, "kind int, piece string, key long").groupBy("kind", "piece").agg(F.min("key").alias("key"))
    chosen = []
    for kind in range(-1, len(KINDS)):
        of = found.where(F.col("kind") == kind).orderBy(F.xxhash64("piece"), "piece").limit(PROSE if kind < 0 else PIECES)
        chosen.append([(kind, r["piece"]) for r in of.collect()])
    return [p for c in chosen[1:] for p in c], [p for _, p in chosen[0]]


def train(docs: DataFrame, seed: int = 0, **options) -> tagger.Tagger | None:
    """A tagger from the spans that patterns find in ``docs``; None if there are none."""
    pieces, prose = labelled_pieces(docs)
    if not pieces:
        return None
    x, y = examples(pieces, prose, seed=seed)
    return tagger.Tagger(tagger.fit(x, y, seed=seed, **options))


def trimmed(text: str, span: Span) -> Span:
    """Without blanks and signs at the ends that belong to the sentence; a phone number keeps or gets its bracket."""
    kind, a, z = span
    first = "+＋(" if kind == KINDS.index("phone") else ""
    while a < z and not (text[a].isalnum() or text[a] in first):
        a += 1
    while z > a and not text[z - 1].isalnum():
        z -= 1
    if first and a and text[a - 1] == "(" and text[a:z].count(")") > text[a:z].count("("):
        a -= 1
    return kind, a, z


def all_spans(texts: Sequence[str], model: tagger.Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """What patterns find in each whole text, and what the tagger adds beside it."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if model is not None:
        for i, found in enumerate(tagger.tag(model, texts)):
            kept = []
            for kind, a, z, score in found:
                span = trimmed(texts[i], (kind, a, z))
                if plausible(kind, texts[i][span[1] : span[2]]):
                    kept.append((*span, score))
            added[i] = tagger.reconcile(kept, base[i])
    return list(zip(base, added))


def find(docs: DataFrame, model: tagger.Tagger | None) -> DataFrame:
    """``doc_id`` with the spans of every whole text: n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are of what the patterns find (see ``pii_rules``), which always stays. ``spans`` has these
    and what the tagger adds: it reads every text in overlapping windows; pieces that are of their kind once written-out
    signs are put back, and that touch nothing found by pattern, are reconciled over the whole text.

    Null and empty texts have no span. Rows are scored one by one, so repeated rows and ids, null ids and ties make no
    difference; an empty table gives an empty result. Very long texts are read window by window. Other columns are
    ignored. Without a model nothing is added.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = ["" if t is None else t for t in b["text"]]
            start = 0
            while start < len(texts):
                end, held = start, 0
                while end < len(texts) and (end == start or held + len(texts[end]) <= CHARACTERS):
                    held += len(texts[end])
                    end += 1
                rows = []
                for base, added in all_spans(texts[start:end], sent.value):
                    counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                    digest = hashlib.sha256(text_of(base).encode()).hexdigest()
                    rows.append((*counts, digest, text_of(base + added), len(added)))
                names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "doc_id", b["doc_id"].iloc[start:end].array)
                yield out
                start = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {FOUND}")

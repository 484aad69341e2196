"""Byte-level BPE encoding and decoding in linear time, exact to the merges of a rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from struct import pack

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

RESULT = "n_tokens long, ids binary, decoded binary"
CACHED_PIECES, CACHED_PAIRS, CACHED_BYTES = 400_000, 500_000, 48

# Letters, then digits and numbers, that Unicode has had since version 17. The
# library whose ids are wanted has the tables of version 16, where they are neither.
NEWER_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    r"\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    r"\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NEWER_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
NEWER = re.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}]")


def _older(pattern: str) -> str:
    """The pattern with letters and numbers as of Unicode 16 (set differences of the regex module's V1)."""
    newer = NEWER_LETTERS + NEWER_NUMBERS
    return pattern.replace(r"\p{L}", rf"[\p{{L}}--[{newer}]]").replace(r"\p{N}", rf"[\p{{N}}--[{newer}]]")


class _Pieces(dict):
    """Encoded pieces as packed ids; computed when missing.

    When half full, what was not used since the last time goes: frequent pieces stay.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHED_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file (base64 token, rank) and one split pattern.

    A piece of text that is itself a token is that token. Else it is encoded from left to right:
    the longest token that may follow the last one is taken (a trie of Latin-1 strings, one character a
    byte, says how long it can be); where none may, the last token is given up for a shorter one
    and the position is marked, so it is not tried again. Two tokens
    may stand side by side if merging their joined bytes gives these two again, which is
    remembered per pair. A sequence whose neighbours all agree is the sequence that the merges
    would give, so no merge is ever run over a whole piece.
    """

    def __init__(self, ranks: bytes, pattern: str):
        self.rank_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bytes_of = {rank: token for token, rank in self.rank_of.items()}
        self.longest = max(map(len, self.rank_of))
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank_of.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.split = regex.compile(pattern).findall
        self.split_older = regex.compile(_older(pattern), regex.V1).findall
        self.halves_of: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self._piece)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a byte, None if no merges lead to it."""
        if token not in self.halves_of:
            parts = [self.bytes_of[token][i : i + 1] for i in range(len(self.bytes_of[token]))]
            last = tuple(parts * 2)
            while len(parts) > 1:
                ranks = [self.rank_of.get(a + b, -1) for a, b in zip(parts, parts[1:])]
                best = min((r for r in ranks if r >= 0), default=None)
                if best is None:
                    break
                at = ranks.index(best)
                last = tuple(parts[at : at + 2])
                parts[at : at + 2] = [last[0] + last[1]]
            self.halves_of[token] = (self.rank_of[last[0]], self.rank_of[last[1]]) if len(parts) == 1 else None
        return self.halves_of[token]

    def agree(self, first: int, second: int) -> bool:
        """Whether the merges of the two tokens' joined bytes end in these two; remembered.

        Merges are undone from the last on, at the seam. Before each, the neighbours at the seam
        must not have a merge of their own that comes earlier than the one that took one of them
        away; of two equal merges the left one comes first.
        """
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        left, right, until = first, second, len(self.rank_of) + 1
        known = self.halves(first) is not None and self.halves(second) is not None
        while known:
            merge = self.rank_of.get(self.bytes_of[left] + self.bytes_of[right])
            if merge is not None and merge < until:
                known = False
                break
            left_whole, right_whole = len(self.bytes_of[left]) == 1, len(self.bytes_of[right]) == 1
            if left_whole and right_whole:
                break
            if right_whole or not left_whole and left > right:
                until, left = left, self.halves(left)[1]
            else:
                until, right = right + 1, self.halves(right)[0]
        self.pairs[first, second] = known
        return known

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        rank_of, pairs = self.rank_of, self.pairs
        whole = rank_of.get(data)
        if whole is not None:
            return pack("<I", whole)
        text, size, longest = data.decode("latin-1"), len(data), self.longest
        dead = bytearray(size + 1)
        tokens: list[int] = []
        starts: list[int] = []
        position, end = 0, -1
        while position < size:
            if end < 0:  # the longest token here is no longer than the longest path of the trie
                end = position + self.automaton.longest_prefix(text[position : position + longest])
            while end > position:
                token = rank_of.get(data[position:end])
                if token is not None and not dead[end]:
                    if not tokens:
                        break
                    fits = pairs.get((tokens[-1], token))
                    if self.agree(tokens[-1], token) if fits is None else fits:
                        break
                end -= 1
            if end > position:
                tokens.append(token)
                starts.append(position)
                position, end = end, -1
            else:
                dead[position] = 1
                tokens.pop()
                end = position - 1
                position = starts.pop()
        return pack(f"<{len(tokens)}I", *tokens)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        split = self.split if text.isascii() or not NEWER.search(text) else self.split_older
        return b"".join(map(self.pieces.__getitem__, split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[int, str], Codec] = {}


def codec_of(ranks: bytes, pattern: str) -> Codec:
    """One codec per Python worker, kept for its next tasks."""
    key = (hash(ranks), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def round_trip(spark: SparkSession, rank_file: str, pattern: str) -> Callable[[Column], Column]:
    """A function of a text column: struct of n_tokens, ids (packed, see ``Codec.encode``) and decoded bytes.

    The rank file, of a fixed size, is read on the driver and broadcast. Null texts count as
    empty: no ids, no bytes. Texts of any length are encoded whole, a piece of any length in
    linear time. Special tokens have no part in it, their spelling is ordinary text.
    """
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(ranks.value, pattern)
        for texts in batches:
            ids = [codec.encode(t) if t else b"" for t in texts]
            yield pd.DataFrame(
                {"n_tokens": [len(i) // 4 for i in ids], "ids": ids, "decoded": [codec.decode(i) for i in ids]}
            )

    return run

"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import unicodedata
import warnings
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.labelled import held_out, sample
from riskloom.sources.staging import release, stage

PER_CLASS = 4_000
PREFIXES = (3, 4, 5, 6, 7)  # beginnings of so many letters can be entries
LEAST_RATIO = 4.0
FALSE_SHARE = 0.001  # of the entries, expected to be chance; near copies are no independent evidence, so it is small

# Look-alikes of Latin letters: Cyrillic, Greek, and digits or signs written for letters.
LOOK_ALIKE = dict(zip("авекмнорстухіѕјԁһɡαβεικνορτυχω", "abekmhopctyxisjdhgabeikvoptuxw")) | dict(
    zip("0134578@$€", "oieastbase")
)


def _fold_table() -> dict[int, str | None]:
    """One character for each: look-alikes as Latin letters, marks and invisible ones none, signs a blank."""
    table: dict[int, str | None] = {}
    for code in range(0x3000):
        char = chr(code)
        kind = unicodedata.category(char)
        if char in LOOK_ALIKE:
            table[code] = LOOK_ALIKE[char]
        elif kind in ("Mn", "Me", "Cf"):
            table[code] = None
        elif kind[0] not in "LN":
            table[code] = " "
    for code in range(0xFF01, 0xFF5F):  # full width
        char = chr(code - 0xFEE0)
        table[code] = LOOK_ALIKE.get(char.lower(), char.lower() if char.isalnum() else " ")
    for code in (0xFEFF, 0x3000, 0x3001, 0x3002):
        table[code] = None if code == 0xFEFF else " "
    return table


FOLD = _fold_table()


def fold(text: str | None) -> str:
    """Lower case, look-alikes as Latin letters, loose marks and invisible characters gone, words between single blanks."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return f" {' '.join(text.translate(FOLD).split())} "


def terms(text: str | None) -> dict[str, int]:
    """Entries that a text speaks for, its words and their beginnings, and how many words do."""
    found: Counter[str] = Counter()
    for word, n in Counter(fold(text).split()).items():
        found[f" {word} "] += n
        for size in PREFIXES:
            if len(word) > size:
                found[f" {word[:size]}"] += n
    return found


@F.pandas_udf(
    T.StructType(
        [
            T.StructField("term", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.IntegerType())),
            T.StructField("words", T.IntegerType()),
        ]
    )
)
def _terms(texts: pd.Series) -> pd.DataFrame:
    found = [terms(t) for t in texts]
    words = [sum(n for t, n in f.items() if t[-1] == " ") for f in found]
    return pd.DataFrame({"term": [list(f) for f in found], "times": [list(f.values()) for f in found], "words": words})


@dataclass
class Lexicon:
    """Entries with weights: `` word `` is a whole word, `` word`` without the last blank a beginning.

    Within an exception phrase (given as words) no entry counts.
    """

    weights: dict[str, float]
    exceptions: Sequence[str] = ()
    calibration: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])

    def __post_init__(self):
        self.automaton = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def __setstate__(self, state):
        self.__dict__.update(state, automaton=None)

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the entries found outside exception phrases."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self.automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                entry = fold(phrase)
                if entry.strip():
                    self.automaton.add_word(entry, (len(entry), None))
            self.automaton.make_automaton()
        if not len(self.automaton):
            return []
        found = [(end + 1 - n, end + 1, w) for end, (n, w) in self.automaton.iter(folded)]
        spared = [(a, z) for a, z, w in found if w is None]
        if not spared:
            return found
        return [(a, z, w) for a, z, w in found if w is not None and not any(x <= a and z <= y for x, y in spared)]

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """The weights of all hits added up, and that per hundred words (on log scales); the largest weight."""
        folded = fold(text)
        weights = [w for _, _, w in self.hits(folded)]
        total = sum(weights)
        return math.log1p(total), math.log1p(100 * total / max(folded.count(" ") - 1, 1)), max(weights, default=0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.calibration[0] + x @ np.array(self.calibration[1:]), -50, 50)))


def chance(a: int, n: int, share: float) -> float:
    """How likely at least ``a`` of ``n`` documents would be toxic if each were with probability ``share``."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(a, n + 1)]
    return min(1.0, math.fsum(math.exp(x) for x in logs))


def discoveries(counts: dict[tuple[int, int], int], share: float, false_share: float) -> tuple[set[tuple[int, int]], float]:
    """The (toxic, all) document counts whose terms are entries, and what their weights are multiplied by.

    ``counts`` says how many terms have them. Terms are accepted from the least likely on while the expected share
    of false ones among them stays below ``false_share`` (Benjamini and Hochberg). With too few documents for that,
    the least likely ones are taken at half weight, if chance gives a single one less often than one time in a hundred.
    """
    tested, passed, accepted = sum(counts.values()), 0, set()
    ranked = sorted((chance(a, n, share), a, n) for a, n in counts if a > share * n)
    taken = 0.0
    for p, a, n in ranked:
        passed += counts[a, n]
        if p * tested <= false_share * passed:
            taken = p
    accepted = {(a, n) for p, a, n in ranked if p <= taken}
    if accepted or not ranked or ranked[0][0] > 0.01:
        return accepted, 1.0
    return {(a, n) for p, a, n in ranked if p <= ranked[0][0]}, 0.5


def learn(rows: DataFrame, exceptions: Sequence[str] = (), false_share: float = FALSE_SHARE) -> tuple[Lexicon, int, int]:
    """Entries whose documents are labelled toxic beyond chance; counts of toxic and clean documents.

    For each word or beginning in at least three documents, the documents of either class that hold it and its occurrences
    there are counted. It is an entry if it is ``LEAST_RATIO`` times as frequent in toxic documents and is among the
    ``discoveries``. The weight is the log ratio of the frequencies. Of an entry and a beginning of it the less
    likely one is kept, of equals the longer. Their number is bounded by the terms of the sample, all that pass are kept.
    """
    held = rows.select(_terms("text").alias("t"), "label")
    toxic, clean, toxic_words, clean_words = held.agg(
        F.coalesce(F.sum("label"), F.lit(0)), F.count_if(F.col("label") == 0),
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("t.words"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("t.words"))), F.lit(0)),
    ).first()
    if not toxic or not clean:
        return Lexicon({}, exceptions), toxic, clean
    counted = (
        held.select(F.explode(F.arrays_zip("t.term", "t.times")).alias("x"), "label")
        .groupBy(F.col("x.term").alias("term"))
        .agg(
            F.sum("label").alias("a"), F.count("*").alias("n"),
            F.sum(F.when(F.col("label") == 1, F.col("x.times")).otherwise(0)).alias("times_toxic"),
            F.sum(F.when(F.col("label") == 0, F.col("x.times")).otherwise(0)).alias("times_clean"),
        )
        .where("n >= 3")
    )
    counted = stage(counted, "toxicity-terms")
    share = toxic / (toxic + clean)
    counts = {(r["a"], r["n"]): r["count"] for r in counted.groupBy("a", "n").count().collect()}
    accepted, factor = discoveries(counts, share, false_share)
    spark = rows.sparkSession
    likely = spark.createDataFrame([(a, n, chance(a, n, share)) for a, n in accepted], "a long, n long, p double")
    ratio = ((F.col("times_toxic") + 0.5) / (toxic_words + 1)) / ((F.col("times_clean") + 0.5) / (clean_words + 1))
    best = counted.join(F.broadcast(likely), ["a", "n"]).where(ratio >= LEAST_RATIO)
    best = best.select("term", "p", F.least(F.log(ratio), F.lit(8.0)).alias("weight")).collect()
    kept: dict[str, float] = {}
    beginnings: set[str] = set()
    for r in sorted(best, key=lambda r: (r["p"], -len(r["term"]), r["term"])):
        term = r["term"]
        shorter = [term[: n + 1] for n in PREFIXES if n + 1 < len(term)]
        if term not in beginnings and not any(t in kept for t in shorter):
            kept[term] = r["weight"] * factor
            beginnings.update(shorter)
    release(spark, counted)
    return Lexicon(kept, exceptions), toxic, clean


def learned_exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases around hits that clean documents alone hold, too often for chance."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def phrases(texts: pd.Series) -> pd.Series:
        def of(text):
            folded = fold(text)
            found = set()
            for start, end, _ in lexicon.hits(folded):
                stop = folded.index(" ", max(end - 1, start + 1))
                word = folded[start + 1 : stop]
                before, after = folded[:start].rpartition(" ")[2], folded[stop + 1 :].partition(" ")[0]
                found.update(p for p in (f"{before} {word}" if before else "", f"{word} {after}" if after else "") if p)
            return list(found)

        return texts.map(of)

    toxic, clean = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count_if(F.col("label") == 0)).first()
    counted = rows.select(F.explode(phrases("text")).alias("phrase"), "label").groupBy("phrase")
    counted = stage(counted.agg(F.sum("label").alias("a"), F.count("*").alias("n")).where("n >= 3"), "toxicity-phrases")
    tested = max(counted.count(), 2)
    # a phrase that toxic documents hold as often as clean ones would be all clean this rarely
    chance = F.col("n") * float(-np.log(clean / (toxic + clean)))
    benign = counted.where((F.col("a") == 0) & (chance >= float(np.log(tested))))
    found = [r["phrase"] for r in benign.orderBy(F.desc("n"), "phrase").collect()]
    release(rows.sparkSession, counted)
    return found


def calibrate(lexicon: Lexicon, rows: DataFrame, share_toxic: float) -> None:
    """Fit the logistic curve from evidence to the label, each class weighted by its true share."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def evidence(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(lexicon.evidence(t)))

    data = rows.select(evidence("text").alias("x"), "label").collect()
    y = np.array([r["label"] for r in data], float)
    x = np.array([[1.0, *r["x"]] for r in data]).reshape(len(data), 4)
    ones = max(y.sum(), 1)
    weight = np.where(y == 1, share_toxic / ones, (1 - share_toxic) / max(len(y) - ones, 1)) * len(y)
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (weight * (y - p)) - 0.1 * w
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), gradient)
    lexicon.calibration = [float(v) for v in w]


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS,
    exceptions: Sequence[str] = (),
) -> Lexicon:
    """A calibrated lexicon from labels outside the held-out fold, on about ``per_class`` documents of each class.

    Equal texts with equal labels count once, rows that repeat an id count as one document (the smallest text).
    Empty tables, or labels of one class only, give an empty lexicon: all texts score alike, and a warning says
    so. Columns other than ids, texts and labels are ignored, whatever their names.
    """
    share = labels.where(~held_out() & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    if share is None:
        return Lexicon({}, exceptions)
    chosen = stage(sample(docs, labels, label, per_class).distinct(), "toxicity-sample")
    lexicon, _, _ = learn(chosen, exceptions)
    if not lexicon.weights:
        warnings.warn("no term tells toxic from clean documents: all texts will score alike", stacklevel=2)
    if lexicon.weights:
        spared = [*exceptions, *learned_exceptions(chosen, lexicon)]
        lexicon = Lexicon(lexicon.weights, spared)
    calibrate(lexicon, chosen, float(share))
    release(chosen.sparkSession, chosen)
    return lexicon


def scorer(lexicon: Lexicon) -> Column:
    """The score of column ``text``: 0 to 1. Null and empty texts have no evidence.

    A text's score depends on it alone, so repeated rows score alike; whole texts are read, however long.
    An empty table gives no rows; other columns are not looked at.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([lexicon.evidence(t) for t in texts]).reshape(len(texts), 3)
            yield pd.Series(lexicon.score(x))

    return score("text")

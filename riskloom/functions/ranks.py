"""Exact order statistics without sorting a table or holding it in one task.

A rank is found by narrowing: count rows per value range (summed up before the shuffle, a
bounded number of ranges), look up which range holds the rank, and count again inside it.
A value that fills a third of a column is just one large count.  A small random sample tells
where to look first; it only saves work, as the counts show whether the rank is there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 1024
# sampled rows, and how far around the middle of the sample to look first
GUIDE_ROWS = 50_000
GUIDE_MARGIN = 0.01


@dataclass(frozen=True)
class ColumnStats:
    """Statistics of the non-null, finite values of a column."""

    rows: int
    nulls: int
    minimum: float | None
    maximum: float | None
    mean: float | None
    variance: float | None
    median: float | None = None

    def imputed_mean(self, fill: float) -> float:
        """Mean once nulls are replaced by ``fill``."""
        if not self.rows:
            return fill
        known = self.rows - self.nulls
        return ((self.mean or 0.0) * known + fill * self.nulls) / self.rows

    def imputed_std(self, fill: float) -> float:
        """Population standard deviation once nulls are replaced by ``fill``."""
        if not self.rows:
            return 0.0
        centre = self.imputed_mean(fill)
        known = self.rows - self.nulls
        spread = known * ((self.variance or 0.0) + ((self.mean or 0.0) - centre) ** 2)
        spread += self.nulls * (fill - centre) ** 2
        return math.sqrt(spread / self.rows)


def round_significant(value: float | None, digits: int = 12) -> float | None:
    """Drop the last digits, which depend on the order in which partial sums arrive."""
    return None if value is None else float(f"{value:.{digits - 1}e}")


def column_stats(df: DataFrame, columns: list[str]) -> dict[str, ColumnStats]:
    """Count, nulls, min, max, mean, population variance and exact median per column.

    The columns have to be doubles without NaN or infinities.
    """
    if not columns:
        return {}
    wanted = [F.count(F.lit(1))]
    for name in columns:
        wanted += [F.count(name), F.min(name), F.max(name), F.avg(name), F.var_pop(name)]
    row = list(df.agg(*[c.alias(f"s{i}") for i, c in enumerate(wanted)]).first())
    total, rest = row[0], row[1:]
    stats = {}
    for index, name in enumerate(columns):
        known, low, high, mean, variance = rest[5 * index : 5 * index + 5]
        stats[name] = ColumnStats(total, total - known, low, high, mean, variance)
    medians = _narrowed_medians(df, stats)
    return {
        name: ColumnStats(
            s.rows, s.nulls, s.minimum, s.maximum,
            round_significant(s.mean), round_significant(s.variance), medians[name],
        )
        for name, s in stats.items()
    }


def exact_ranks(df: DataFrame, column: Column, ranks: list[int]) -> list[float]:
    """The values at 0-based ranks of an expression that is finite in every row."""
    values = df.select(column.cast("double").alias("v"))
    n, least, most = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    return _select_ranks(values, {"v": ColumnStats(n, 0, least, most, None, None)}, {"v": ranks})["v"]


def exact_median(df: DataFrame, column: Column) -> float | None:
    """Median of an expression, halfway between the middle two for an even count.

    Infinities take part in the ranking.
    """
    low, high = float("-inf"), float("inf")
    # infinite values are ranked by count alone, the ranges hold finite ones
    values = df.select(column.cast("double").alias("v")).where("v is not null")
    below = F.count_if(F.col("v") == low)
    above = F.count_if(F.col("v") == high)
    finite = F.when((F.col("v") > low) & (F.col("v") < high), F.col("v"))
    n, n_low, n_high, least, most = values.agg(
        F.count("v"), below, above, F.min(finite), F.max(finite)
    ).first()
    if not n:
        return None
    stats = {"v": ColumnStats(n, 0, least, most, None, None)}
    ranks = {"v": [(n - 1) // 2, n // 2]}
    picked = []
    inner = []
    for rank in ranks["v"]:
        if rank < n_low:
            picked.append(low)
        elif rank >= n - n_high:
            picked.append(high)
        else:
            inner.append(rank - n_low)
    if inner:
        bounded = values.where((F.col("v") > low) & (F.col("v") < high))
        picked += _select_ranks(bounded, stats, {"v": inner})["v"]
    picked.sort()
    return picked[0] if picked[0] == picked[-1] else (picked[0] + picked[-1]) / 2


def _narrowed_medians(df: DataFrame, stats: dict[str, ColumnStats]) -> dict[str, float | None]:
    ranks = {}
    for name, s in stats.items():
        known = s.rows - s.nulls
        ranks[name] = [(known - 1) // 2, known // 2] if known else []
    found = _select_ranks(df, stats, ranks)
    return {
        name: sum(values) / len(values) if values else None for name, values in found.items()
    }


@dataclass(frozen=True)
class _Search:
    """Ranks looked for among the values of a column from ``low`` to ``high``."""

    column: str
    low: float
    high: float
    below: int
    ranks: tuple[int, ...]
    whole: bool = False

    def inside(self) -> Column:
        return F.col(self.column).between(self.low, self.high)

    def part(self) -> Column:
        """Which of the ranges a value falls into; never decreasing with the value."""
        value, low, high = F.col(self.column), self.low, self.high
        low_at = math.copysign(math.log1p(abs(low)), low)
        high_at = math.copysign(math.log1p(abs(high)), high)
        if self.whole and low_at < high_at:
            # long tails are common in a whole column: spread by size, keeping the sign
            sized = F.signum(value) * F.log1p(F.abs(value))
            place = (sized - F.lit(low_at)) / F.lit(high_at - low_at)
        else:
            place = (value * 0.5 - F.lit(low * 0.5)) / F.lit(high * 0.5 - low * 0.5)
        number = F.floor(place * RANGES)
        return F.least(F.greatest(number, F.lit(0)), F.lit(RANGES - 1))


def _first_searches(
    df: DataFrame, stats: dict[str, ColumnStats], ranks: dict[str, list[int]]
) -> list[_Search]:
    """Searches around the middle of a sample, or over a whole column if a rank is not there."""
    names = list(stats)
    rows = max(s.rows for s in stats.values())
    sample = df.where(F.rand(42) < F.lit(GUIDE_ROWS / max(rows, 1)))
    ends = F.array(F.lit(0.5 - GUIDE_MARGIN), F.lit(0.5 + GUIDE_MARGIN))
    guides = sample.agg(*[F.percentile(n, ends).alias(f"g{i}") for i, n in enumerate(names)]).first()
    guesses = {name: guide for name, guide in zip(names, guides) if guide}
    counts = []
    for name, (low, high) in guesses.items():
        counts.append(F.count_if(F.col(name) < low))
        counts.append(F.count_if(F.col(name).between(low, high)))
    found = list(df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()) if counts else []
    searches = []
    for name in names:
        wanted = tuple(sorted(set(ranks[name])))
        whole = _Search(name, stats[name].minimum, stats[name].maximum, 0, wanted, True)
        if name in guesses:
            index = 2 * list(guesses).index(name)
            below, inside = found[index], found[index + 1]
            if below <= wanted[0] and wanted[-1] < below + inside:
                whole = _Search(name, *guesses[name], below, wanted)
        searches.append(whole)
    return searches


def _select_ranks(
    df: DataFrame, stats: dict[str, ColumnStats], ranks: dict[str, list[int]]
) -> dict[str, list[float]]:
    """The values at 0-based ranks of each column; one counting job narrows all of them."""
    found: dict[str, dict[int, float]] = {name: {} for name in stats}
    wanted = {name: s for name, s in stats.items() if ranks[name]}
    searches = _first_searches(df, wanted, ranks) if wanted else []
    while searches:
        for search in searches:
            if search.low == search.high:
                found[search.column].update(dict.fromkeys(search.ranks, search.low))
        searches = [search for search in searches if search.low < search.high]
        if searches:
            searches = _narrow(searches, _count_parts(df, searches), found)
    return {name: [found[name][rank] for rank in ranks[name]] for name in stats}


def _count_parts(df: DataFrame, searches: list[_Search]) -> list:
    """Rows, least and greatest value per part: at most RANGES rows per search."""
    entries = [
        F.when(
            search.inside(),
            F.struct(
                F.lit(number).alias("search"),
                search.part().alias("part"),
                F.col(search.column).alias("v"),
            ),
        )
        for number, search in enumerate(searches)
    ]
    any_inside = reduce(lambda left, right: left | right, [s.inside() for s in searches])
    rows = df.where(any_inside).select(F.explode_outer(F.array_compact(F.array(*entries))).alias("e"))
    return (
        rows.select("e.*")
        .groupBy("search", "part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .orderBy("search", "part")
        .collect()
    )


def _narrow(searches: list[_Search], parts: list, found: dict) -> list[_Search]:
    """Settle the ranks that the counted parts decide; returns what is left to look for."""
    following = []
    for number, search in enumerate(searches):
        below = search.below
        for part in (p for p in parts if p["search"] == number):
            left = []
            for rank in search.ranks:
                if not below <= rank < below + part["n"]:
                    continue
                if rank == below:
                    found[search.column][rank] = part["low"]
                elif rank == below + part["n"] - 1:
                    found[search.column][rank] = part["high"]
                else:
                    left.append(rank)
            if left:
                following.append(
                    _Search(search.column, part["low"], part["high"], below, tuple(left))
                )
            below += part["n"]
    return following

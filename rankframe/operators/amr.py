"""Threshold search: bisect an error threshold until so many elements fall on its side.

Elements are counted for all thresholds that the next LEVELS steps of the bisection may ask for in one pass, so
the table is read once for several steps, and each pass brings one row to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from rankframe.operators.stats import summarize

#: Steps of the bisection that one pass over the table decides.
LEVELS = 5

#: From a column and a threshold, how much an element adds to the count (a number, or null for nothing).
Counter = Callable[[Column, float], Column]


def below(err: Column, threshold: float) -> Column:
    """Elements whose error is less than the threshold."""
    return F.when(err < threshold, 1)


def from_on(err: Column, threshold: float) -> Column:
    """Elements whose error is the threshold or more."""
    return F.when(err >= threshold, 1)


@dataclass(frozen=True)
class Found:
    threshold: float
    count: int
    estimate: int
    steps: int


def error_statistics(df: DataFrame, err: str, rank: str) -> DataFrame:
    """One row: the statistics of the errors; thresholds start at their least and greatest."""
    return summarize(df, [], err, rank)


def specify(df: DataFrame, err: str, threshold: float, counter: Counter = below, refine: int = 0) -> Found:
    """The count at a given threshold, and the elements that coarsening it leaves."""
    got = df.agg(F.count(err).alias("n"), F.coalesce(F.sum(counter(F.col(err), threshold)), F.lit(0)).alias("c")).first()
    return Found(threshold, int(got["c"]), int(got["n"]) + refine - int(got["c"]), 0)


def _tree(at: float, low: float, high: float, levels: int) -> list[float]:
    """at, and the midpoints that bisection between low and high may ask for after it, in as many levels."""
    if not levels:
        return []
    return [at, *_tree((low + at) / 2.0, low, at, levels - 1), *_tree((at + high) / 2.0, at, high, levels - 1)]


def _search(df: DataFrame, err: str, at: float, low: float, high: float, steps: int, counter: Counter, judge: Callable[[int, int], int]) -> tuple[float, int, int]:
    """(threshold, count, steps); judge(count, step) is -1 to go lower, 1 to go higher, 0 to stop."""
    known: dict[float, int] = {}
    for step in range(steps + 1):
        if at not in known:
            asked = list(dict.fromkeys(_tree(at, low, high, LEVELS)))
            row = df.agg(*[F.coalesce(F.sum(counter(F.col(err), t)), F.lit(0)).alias(f"c{i}") for i, t in enumerate(asked)]).first()
            known |= {t: int(row[f"c{i}"]) for i, t in enumerate(asked)}
        side = judge(known[at], step)
        if step == steps or not side:
            return at, known[at], step
        low, high = (low, at) if side < 0 else (at, high)
        nxt = (low + high) / 2.0
        at = nxt
    raise AssertionError


def coarsen_search(df: DataFrame, err: str, least_total: int, highest: float, window: float, steps: int, counter: Counter = below, refine: int = 0) -> Found:
    """The threshold below ``highest`` at which total + refine - count lies in [least_total, least_total / window], by at most so many steps.

    Nothing is coarsened if that many elements are not there to begin with, or if highest is not above the
    least error; and if coarsening at highest leaves too many, that is the answer.
    """
    got = df.agg(F.count(err).alias("n"), F.min(err).alias("lo")).first()
    total, low = got["n"] + refine, got["lo"]
    if low is None or low >= highest or total <= least_total:
        return Found(low, 0, total, 0)
    most_total = int(least_total / window)

    def judge(count: int, step: int) -> int:
        left = total - count
        return -1 if left < least_total else (0 if step == 0 else 1) if left > most_total else 0

    at, count, step = _search(df, err, float(highest), float(low), float(highest), steps, counter, judge)
    return Found(at, count, total - count, step)


def refine_search(df: DataFrame, err: str, most_total: int, lowest: float, window: float, steps: int, counter: Counter = from_on, coarsen: int = 0) -> Found:
    """The threshold above ``lowest`` at which total - coarsen + count lies in [window * most_total, most_total]. As coarsen_search()."""
    got = df.agg(F.count(err).alias("n"), F.max(err).alias("hi")).first()
    total, high = got["n"] - coarsen, got["hi"]
    if high is None or lowest >= high or total >= most_total:
        return Found(high, 0, total, 0)
    least_total = int(most_total * window)

    def judge(count: int, step: int) -> int:
        left = total + count
        return 1 if left > most_total else (0 if step == 0 else -1) if left < least_total else 0

    at, count, step = _search(df, err, float(lowest), float(lowest), float(high), steps, counter, judge)
    return Found(at, count, total + count, step)

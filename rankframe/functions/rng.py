"""Counter-based random numbers: a pure function of a 64-bit counter, native in whole-stage code."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Fixed values of the generator's four rounds.
ROUND_XOR = (0xBAA96887, 0x1E17D32C, 0x03BCDC3C, 0x0F33D1B2)
ROUND_MIX = (0x4B0F3B58, 0xE874F0C3, 0x6955C5A6, 0x55A7CA46)
_M32 = 0xFFFFFFFF


def uniform(counter: Column) -> Column:
    """Uniform double in [0, 1) of a bigint counter (seed + index): a four-round Feistel network on its halves.

    The rounds are a fold over their constants, and each names its halves once: written out, they would nest into an
    expression that grows tenfold a round.
    """
    m = F.lit(_M32)

    def half(s: Column, k: Column) -> Column:
        a = s["r"].bitwiseXOR(k["x"])
        parts = F.array(F.struct(F.shiftright(a, 16).alias("hi"), a.bitwiseAND(F.lit(0xFFFF)).alias("lo")))
        # ~(hi * hi) + lo * lo modulo 2^32; products of 16-bit halves fit a bigint
        mixed = lambda p: F.struct((p["hi"] * p["lo"]).alias("p"), (F.lit(_M32) - p["hi"] * p["hi"] + p["lo"] * p["lo"]).bitwiseAND(m).alias("b"))
        turned = lambda q: (q["p"] + F.shiftleft(q["b"].bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(F.shiftright(q["b"], 16)).bitwiseXOR(k["y"])).bitwiseAND(m)
        f = F.get(F.transform(F.transform(parts, mixed), turned), F.lit(0))
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(f).alias("r"))

    start = F.struct(F.shiftrightunsigned(counter, 32).alias("l"), counter.bitwiseAND(m).alias("r"))
    rounds = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in zip(ROUND_XOR, ROUND_MIX, strict=True)])
    return F.aggregate(rounds, start, half)["r"] / F.lit(float(1 << 32))


def uniform_model(counter: int | np.ndarray) -> np.ndarray:
    """The same in numpy, for sequences whose length is random."""
    n = np.asarray(counter, dtype=np.uint64)
    left, right = n >> np.uint64(32), n & np.uint64(_M32)
    for x, y in zip(ROUND_XOR, ROUND_MIX, strict=True):
        a = right ^ np.uint64(x)
        hi, lo = a >> np.uint64(16), a & np.uint64(0xFFFF)
        b = (np.uint64(_M32) - ((hi * hi) & np.uint64(_M32)) + ((lo * lo) & np.uint64(_M32))) & np.uint64(_M32)
        c = (((b & np.uint64(0xFFFF)) << np.uint64(16)) | (b >> np.uint64(16))) ^ np.uint64(y)
        left, right = right, left ^ ((hi * lo + c) & np.uint64(_M32))
    return right / float(1 << 32)


class Streams:
    """The streams that start at many seeds, drawn from together; a stream that is done is left where it is."""

    def __init__(self, seeds: np.ndarray):
        self.at = np.asarray(seeds, dtype=np.int64).view(np.uint64).copy()

    def draw(self, rows: np.ndarray) -> np.ndarray:
        """The next number of the streams of these rows."""
        out = uniform_model(self.at[rows])
        self.at[rows] += np.uint64(1)
        return out


def normal_model(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two standard normal numbers per seed, by the polar method: pairs of numbers in the unit circle, the first that is."""
    s = Streams(seeds)
    first, second, rows = np.zeros(len(seeds)), np.zeros(len(seeds)), np.arange(len(seeds))
    while len(rows):
        u, v = 2.0 * (s.draw(rows) - 0.5), 2.0 * (s.draw(rows) - 0.5)
        q = u * u + v * v
        fine = (q > 0) & (q < 1)
        scale = np.sqrt(-2.0 * np.log(q[fine]) / q[fine])
        first[rows[fine]], second[rows[fine]] = u[fine] * scale, v[fine] * scale
        rows = rows[~fine]
    return first, second


#: From this mean on, counts are drawn by rejection (a fixed value).
REJECTION = 12.0
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def poisson_model(seeds: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """A Poisson count per seed: by products of uniform numbers for small means, else by rejection under a Lorentzian."""
    s, mean = Streams(seeds), np.asarray(mean, dtype=float)
    out = np.zeros(len(mean), dtype=np.int64)
    rows, p = np.flatnonzero(mean < REJECTION), np.ones(len(mean))
    while len(rows):  # how many numbers can be multiplied until the product is at most exp(-mean)
        p[rows] *= s.draw(rows)
        rows = rows[p[rows] > np.exp(-mean[rows])]
        out[rows] += 1
    rows = np.flatnonzero(mean >= REJECTION)
    while len(rows):
        m = mean[rows]
        t = np.tan(np.pi * s.draw(rows))
        x = np.sqrt(2.0 * m) * t + m
        inside = x >= 0
        x = np.floor(np.maximum(x, 0.0))
        log = np.log(m)
        ratio = 0.9 * (1.0 + t * t) * np.exp(x * log - _lgamma(x + 1.0) - (m * log - _lgamma(m + 1.0)))
        taken = np.zeros(len(rows), dtype=bool)
        taken[inside] = s.draw(rows[inside]) <= ratio[inside]
        out[rows[taken]] = x[taken].astype(np.int64)
        rows = rows[~taken]
    return out


#: A small probability is reached by factors of one in so many (a fixed value).
SMALL = 13.0


def small_model(seeds: np.ndarray, p: np.ndarray) -> np.ndarray:
    """1 with probability p, however small: p is scaled up by draws that go on with a chance of one in SMALL."""
    s, p = Streams(seeds), np.asarray(p, dtype=float).copy()
    out, rows = np.zeros(len(p), dtype=np.int64), np.flatnonzero(p > 0)
    while len(rows):
        tiny = p[rows] < 1.0 / SMALL
        last = rows[~tiny]
        out[last] = s.draw(last) < p[last]
        rows = rows[tiny]
        rows = rows[s.draw(rows) < 1.0 / SMALL]
        p[rows] *= SMALL
    return out


def _known(*columns: pd.Series) -> np.ndarray:
    out = np.ones(len(columns[0]), dtype=bool)
    for c in columns:
        out &= c.notna().to_numpy() & np.isfinite(c.fillna(0).to_numpy(float))
    return out


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("first", "second")]))
def normal_pair(seed: pd.Series) -> pd.DataFrame:
    """Both standard normal numbers of the stream that starts at seed; null for a null seed."""
    known = _known(seed)
    out = np.full((2, len(seed)), np.nan)
    out[:, known] = normal_model(seed[known].to_numpy(np.int64))
    return pd.DataFrame({n: pd.Series(o).astype("Float64").mask(~known) for n, o in zip(("first", "second"), out, strict=True)})


def normal(seed) -> Column:
    """Standard normal by the polar method, from the stream that starts at seed."""
    return normal_pair(seed)["first"]


@F.pandas_udf(LongType())
def poisson(seed: pd.Series, mean: pd.Series) -> pd.Series:
    """Poisson count from the stream that starts at seed; null for a null seed and for a mean that is null, negative or not finite."""
    known = _known(seed, mean)
    known &= mean.fillna(0).to_numpy(float) >= 0
    out = np.zeros(len(seed), dtype=np.int64)
    out[known] = poisson_model(seed[known].to_numpy(np.int64), mean[known].to_numpy(float))
    return pd.Series(out).astype("Int64").mask(~known)


@F.pandas_udf(LongType())
def small(seed: pd.Series, p: pd.Series) -> pd.Series:
    """1 with a probability that may be far below one in 2^32, else 0; null where seed or p is null."""
    known = _known(seed, p)
    out = np.zeros(len(seed), dtype=np.int64)
    out[known] = small_model(seed[known].to_numpy(np.int64), p[known].to_numpy(float))
    return pd.Series(out).astype("Int64").mask(~known)


def bernoulli(counter: Column, p: Column) -> Column:
    return uniform(counter) < p


def by_cumulative(counter: Column, cumulative: list[float]) -> Column:
    """Draw k with cumulative[k] <= u < cumulative[k + 1], from values that rise from 0 to 1."""
    u = uniform(counter)
    return (F.size(F.filter(F.lit(cumulative), lambda c: c <= u)) - 1).cast("int")


def poisson_cumulative(mean: float) -> list[float]:
    """Cumulative Poisson probabilities from 0 to five deviations above the mean, the last one set to 1."""
    n = max(2, math.ceil(mean + 5.0 * math.sqrt(mean)))
    p = total = math.exp(-mean)
    out = [0.0]
    for i in range(1, n - 1):
        out.append(total)
        p *= mean / i
        total += p
    return [*out, 1.0]

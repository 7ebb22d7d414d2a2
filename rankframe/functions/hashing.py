"""Checksums and string hashes, a batch at a time."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import LongType, StructField, StructType

from rankframe.operators.order import running_sum

MOD = 65521


@F.pandas_udf(LongType())
def adler32(data: pd.Series) -> pd.Series:
    """Adler-32 of a binary column as bigint; 1 for no bytes, null for null."""
    return data.map(lambda d: None if d is None else zlib.adler32(d)).astype("Int64")


def array_checksum(df: DataFrame, by: str, pos: str, data: str) -> DataFrame:
    """(by, checksum): Adler-32 of all of a group's binary values in their order, as of one run of bytes. Null values have no bytes.

    Of two runs a sum is a + a' - 1, and the other b + b' + n' * (a - 1): so each value needs its own sums and the bytes
    that follow it in the group, which a prefix over a dealt order gives. No group has to fit a row.
    """
    src = df.select(F.col(by).alias("by"), F.col(pos).alias("pos"), F.coalesce(F.col(data), F.lit("").cast("binary")).alias("data"))
    own = src.withColumn("s", adler32("data")).withColumn("n", F.octet_length("data").cast("long")).drop("data")
    a, b = F.col("s").bitwiseAND(F.lit(0xFFFF)), F.shiftright("s", 16)
    own = running_sum(own.withColumn("a", a - 1).withColumn("b", b), "by", ["pos"], "n", "before")
    total = own.groupBy(F.col("by").alias("__by")).agg(F.max(F.col("before") + F.col("n")).alias("end"))
    after = own.join(total, F.col("by").eqNullSafe(F.col("__by"))).withColumn("after", F.col("end") - F.col("before") - F.col("n"))
    # Each term is below 2^32, so a group of 2^31 values does not overflow.
    sums = after.groupBy("by").agg(F.sum("a").alias("a"), F.sum((F.col("b") + F.col("a") * (F.col("after") % MOD)) % MOD).alias("b"))
    low, high = (F.col("a") + 1) % MOD, F.col("b") % MOD
    return sums.select(F.col("by").alias(by), F.shiftleft(high, 16).bitwiseOR(low).alias("checksum"))


#: Fixed values: (changed word, source word, rotation) of the two mixing schedules of Bob Jenkins' lookup3.
_MIX = ((0, 2, 4), (1, 0, 6), (2, 1, 8), (0, 2, 16), (1, 0, 19), (2, 1, 4))
_FINAL = ((2, 1, 14), (0, 2, 11), (1, 0, 25), (2, 1, 16), (0, 2, 4), (1, 0, 14), (2, 1, 24))
_U = np.uint32


def _rot(x: np.ndarray, k: int) -> np.ndarray:
    return (x << _U(k)) | (x >> _U(32 - k))


def mix(w: list[np.ndarray]) -> None:
    """The mixing of three words of 32 bits, in place, for many rows at once."""
    for x, y, k in _MIX:
        z = 3 - x - y
        w[x] = (w[x] - w[y]) ^ _rot(w[y], k)
        w[y] = w[y] + w[z]


def final(w: list[np.ndarray]) -> None:
    """The final mixing, in place."""
    for x, y, k in _FINAL:
        w[x] = (w[x] ^ w[y]) - _rot(w[y], k)


def hashed(raws: list[bytes]) -> np.ndarray:
    """Unsigned 32-bit hashes of strings up to their first zero byte: blocks of twelve signed bytes, the last padded with zeros."""
    raws = [r.split(b"\0", 1)[0] for r in raws]
    blocks = np.array([max(1, -(-len(r) // 12)) for r in raws], dtype=np.int64)
    order = np.argsort(-blocks, kind="stable")
    out = np.zeros(len(raws), dtype=np.uint32)
    w = [np.zeros(len(raws), dtype=np.uint32) for _ in range(3)]
    for k in range(int(blocks.max()) if len(raws) else 0):
        live = int(np.searchsorted(-blocks[order], -k, side="left"))  # rows with more than k blocks, longest first
        part = b"".join(raws[i][12 * k : 12 * k + 12].ljust(12, b"\0") for i in order[:live])
        chars = np.frombuffer(part, dtype=np.int8).astype(np.int32).view(np.uint32).reshape(live, 3, 4)
        words = (chars[:, :, 0] << _U(24)) + (chars[:, :, 1] << _U(16)) + (chars[:, :, 2] << _U(8)) + chars[:, :, 3]
        now = [w[j][:live] + words[:, j] for j in range(3)]
        mix(now)
        for j in range(3):
            w[j][:live] = now[j]
    final(w)
    out[order] = w[2]
    return out


def mixed(raw: bytes) -> int:
    """hashed() of one string."""
    return int(hashed([raw])[0])


@F.pandas_udf(LongType())
def hash_string(s: pd.Series) -> pd.Series:
    """The hash of a string column in UTF-8; null for null."""
    known = s.notna().to_numpy()
    out = np.zeros(len(s), dtype=np.int64)
    out[known] = hashed([x.encode() for x in s[known]])
    return pd.Series(out).astype("Int64").mask(~known)


def mix_words(a: Column, b: Column, c: Column) -> Column:
    """The three words after mixing and final mixing, as a struct of bigints."""
    return _mix_words(a, b, c)


@F.pandas_udf(StructType([StructField(n, LongType()) for n in "abc"]))
def _mix_words(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
    w = [x.to_numpy(np.int64).astype(np.uint32) for x in (a, b, c)]
    mix(w)
    final(w)
    return pd.DataFrame({n: x.astype(np.int64) for n, x in zip("abc", w, strict=True)})

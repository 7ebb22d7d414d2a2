"""Ordered set operations on groups: (pos, member) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame, member: str = "member", pos: str = "pos") -> DataFrame:
    """(member, side, pos): members of a in its order, then those of b that a lacks in b's order."""
    both = a.select(member, F.lit(0).alias("side"), pos).unionByName(b.select(member, F.lit(1).alias("side"), pos))
    first = F.min(F.struct("side", pos))
    return both.groupBy(member).agg(first.alias("f")).select(member, F.col("f")["side"].alias("side"), F.col("f")[pos].alias(pos))


def intersection(a: DataFrame, b: DataFrame, member: str = "member") -> DataFrame:
    return a.join(b.select(member).distinct(), member, "left_semi")


def difference(a: DataFrame, b: DataFrame, member: str = "member") -> DataFrame:
    return a.join(b.select(member).distinct(), member, "left_anti")


def include(a: DataFrame, positions: list[int], pos: str = "pos") -> DataFrame:
    return a.where(F.col(pos).isin(positions))


def exclude(a: DataFrame, positions: list[int], pos: str = "pos") -> DataFrame:
    return a.where(~F.col(pos).isin(positions))


def strided(a: DataFrame, first: int, last: int, stride: int, pos: str = "pos") -> DataFrame:
    """Members at first, first + stride, .. up to last."""
    return a.where((F.col(pos) >= first) & (F.col(pos) <= last) & ((F.col(pos) - first) % stride == 0))


def translate(a: DataFrame, b: DataFrame, member: str = "member", pos: str = "pos") -> DataFrame:
    """(pos, other): the position in b of each member of a, null if it is not there."""
    return a.join(b.select(member, F.col(pos).alias("other")), member, "left").select(pos, "other")


def same_members(a: DataFrame, b: DataFrame, member: str = "member") -> DataFrame:
    """Do both hold the same members, in any order?"""
    odd = a.select(member).exceptAll(b.select(member)).unionByName(b.select(member).exceptAll(a.select(member)))
    return odd.agg((F.count(F.lit(1)) == 0).alias("same"))

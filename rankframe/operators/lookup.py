"""Lookup joins between probes and sorted or hashed arrays: equality, lower bound, range, nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankframe.operators.order import dealt, running_sum

#: Arrays of at most so many entries are looked up as literals, without a join.
LITERAL_ROWS = 4096


def bsearch(probes: DataFrame, array: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """Add position, the least position of the key in the array, -1 if there is none."""
    first = array.groupBy(F.col(value).alias("__v")).agg(F.min(pos).alias("__p"))
    return probes.join(first, F.col(key) == F.col("__v"), "left").withColumn("position", F.coalesce("__p", F.lit(-1))).drop("__v", "__p")


def contains(probes: DataFrame, table: DataFrame, key: str, other: str, negate: bool = False) -> DataFrame:
    """Probes whose key is (not) in the table."""
    return probes.join(table.select(F.col(other).alias("__k")), F.col(key) == F.col("__k"), "left_anti" if negate else "left_semi")


def _neighbours(probes: DataFrame, array: DataFrame, key: str, value: str, carry: str, by: str) -> DataFrame:
    """probes with before (value, carry), the last entry of the group with value <= key, and after, the first with value >= key.

    Both sides are put in one order of (group, key) and dealt into ranges of it. Within a range an entry is carried to
    the probes after and before it; across ranges, of which there is a row each, the nearest entry of another range
    is, if it is of the same group. So a group may hold any share of the rows. Of equal entries the one with the
    least carry counts.
    """
    names = [c for c in probes.columns if c not in (by, key)]
    entry = F.struct(F.col("__k").alias("v"), F.col("__c").alias("c"))
    right = array.groupBy(F.col(by).alias("__by"), F.col(value).alias("__k")).agg(F.min(carry).alias("__c"))
    right = right.where("__k is not null").withColumn("__hit", entry).drop("__c").withColumn("__side", F.lit(0))
    left = probes.select(F.col(by).alias("__by"), F.col(key).alias("__k"), F.struct(F.lit(True).alias("__probe"), *names).alias("__row"))
    both = left.withColumn("__side", F.lit(1)).unionByName(right, allowMissingColumns=True)
    placed = dealt(both, [F.col("__by").asc_nulls_first(), F.col("__k").asc_nulls_first(), F.col("__side")])
    hit = F.when(F.col("__hit").isNotNull(), F.struct("__by", "__hit"))
    ends = placed.groupBy("__range").agg(F.max_by(hit, F.when(hit.isNotNull(), F.col("__place"))).alias("last"), F.min_by(hit, F.when(hit.isNotNull(), F.col("__place"))).alias("first"))
    w = Window.orderBy("__range")  # a row per range
    ends = ends.select(
        "__range", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__in"),
        F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__next"),
    )
    # Both frames grow from one end of the range: a frame that shrinks would be added up anew for each row.
    w = Window.partitionBy("__range", "__by")
    upto = Window.unboundedPreceding, Window.currentRow
    placed = placed.withColumn("__b", F.last("__hit", True).over(w.orderBy("__place").rowsBetween(*upto)))
    placed = placed.withColumn("__a", F.last("__hit", True).over(w.orderBy(F.col("__place").desc()).rowsBetween(*upto)))
    placed = placed.where("__side = 1").join(ends, "__range")
    mine = lambda c: F.when(F.col(c)["__by"].eqNullSafe(F.col("__by")), F.col(c)["__hit"])
    before = F.when(F.col("__k").isNotNull(), F.coalesce("__b", mine("__in")))
    after = F.when(F.col("__k").isNotNull(), F.coalesce(F.when(before["v"] == F.col("__k"), before), F.col("__a"), mine("__next")))
    return placed.select(F.col("__by").alias(by), F.col("__k").alias(key), *[F.col("__row").getField(n).alias(n) for n in names], before.alias("before"), after.alias("after"))


def lower_bound(probes: DataFrame, array: DataFrame, key: str, value: str, pos: str, by: str) -> DataFrame:
    """Add position, the first one whose value is >= key within the group, else -1."""
    got = _neighbours(probes, array, key, value, pos, by)
    return got.withColumn("position", F.coalesce(F.col("after")["c"], F.lit(-1))).drop("before", "after")


def closest(probes: DataFrame, array: DataFrame, key: str, value: str, carry: str, by: str) -> DataFrame:
    """Add before (value, carry) with value <= key, and after with value >= key, null where there is none."""
    return _neighbours(probes, array, key, value, carry, by)


def nearest(probes: DataFrame, array: DataFrame, key: str, value: str, carry: str, by: str) -> DataFrame:
    """Add node (value, carry) and side: 0 an equal entry, -1 the one before, 1 the one after if there is none before; null in an empty group."""
    got = _neighbours(probes, array, key, value, carry, by)
    equal, b, a = F.col("before")["v"] == F.col(key), F.col("before"), F.col("after")
    side = F.when(equal, 0).when(b.isNotNull(), -1).when(a.isNotNull(), 1)
    return got.withColumn("side", side).withColumn("node", F.coalesce(b, a)).drop("before", "after")


def owner_of(probes: DataFrame, counts: DataFrame, pos: str, rank: str = "rank", n: str = "n") -> DataFrame:
    """Add rank, the one that owns a global position when the table counts says how many elements each rank has.

    Ranks may be many: their starts are an array that positions are looked up in. Empty ranks own none, and
    positions beyond the last element have a null rank.
    """
    starts = running_sum(counts.where(F.col(n) > 0), rank, [], n, "__start").select("__start", (F.col("__start") + F.col(n)).alias("__end"), F.col(rank).alias("__rank"))
    array = starts.select(F.lit(0).alias("__g"), "__start", F.struct("__rank", "__end").alias("__own"))
    got = _neighbours(probes.withColumn("__g", F.lit(0)), array, pos, "__start", "__own", "__g")
    own = F.col("before")["c"]
    return got.withColumn(rank, F.when(F.col(pos) < own["__end"], own["__rank"])).drop("__g", "before", "after")


def bsearch_range(probes: DataFrame, edges: list, key: str, out: str = "slot") -> DataFrame:
    """Add k with edges[k] <= key < edges[k + 1], len(edges) - 1 if there is none. Few edges: no join at all."""
    if len(edges) > LITERAL_ROWS:
        raise ValueError("use closest() for long arrays")
    n = len(edges) - 1
    at = F.size(F.filter(F.lit(edges), lambda e: e <= F.col(key)))
    return probes.withColumn(out, F.when((at >= 1) & (at <= n), at - 1).otherwise(F.lit(n)).cast("int"))


def owner(probes: DataFrame, counts: list[int], pos: str) -> DataFrame:
    """Add rank, the one that owns a global position when rank r has counts[r] elements; empty ranks own none."""
    ends, total = [], 0
    for n in counts:
        total += n
        ends.append(total)
    return probes.withColumn("rank", F.size(F.filter(F.lit(ends), lambda e: e <= F.col(pos))).cast("int"))

"""Sorts, positions, top-k, permutation and checks of order.

A logical slice is a value of column ``rank``, never a Spark partition. A global order is one range
partitioning by all of its columns, so that equal keys are split by their ties; it is written to the shared
folder with the place of each row in its range, and a prefix over the counts of the ranges, a row each,
makes that a place in the table. The number of ranges grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from rankframe.sources.shared import save

#: Rows of a range of a global order, about.
ROWS_PER_RANGE = 1 << 21
#: Bits of monotonically_increasing_id() below the partition.
PLACE_BITS = 33


def dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with __range and __place: which range of the order a row lies in, and its place there from 0. Written, so that it stays.

    Any type that Spark orders will do. Rows that agree in the whole order may come in any order.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_RANGE))
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = save(placed.withColumn("__id", F.monotonically_increasing_id()), "order")
    split = F.shiftright("__id", PLACE_BITS).cast("int"), F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn("__range", split[0]).withColumn("__place", split[1]).drop("__id")


def _exclusive(ranges: DataFrame, what: str, out: str) -> DataFrame:
    """(__range, out): the sum of ``what`` over the ranges before, of a table with a row per range."""
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("__range", F.coalesce(F.sum(what).over(before), F.lit(0)).alias(out))


def positions(df: DataFrame, key: str, ties: list[str], pos: str = "pos") -> DataFrame:
    """Add the 0-based position in the order of a key, then ties (which make it total). Nulls come first."""
    placed = dealt(df, [F.col(key).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties]])
    start = _exclusive(placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")), "__n", "__shift")
    return placed.join(start, "__range").withColumn(pos, F.col("__shift") + F.col("__place")).drop("__range", "__place", "__shift")


def grouped_positions(df: DataFrame, by: list[str], key: str, ties: list[str], pos: str = "pos") -> DataFrame:
    """Add the 0-based position within each group. A group may hold any share of the rows: its range of a global order is split like any other."""
    placed = positions(df, by[0], [*by[1:], key, *ties], "__at")
    first = placed.groupBy(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)]).agg(F.min("__at").alias("__first"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{i}"))
    found = placed.join(first, same).withColumn(pos, F.col("__at") - F.col("__first"))
    return found.drop("__at", "__first", *[f"__by{i}" for i in range(len(by))])


def running_sum(df: DataFrame, key: str, ties: list[str], value: str, out: str) -> DataFrame:
    """Add the exclusive prefix sum of value in the order of key and ties: within ranges, and over their totals."""
    placed = dealt(df, [F.col(key).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties]])
    start = _exclusive(placed.groupBy("__range").agg(F.sum(value).alias("__s")), "__s", "__shift")
    w = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("__r", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inner.join(start, "__range").withColumn(out, F.col("__r") + F.col("__shift")).drop("__range", "__place", "__r", "__shift")


def kth(df: DataFrame, key: str, ties: list[str], k: int) -> DataFrame:
    """The row at position k of the order; none if there are fewer."""
    return positions(df, key, ties, "__pos").where(F.col("__pos") == k).drop("__pos")


def psort(df: DataFrame, key: str, ties: list[str], counts: list[int]) -> DataFrame:
    """Global sort into logical ranks that keep their sizes: adds pos, rank, and local position."""
    placed = positions(df, key, ties)
    ends, total = [], 0
    for n in counts:
        total += n
        ends.append(total)
    rank = F.size(F.filter(F.lit(ends), lambda e: e <= F.col("pos"))).cast("int")
    start = F.element_at(F.lit([0, *ends]), rank + 1)
    return placed.withColumn("rank", rank).withColumn("local_pos", F.col("pos") - start)


def equal_counts(n: int, ranks: int) -> list[int]:
    """Sizes of the slices [r n / P, (r + 1) n / P)."""
    return [(r + 1) * n // ranks - r * n // ranks for r in range(ranks)]


def pops(df: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """Add popped: when a priority queue that gives the greatest key first, then the least ties, would give each row out."""
    placed = dealt(df, [F.col(key).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]])
    start = _exclusive(placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")), "__n", "__shift")
    return placed.join(start, "__range").withColumn("popped", F.col("__shift") + F.col("__place")).drop("__range", "__place", "__shift")


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows in an order; order should be total."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each group, with place 1, 2, .."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def is_sorted(df: DataFrame, by: str, pos: str, value: str) -> DataFrame:
    """Per slice: does value never decrease along pos? Slices of one row are sorted."""
    prev = F.lag(value).over(Window.partitionBy(by).orderBy(pos))
    return df.withColumn("__p", prev).groupBy(by).agg(F.coalesce(F.bool_and(F.col("__p").isNull() | (F.col("__p") <= F.col(value))), F.lit(True)).alias("is_sorted"))


def is_permutation(df: DataFrame, index: str) -> DataFrame:
    """Is the column exactly 0 .. n-1? An empty one is."""
    return df.agg(F.count(index).alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi")).select(
        F.coalesce((F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1), F.col("n") == 0).alias("is_permutation")
    )


def permute(df: DataFrame, pos: str, index: str) -> DataFrame:
    """Row i moves to position index[i]."""
    return df.drop(pos).withColumnRenamed(index, pos)


def same_array(a: DataFrame, b: DataFrame, pos: str, value: str) -> DataFrame:
    """One row: do both hold the same values at the same positions, and as many?"""
    x, y = a.select(F.col(pos).alias("p"), F.col(value).alias("v")), b.select(F.col(pos).alias("q"), F.col(value).alias("w"))
    both = x.join(y, F.col("p") == F.col("q"), "full")
    odd = F.count_if(F.col("p").isNull() | F.col("q").isNull() | ~F.col("v").eqNullSafe(F.col("w")))
    return both.agg((odd == 0).alias("same"))


def fill(df: DataFrame, value: str, what) -> DataFrame:
    """Every element becomes one value."""
    return df.withColumn(value, F.lit(what).cast(df.schema[value].dataType))


def truncate(df: DataFrame, pos: str, length: int) -> DataFrame:
    """The first elements; 0 empties the array."""
    return df.where(F.col(pos) < length)


def index_of(df: DataFrame, value: str, what, pos: str) -> DataFrame:
    """(position): where an element lies first, -1 if it does not."""
    return df.agg(F.coalesce(F.min(F.when(F.col(value).eqNullSafe(F.lit(what)), F.col(pos))), F.lit(-1)).cast("long").alias("position"))


def view(df: DataFrame, pos: str, offset: int, length: int) -> DataFrame:
    """Rows at [offset, offset + length), renumbered from 0."""
    return df.where((F.col(pos) >= offset) & (F.col(pos) < offset + length)).withColumn(pos, F.col(pos) - offset)


def reshape(df: DataFrame, pos: str, value: str, width: int) -> DataFrame:
    """Elements regrouped by width: row p holds elements p*width .. p*width + width - 1 in order."""
    chunk = F.expr(f"`{pos}` div {int(width)}")
    items = F.sort_array(F.collect_list(F.struct(F.col(pos), F.col(value))))
    return df.groupBy(chunk.alias("chunk")).agg(F.transform(items, lambda s: s[value]).alias("items"))

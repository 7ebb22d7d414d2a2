"""Reductions over ranks, prefix scans, and collectives. A slot is an element of the reduced array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from rankframe.operators.order import grouped_positions, positions, running_sum

#: Operators by name; LXOR is the parity of true values, REPLACE the value of the last rank.
OPS: dict[str, Callable[[Column, Column], Column]] = {
    "MAX": lambda v, r: F.max(v), "MIN": lambda v, r: F.min(v), "SUM": lambda v, r: F.sum(v), "PROD": lambda v, r: F.product(v),
    "LAND": lambda v, r: F.bool_and(v != 0), "LOR": lambda v, r: F.bool_or(v != 0), "LXOR": lambda v, r: F.count_if(v != 0) % 2 == 1,
    "BAND": lambda v, r: F.bit_and(v), "BOR": lambda v, r: F.bit_or(v), "BXOR": lambda v, r: F.bit_xor(v),
    "MINLOC": lambda v, r: F.min(F.struct(v.alias("value"), r.alias("rank"))),
    "MAXLOC": lambda v, r: F.struct(F.max(v).alias("value"), F.min(F.struct((-v).alias("n"), r.alias("rank")))["rank"].alias("rank")),
    "REPLACE": lambda v, r: F.max_by(v, r),
}


def reduce_slots(df: DataFrame, slot: str, value: str, ops: list[str], rank: str = "rank") -> DataFrame:
    """Per slot, the reduction of value over ranks by each operator, in columns named like it in lower case."""
    return df.groupBy(slot).agg(*[OPS[o](F.col(value), F.col(rank)).alias(o.lower()) for o in ops])


def allreduce(df: DataFrame, slot: str, value: str, op: str, out: str, rank: str = "rank") -> DataFrame:
    """Every row gets the reduction of its slot, a null slot being one. The reduction has a row per slot; Spark broadcasts it if that is small."""
    per = df.groupBy(F.col(slot).alias("__slot")).agg(OPS[op](F.col(value), F.col(rank)).alias(out))
    return df.join(per, F.col(slot).eqNullSafe(F.col("__slot"))).drop("__slot")


def reduce_custom(df: DataFrame, slot: str, value: str, rank: str, zero: Column, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """A fold of each slot's values in rank order by an associative merge; a slot has one value per rank."""
    items = F.sort_array(F.collect_list(F.struct(F.col(rank), F.col(value))))
    return df.groupBy(slot).agg(F.aggregate(F.transform(items, lambda s: s[value]), zero, merge).alias("reduced"))


def scan(df: DataFrame, slot: str, rank: str, value: str, inclusive: bool) -> DataFrame:
    """Add prefix, the sum over lower ranks (and the own one) of the slot. A slot has a row per rank."""
    w = Window.partitionBy(slot).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn("prefix", F.coalesce(F.sum(value).over(w), F.lit(0)))


def prefix(df: DataFrame, slot: str, rank: str, value: str) -> DataFrame:
    """Exclusive prefix with ranks + 1 entries per slot: the first is 0, the last the total."""
    inner = scan(df, slot, rank, value, False).select(slot, F.col(rank).alias("entry"), "prefix")
    last = df.groupBy(slot).agg((F.max(rank) + 1).alias("entry"), F.sum(value).alias("prefix"))
    return inner.unionByName(last)


def allgather(df: DataFrame, rank: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, at, value): all ranks' values, with their place in rank order. A table is what all ranks know, so none is copied to each.

    A group of any number of ranks is split; gathered() makes an array of a group that fits a row.
    """
    src = df.select(*[F.col(b) for b in by or []], F.col(rank).alias("__rank"), F.col(value).alias("value"))
    got = grouped_positions(src, by, "__rank", [], "at") if by else positions(src, "__rank", [], "at")
    return got.select(*(by or []), "at", "value")


def gatherv(df: DataFrame, rank: str, values: str, by: list[str] | None = None) -> DataFrame:
    """(by, at, first, values): as allgather of arrays of any size, with where each begins in the concatenation of its group."""
    keys = by or []
    src = df.select(*keys, F.col(rank).alias("__rank"), F.col(values).alias("values"), F.size(values).cast("long").alias("__n"))
    src = src.withColumn("__one", F.lit(0)) if not keys else src
    first = keys or ["__one"]
    got = grouped_positions(src, first, "__rank", [], "at")
    got = running_sum(got, first[0], [*first[1:], "at"], "__n", "__sum")
    start = got.where("at = 0").select(*[F.col(k).alias(f"__by{i}") for i, k in enumerate(first)], F.col("__sum").alias("__start"))
    same = F.lit(True)
    for i, k in enumerate(first):
        same = same & F.col(k).eqNullSafe(F.col(f"__by{i}"))
    return got.join(start, same).select(*keys, "at", (F.col("__sum") - F.col("__start")).alias("first"), "values")


def gathered(df: DataFrame, by: list[str], at: str = "at", value: str = "value") -> DataFrame:
    """(by, gathered): the values of each group in order, as an array. A group must fit a row."""
    items = F.sort_array(F.collect_list(F.struct(F.col(at), F.col(value))))
    return df.groupBy(*by).agg(F.transform(items, lambda s: s[value]).alias("gathered"))


def bcast(df: DataFrame, rank: str, root: int, value: str, out: str) -> DataFrame:
    """Every row gets the root rank's value (one row)."""
    return bcast_from(df, df, rank, root, value, out)


def bcast_from(df: DataFrame, source: DataFrame, rank: str, root: int, value: str, out: str) -> DataFrame:
    """Every row of df gets the value that the root rank has in source (one row)."""
    one = source.where(F.col(rank) == root).agg(F.first(value).alias(out))
    return df.crossJoin(F.broadcast(one))  # a single row


def alltoall(df: DataFrame, src: str, dst: str) -> DataFrame:
    """What src has for dst becomes what dst has from src."""
    swap = {src: dst, dst: src}
    return df.select(*[F.col(c).alias(swap.get(c, c)) for c in df.columns])


def comm_split(df: DataFrame, color: str, key: str, rank: str) -> DataFrame:
    """New rank within the color by key, then old rank, and the size of the color."""
    w = Window.partitionBy(color)
    return df.withColumn("new_rank", F.row_number().over(w.orderBy(key, rank)) - 1).withColumn("new_size", F.count(F.lit(1)).over(w))


def nodes(df: DataFrame, rank: str, per_node: int) -> DataFrame:
    """Node of each rank, and its rank there."""
    return df.withColumn("node", F.expr(f"`{rank}` div {int(per_node)}")).withColumn("intra", (F.col(rank) % per_node).cast("long"))

"""Grouping by type, runs and keys: split, uniq, insert-unique, slot reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_offsets(df: DataFrame, type_col: str, types: int) -> DataFrame:
    """(type, offset) for types 0 .. types of a table sorted by type: where each begins; empty ones too, and the total last."""
    counts = df.groupBy(F.col(type_col).cast("long").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    all_ = df.sparkSession.range(types + 1).select(F.col("id").alias("type"))
    w = Window.orderBy("type").rowsBetween(Window.unboundedPreceding, -1)  # a row per type
    return all_.join(counts, "type", "left").select("type", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))


def uniq_last(df: DataFrame, by: list[str], key: str, pos: str) -> DataFrame:
    """Of each run of equal adjacent keys along pos, the last row; nulls are equal to each other."""
    nxt = F.lead(F.struct(F.col(key).alias("k"))).over(Window.partitionBy(*by).orderBy(pos))  # null at the end only
    return df.withColumn("__next", nxt).where(F.col("__next").isNull() | ~F.col(key).eqNullSafe(F.col("__next")["k"])).drop("__next")


def first_per_key(df: DataFrame, key: list[str], pos: str) -> DataFrame:
    """The first row of each key along pos."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(pos))).where("__r = 1").drop("__r")


def insert_unique(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, first_pos, position): dense positions of distinct keys in the order in which they first occur."""
    from rankframe.operators.order import positions

    firsts = df.groupBy(key).agg(F.min(pos).alias("first_pos"))
    return positions(firsts, "first_pos", [key], "position")


def added(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Add is_new: is this the first row of its key along pos?"""
    return df.withColumn("is_new", F.row_number().over(Window.partitionBy(key).orderBy(pos)) == 1)


def recycle(df: DataFrame, by: str, pos: str, op: str, arg: str) -> DataFrame:
    """(by, pos, slot) of a slot store: 'insert' takes the slot freed last or a new one, 'remove' frees slot arg.

    Freed slots are a stack. An insert takes what the last remove before it left at its height of the stack, as a bracket
    finds its partner; where the stack is empty it takes the next new slot. All of it is native, a store being a
    window's partition: the heights come from a running sum and its running minimum.
    """
    removes = F.col("op") == "remove"
    src = df.select(by, pos, F.col(op).alias("op"), F.col(arg).cast("long").alias("arg"))
    w = Window.partitionBy(by).orderBy(pos)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = src.withColumn("sum", F.sum(F.when(removes, 1).otherwise(-1)).over(upto))
    run = run.withColumn("low", F.least(F.min("sum").over(upto), F.lit(0)))
    run = run.withColumn("lower", F.coalesce(F.lag("low").over(w), F.lit(0)))
    fresh = ~removes & (F.col("low") < F.col("lower"))
    # The height that a remove reaches, or that an insert takes from; new slots are at none.
    height = F.when(removes, F.col("sum") - F.col("low")).when(~fresh, F.col("sum") - F.col("low") + 1)
    run = run.withColumn("fresh", fresh).withColumn("height", height)
    new = F.sum(F.col("fresh").cast("long")).over(upto) - 1
    same = Window.partitionBy(by, "height").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.last(F.when(removes, F.col("arg")), True).over(same)
    run = run.withColumn("new", new).withColumn("taken", taken)
    return run.select(by, pos, F.when(removes, F.col("arg")).when(F.col("fresh"), F.col("new")).otherwise(F.col("taken")).alias("slot"))


def at_position(positions: DataFrame, key: str, wanted: DataFrame, position: str = "position") -> DataFrame:
    """wanted (position) with the key that insert_unique() gave it, null beyond the last."""
    return wanted.join(positions.select(F.col("position").alias(position), key), position, "left")

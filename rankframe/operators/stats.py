"""One-pass descriptive statistics, with the least rank that attains each extreme."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

ALL_GROUPS, ALL_PRIOS = -2, -3


def summarize(df: DataFrame, by: list[str], value: str, rank: str) -> DataFrame:
    """count, total, total_sq, least and greatest value and their least ranks, mean, population variance (never
    below 0), deviation, and variance of the mean. Null values do not take part; a group without values has
    count 0 and null moments.
    """
    x = F.col(value).cast("double")
    r = F.when(x.isNotNull(), F.col(rank))
    var = F.greatest(F.col("total_sq") / F.col("n") - F.pow(F.col("total") / F.col("n"), 2), F.lit(0.0))
    got = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("total_sq"), F.min(x).alias("least"), F.max(x).alias("greatest"),
        F.min(F.when(x.isNotNull(), F.struct(x.alias("x"), r.alias("r"))))["r"].alias("least_at"),
        F.min(F.when(x.isNotNull(), F.struct((-x).alias("x"), r.alias("r"))))["r"].alias("greatest_at"),
    )
    got = got.withColumn("mean", F.when(F.col("n") > 0, F.col("total") / F.col("n"))).withColumn("variance", F.when(F.col("n") > 0, var))
    return got.withColumn("deviation", F.sqrt("variance")).withColumn("variance_mean", F.when(F.col("n") > 0, F.col("variance") / F.col("n")))


def summarize_ranks(df: DataFrame, by: list[str], value: str, rank: str) -> DataFrame:
    """As summarize(), of one sample per rank: the sum of its values."""
    return summarize(df.groupBy(*by, rank).agg(F.sum(value).alias(value)), by, value, rank)


def printed(df: DataFrame, group: int, prio: int, group_col: str = "grp", prio_col: str = "prio") -> DataFrame:
    """Variables of a group (or of all groups), of a priority at least (or of all)."""
    g, p = F.col(group_col), F.col(prio_col)
    in_group = F.lit(group == ALL_GROUPS) | (g == ALL_GROUPS) | (g == group)
    return df.where(in_group & (F.lit(prio == ALL_PRIOS) | (p == ALL_PRIOS) | (p >= prio)))


def report(summary: DataFrame) -> DataFrame:
    """Add the relative deviation in percent, null where the mean is 0."""
    return summary.withColumn("relative", F.when(F.col("mean") != 0, 100 * F.col("deviation") / F.abs("mean")))


def bucket_sizes(df: DataFrame, bucket, buckets: int) -> DataFrame:
    """Mean and deviation of bucket sizes, empty buckets included."""
    sizes = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        (F.sum("n") / buckets).alias("mean"),
        F.sqrt(F.greatest(F.sum(F.col("n") * F.col("n")) / buckets - F.pow(F.sum("n") / buckets, 2), F.lit(0.0))).alias("deviation"),
    )


def summary_vector(summary: DataFrame, variable: str, order: str) -> DataFrame:
    """One row: the means and the greatest values of all variables in their order, as the report's last lines have them. A variable is a row."""
    items = F.sort_array(F.collect_list(F.struct(F.col(order), "mean", "greatest")))
    got = summary.agg(items.alias("i"))
    return got.select(F.transform("i", lambda s: s["mean"]).alias("means"), F.transform("i", lambda s: s["greatest"]).alias("maxima"))


class Statistics:
    """A named container of variables. Adding a name twice and accumulating an unknown one are errors."""

    def __init__(self):
        self.values: dict[str, list[DataFrame]] = {}

    def add(self, name: str) -> None:
        if name in self.values:
            raise ValueError(f"statistics variable {name!r} exists already")
        self.values[name] = []

    def accumulate(self, name: str, df: DataFrame, value: Column, rank: Column) -> None:
        """Count the values of a table under a variable."""
        if name not in self.values:
            raise KeyError(f"statistics variable {name!r} is unknown")
        self.values[name].append(df.select(F.lit(name).alias("variable"), value.cast("double").alias("value"), rank.cast("long").alias("rank")))

    def compute(self) -> DataFrame:
        """summarize() by variable, in one aggregation; variables without values have none."""
        parts = [p for ps in self.values.values() for p in ps]
        names = [n for n, ps in self.values.items() if not ps]
        if not parts:
            raise ValueError("no variable has values")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        if names:
            empty = every.sparkSession.createDataFrame([(n,) for n in names], "variable string")
            every = every.unionByName(empty, allowMissingColumns=True)
        return summarize(every, ["variable"], "value", "rank")

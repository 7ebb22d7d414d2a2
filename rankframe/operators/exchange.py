"""Sparse exchange: transposing who sends to whom, with payloads, and counting senders.

All of the usual algorithms compute one relation, so there is one plan: an order by receiver and sender, dealt into
ranges, so that a receiver of any number of messages is split. The relation comes as a row per message, with its place
among the receiver's; ``gathered`` makes an array per receiver of it, for receivers whose messages fit a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from rankframe.operators.order import grouped_positions
from rankframe.sources.shared import save

#: Senders of a block, receivers that meet one in a task, and pairs made in a task, about.
BLOCK, RECEIVERS, PAIRS = 1024, 4096, 1 << 24

#: Names of the algorithms that a caller may ask for; they differ in messages, not in results.
METHODS = ("allgather", "binary", "nary", "pex", "pcx", "rsx", "nbx", "ranges", "superset")


def notify(edges: DataFrame, src: str = "src", dst: str = "dst", method: str | None = None) -> DataFrame:
    """(dst, nth, src): the distinct senders of each receiver, ascending. method is checked and makes no difference."""
    if method is not None and method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    return grouped_positions(edges.select(src, dst).distinct(), [dst], src, [], "nth").select(dst, "nth", src)


def notify_payload(edges: DataFrame, src: str = "src", dst: str = "dst", payload: str = "payload") -> DataFrame:
    """(dst, nth, src, payload) in the order of the senders; a sender has one edge per receiver."""
    return grouped_positions(edges.select(src, dst, payload), [dst], src, [], "nth").select(dst, "nth", src, payload)


def notify_payloadv(edges: DataFrame, src: str = "src", dst: str = "dst", payload: str = "payload") -> DataFrame:
    """(dst, nth, src, payload, first): payload arrays, and where each begins in the receiver's concatenation of them."""
    got = notify_payload(edges, src, dst, payload)
    w = Window.partitionBy(dst).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return got.withColumn("first", F.coalesce(F.sum(F.size(payload).cast("long")).over(w), F.lit(0)))


def gathered(messages: DataFrame, dst: str = "dst", src: str = "src", payload: str | None = None) -> DataFrame:
    """(dst, senders) and payloads, arrays in the order of nth. Each receiver's messages must fit a row."""
    items = F.sort_array(F.collect_list(F.struct("nth", src, *([payload] if payload else []))))
    got = messages.groupBy(dst).agg(items.alias("__m"))
    more = [F.transform("__m", lambda s: s[payload]).alias("payloads")] if payload else []
    return got.select(dst, F.transform("__m", lambda s: s[src]).alias("senders"), *more)


def census(edges: DataFrame, src: str = "src", dst: str = "dst", size: str | None = None) -> DataFrame:
    """(dst, n_senders), with size also total_size. Edges are distinct."""
    more = [F.sum(size).alias("total_size")] if size else []
    return edges.groupBy(dst).agg(F.count(src).alias("n_senders"), *more)


def superset(edges: DataFrame, candidates: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """(dst, src, sends): what each receiver hears from a computable superset of its senders.

    candidates makes (dst, src) from the distinct receivers and senders of edges; a pair that it leaves out must not be an edge.
    """
    pairs = edges.select(F.col(dst).alias("dst"), F.col(src).alias("src")).distinct()
    known = candidates(pairs).select("dst", "src").distinct()
    return known.join(pairs.withColumn("__sent", F.lit(True)), ["dst", "src"], "left").select("dst", "src", F.coalesce("__sent", F.lit(False)).alias("sends"))


def superset_by_key(edges: DataFrame, key: Callable[[Column], Column], src: str = "src", dst: str = "dst") -> DataFrame:
    """superset() where a receiver's candidates are all senders of its key, and those that send to it.

    What meets is receivers and blocks of a key's senders, an array each, so pairs are made last and are never shuffled.
    """
    pairs = save(edges.select(F.col(dst).alias("dst"), F.col(src).alias("src")).distinct(), "pairs")
    senders = pairs.select("src").distinct().withColumn("k", key(F.col("src"))).where("k is not null")
    senders = save(grouped_positions(senders, ["k"], "src", [], "no").select("k", "src", F.expr(f"no div {BLOCK}L").alias("block")), "senders")
    receivers = save(pairs.select("dst").distinct().withColumn("k", key(F.col("dst"))), "receivers")
    per = receivers.groupBy("k").agg(F.count(F.lit(1)).alias("m")).join(senders.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("block").alias("last")), "k")
    per = save(per.withColumn("parts", F.ceil(F.col("m") / RECEIVERS).cast("int")), "keys")
    total = per.agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0))).first()[0]
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS))
    blocks = senders.groupBy("k", "block").agg(F.collect_list("src").alias("srcs")).join(per.select("k", "parts"), "k")
    blocks = blocks.select("k", "block", "srcs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = receivers.join(per.select("k", "last", "parts"), "k").select("dst", "k", F.pmod(F.xxhash64("dst"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    sent = pairs.join(senders, "src").where(key(F.col("dst")) == F.col("k")).groupBy("dst", "block").agg(F.collect_list("src").alias("sent"))
    asked = asked.join(sent, ["dst", "block"], "left")
    at = ["k", "block", "part"]
    met = asked.repartition(tasks, *at).join(blocks.repartition(tasks, *at), at)
    silent = F.when(F.col("sent").isNull(), F.col("srcs")).otherwise(F.array_except("srcs", "sent"))
    heard = pairs.select("dst", "src", (F.col("dst").isNotNull() & F.col("src").isNotNull()).alias("sends"))
    return heard.unionByName(met.select("dst", F.explode(silent).alias("src"), F.lit(False).alias("sends")))


def encode(edges: DataFrame, src: str = "src", dst: str = "dst", payload: str = "payload") -> DataFrame:
    """(src, record_no, record): each message as the integers (to, 1, from, payload), in the order of receivers."""
    got = grouped_positions(edges.select(src, dst, payload), [src], dst, [], "record_no")
    ints = [F.col(c).cast("long") for c in (dst, src, payload)]
    return got.select(src, "record_no", F.array(ints[0], F.lit(1).cast("long"), ints[1], ints[2]).alias("record"))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """(to, record): record streams (to, number, from, payload, from, payload, ..) of two sides merged by receiver, senders ascending.

    A receiver's record holds its senders, as the format has it.
    """
    both = first.select("record").unionByName(second.select("record"))
    one = F.explode(F.transform(F.sequence(F.lit(0), F.element_at("record", 2) - 1), lambda i: F.struct(
        F.get("record", (2 * i + 2).cast("int")).alias("src"), F.get("record", (2 * i + 3).cast("int")).alias("payload"))))
    items = both.select(F.get("record", F.lit(0)).alias("to"), one.alias("m"))
    got = items.groupBy("to").agg(F.sort_array(F.collect_list("m")).alias("m"))
    flat = F.flatten(F.transform("m", lambda s: F.array(s["src"], s["payload"])))
    return got.select("to", F.concat(F.array(F.col("to"), F.size("m").cast("long")), flat).alias("record"))


def decode(records: DataFrame, record: str = "record") -> DataFrame:
    """(dst, src, payload) of records (to, number, from, payload, ..)."""
    at = F.explode(F.sequence(F.lit(0), (F.element_at(record, 2) - 1).cast("int")))
    got = records.select(F.col(record).alias("r"), at.alias("i"))
    return got.select(F.get("r", F.lit(0)).alias("dst"), F.get("r", F.col("i") * 2 + 2).alias("src"), F.get("r", F.col("i") * 2 + 3).alias("payload"))


def matched(sends: DataFrame, receives: DataFrame, keys: tuple[str, ...] = ("src", "dst", "tag"), order: str = "at") -> DataFrame:
    """Point to point: the n-th message of a sender to a receiver under a tag meets the receiver's n-th call for it.

    All columns of both sides (those of receives under their own names); calls without a message and messages that nobody asks for are left out.
    """
    a = grouped_positions(sends, list(keys), order, [], "__nth")
    b = grouped_positions(receives, list(keys), order, [], "__nth").withColumnRenamed(order, f"received_{order}")
    return a.join(b, [*keys, "__nth"]).drop("__nth")


def consistent(counts: DataFrame, rank: str, values: list[str]) -> DataFrame:
    """One row: do all ranks state the same values?"""
    same = [F.count_distinct(F.struct(F.col(v).alias("v"))) <= 1 for v in values]
    out: Column = F.lit(True)
    for s in same:
        out = out & s
    return counts.agg(out.alias("consistent"), F.count_distinct(rank).alias("ranks"))

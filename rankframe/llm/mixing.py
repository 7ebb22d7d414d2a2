"""Mixing sources to target weights by subset sums.

A source's target is met by whole passes over its documents and, for the rest of its budget,
by documents taken once more. How many documents of each exact length to take is a subset-sum
problem over the histogram of lengths: most of the budget is spread over all lengths in
proportion, and a bounded knapsack fits what remains. Which documents of a length are taken
is decided by a seeded hash, so the choice is the same in every run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankframe.llm.common import WORD, columns, rank_bits, save, spread_rank

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST_PASSES = 3
#: Words of budget that the knapsack solves: so many, or so many times the longest document if that is more.
EXACT, LONGEST = 1 << 19, 4
SEED = 7


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, at most counts, for the largest sum <= budget.

    Bounded subset sums as bits of one integer: the sums within reach of n documents of a length are the
    old ones, shifted by all multiples up to n, by doubling. ``via`` keeps for each sum the length that
    first reached it. Memory: about six bytes per unit of budget.
    """
    via = np.full(budget + 1, -1, dtype=np.int32)
    via[0] = len(lengths)
    reach, within = 1, (1 << (budget + 1)) - 1
    for i, (v, n) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        if via[budget] >= 0:
            break
        if not 0 < v <= budget or n <= 0:
            continue
        n, step, more = min(n, budget // v), 1, reach
        while n:
            k = min(step, n)
            more |= (more << (k * v)) & within
            n, step = n - k, 2 * step
        new = np.frombuffer((more & ~reach).to_bytes(budget // 8 + 1, "little"), dtype=np.uint8)
        at = np.flatnonzero(new)
        bits = np.unpackbits(new[at, None], axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        via[at[row] * 8 + bit] = i
        reach = more
    take = np.zeros(len(lengths), dtype=np.int64)
    at = int(np.flatnonzero(via >= 0)[-1])
    while at:
        take[via[at]] += 1
        at -= int(lengths[via[at]])
    return take


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sizes come closest below budget.

    A budget of up to EXACT, or some of the longest documents, is all left to the knapsack. Of a larger one
    that much is; the rest is spread over all lengths in proportion, and what rounding down leaves of it is
    taken from the longest on.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    spare = max(EXACT, LONGEST * int(lengths[counts > 0].max()))
    take, rest = np.zeros(len(lengths), dtype=np.int64), budget
    order = np.argsort(-lengths, kind="stable")
    if budget > spare:
        take = (counts.astype(object) * (budget - spare) // total).astype(np.int64)
        rest -= int((take * lengths).sum())
        for i in order:  # afterwards rest < spare + the longest, as any length left does not fit above spare
            if lengths[i] > 0 and rest > spare:
                n = min(int(counts[i] - take[i]), (rest - spare) // int(lengths[i]))
                take[i] += n
                rest -= n * int(lengths[i])
    take[order] += knapsack(lengths[order], (counts - take)[order], rest)
    return take


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, source_size, target for each source of sizes (source, size).

    Sources by code point, null last, weigh ``weights`` in turn. A target is the source's share
    of all sizes by weight, but no more than ``most`` times its own size; the excess goes to the
    others by weight until nobody is above. The driver sees one row of sums per turn, however
    many sources there are.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = save(_numbered(per), "sources")
    per = per.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int")))
    per = per.withColumn("__most", F.col("source_size") * float(most))
    level = -1.0
    while True:  # water level: what one unit of weight gets
        full = F.col("__most") <= F.col("__w") * level
        got = per.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("__most"))).alias("full"),
            F.sum(F.when(~full, F.col("__w"))).alias("w"),
        ).first()
        if not got["w"] or not got["all"]:
            break
        nxt = (float(got["all"]) - float(got["full"] or 0.0)) / got["w"]
        if nxt <= level:
            break
        level = nxt
    target = F.least(F.col("__most"), F.col("__w") * F.lit(max(level, 0.0)))
    return per.select("source", "source_size", target.alias("target"))


def _numbered(per: DataFrame) -> DataFrame:
    """Add __i, the position by source, null last: a count per range of sources, then ranks within."""
    n = max(1, per.sparkSession.sparkContext.defaultParallelism)
    dealt = save(per.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("__p", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    shift = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__p").orderBy(F.col("source").asc_nulls_last())
    ranked = dealt.withColumn("__r", F.row_number().over(within) - 1)
    return ranked.join(shift, "__p").withColumn("__i", F.col("__r") + F.col("__before")).drop("__p", "__r", "__before")


def mix(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_PASSES,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of df.

    size is the number of words (null: 0); taken is size times how often the mix takes the
    document, ``most`` times at most. Documents without words are never taken; a repeated row is a
    document of its own; null sources are a source; other columns are ignored. An empty table
    gives no rows.
    """
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(text).alias("size"), F.lit(0).cast("long").alias("mark"))
    times = F.col("passes") + (F.col("rank") < F.col("take")).cast("long")
    return _ranked(docs, weights, most, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), "source")


def word_count(text: str):
    """Number of words of a column; null has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(
    df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, seed: int = SEED,
) -> DataFrame:
    """The rows of df as often as the mix takes them, with all their columns.

    Null and empty texts have no words and are never taken; null sources are a source, null ids an id; an empty
    table gives no rows. Repeated rows are documents of their own; where the mix takes only some of the rows that
    agree in id, source and text, all that it takes of them comes out as copies of one.

    Ids and sizes alone are shuffled and ranked. What they decide is a row per source and length, the last hash
    that is taken, by which each text is kept or not where it is read: Spark broadcasts these rows if they are small.
    """
    mark = F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(0))
    own = {"id": F.col(f"`{doc_id}`"), "source": F.col(f"`{source}`"), "size": word_count(text), "mark": mark}
    narrow = df.select(own["id"].alias("doc_id"), *[own[n].alias(n) for n in ("source", "size", "mark")])
    rules, edges = _rules(_ranked(narrow, weights, most, seed))
    rows = df.select(F.struct(*columns(df)).alias("row"), *[c.alias(n) for n, c in own.items()], _order(own["id"], mark, seed).alias("hash"))
    same = rows["source"].eqNullSafe(rules["source"]) & (rows["size"] == rules["size"])
    ruled = rows.join(rules, same).select("row", "id", "mark", "hash", rows["source"].alias("source"), "passes", "last")
    once = F.coalesce(F.col("hash") < F.col("last"), F.lit(False)).cast("long")
    plain = ruled.where(~F.coalesce(F.col("hash") == F.col("last"), F.lit(False))).select("row", (F.col("passes") + once).alias("times"))
    # Rows with the hash of the last one taken may be repeats of it, of which some are taken: they become one first.
    at_last = ruled.where("hash = last").groupBy("id", "source", "mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    a, b = at_last.alias("a"), edges.alias("b")
    mine = F.col("a.id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.mark") == F.col("b.mark"))
    both = plain.unionByName(a.join(b, mine).select("a.row", "b.times")).where("times > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def _order(doc_id, mark, seed: int):
    """The seeded hash by which documents of one length are taken."""
    return F.xxhash64(F.lit(seed), doc_id, mark)


def _ranked(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """docs (doc_id, source, size, mark) with source_size, target, passes, take and rank, the place within its source and size."""
    docs = save(docs.withColumn("hash", _order(F.col("doc_id"), F.col("mark"), seed)), "sizes")
    per = save(targets(docs, weights, most), "targets")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["size"].to_numpy(np.int64)
        counts = pdf["n"].to_numpy(np.int64)
        total, target = int((lengths * counts).sum()), float(pdf["target"].iloc[0])
        passes = min(most, int(target // total)) if total else 0
        take = choose(lengths, counts, int(round(target - passes * total)) if passes < most else 0)
        return pd.DataFrame({"source": pdf["source"], "size": lengths, "passes": passes, "take": take})

    hist = docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    hist = hist.join(per, hist["source"].eqNullSafe(per["source"])).select(hist["source"], "size", "n", "target")
    # A group holds one row per length that occurs, whatever the number of documents.
    got = save(hist.groupBy("source").applyInPandas(fit, "source string, size long, passes long, take long"), "taken")
    ranked = spread_rank(docs, ["source", "size"], ["hash", "doc_id", "mark"], "rank", rank_bits(docs.count()), hashed=True)
    a, b, c = ranked.alias("a"), got.alias("b"), per.alias("c")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")))
    joined = joined.join(c, F.col("a.source").eqNullSafe(F.col("c.source")))
    return joined.select("a.doc_id", "a.source", "a.size", "a.mark", "a.hash", "a.rank", "b.passes", "b.take", "c.source_size", "c.target")


def _rules(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, size, passes, last): the whole passes, and the hash up to which documents are taken once more, null for none.

    And (doc_id, source, mark, times) of the documents that have just that hash. So a text needs a row per length
    that occurs in its source to be decided, and no more of it where a length is taken as a whole.
    """
    ranked = save(ranked.select("source", "size", "doc_id", "mark", "hash", "rank", "passes", "take"), "ranked")
    whole = F.first("take") >= F.count(F.lit(1))
    last = F.when(whole, F.lit((1 << 63) - 1)).otherwise(F.max(F.when(F.col("rank") == F.col("take") - 1, F.col("hash"))))
    rules = save(ranked.groupBy("source", "size").agg(F.first("passes").alias("passes"), last.alias("last")), "rules")
    a, b = ranked.alias("a"), rules.alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.hash") == F.col("b.last"))
    times = F.sum(F.col("a.passes") + (F.col("a.rank") < F.col("a.take")).cast("long"))
    edges = a.join(b, same).groupBy("a.doc_id", "a.source", "a.mark").agg(times.alias("times"))
    return rules, save(edges, "edges")

"""Connected components of a link table by alternating star operations (Kiveris et al., 2014).

Each round joins every node to the least node it knows, first among its larger and then among
its smaller neighbours. Joins only shuffle links; rounds are written to the shared folder. The least
neighbours are written too before links meet them: a join of two plain shuffles is one that adaptive
execution splits where a node has a large share of all links, or does without where it is small.

First each task makes a forest of the links it reads. If those of all tasks together are few, one task
joins them and no round is needed: rounds take as many tasks as any shuffle, however few links are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import drop, save_at

#: Links, 16 bytes each, that a task makes a forest of at a time, and that one task joins at most.
TOGETHER, ALONE = 1 << 18, 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node) that connect what the edges (a, b) connect, one per node at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        m = np.minimum(label[x], label[y])
        np.minimum.at(least, label[x], m)
        np.minimum.at(least, label[y], m)
        while (nxt := least[least]).tolist() != least.tolist():
            least = nxt
        nxt = least[label]
        if np.array_equal(nxt, label):
            break
        label = nxt
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b long), root being the least node it reaches.

    Links may repeat and point either way; links of a node with itself and null ends are left
    out. Nodes without links do not occur in the result.
    """
    spark = links.sparkSession
    clean = links.where("a <> b").select("a", "b")
    trees, path = save_at(clean.mapInArrow(_trees, "u long, v long"), "trees")
    if trees.count() <= ALONE:
        roots, _ = save_at(trees.coalesce(1).mapInArrow(_labels, "node long, root long"), "labels")
        drop(spark, path)
        return roots
    edges, whole = save_at(trees.distinct(), "links")
    drop(spark, path)
    path = whole
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least, first = save_at(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, old = save_at(large, "links"), path
        least, second = save_at(large[0].groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large[0].join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges, path = save_at(small.where("u <> v").distinct(), "links")
        for done in (old, large[1], first, second):
            drop(spark, done)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest (u, v) of each TOGETHER links."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += len(batch)
        if n >= TOGETHER:
            yield pa.record_batch(list(_joined(some)), ["u", "v"])
            some, n = [], 0
    if some:
        yield pa.record_batch(list(_joined(some)), ["u", "v"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links, the roots included."""
    if some := list(batches):
        u, v = _joined(some)
        roots = np.unique(v)
        yield pa.record_batch([np.concatenate([u, roots]), np.concatenate([v, roots])], ["node", "root"])


def _joined(some: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    return forest(*(np.concatenate([x.column(i).to_numpy() for x in some]) for i in (0, 1)))

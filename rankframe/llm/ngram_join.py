"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The entries of the product of the matrix with its transpose are the overlaps of pairs. They are accumulated block of
columns by block of columns, and a pair is discarded as soon as its count plus what is left of its columns
cannot reach the bound that its sizes give.

The first block of columns of a document is the rarest of its n-grams: a set of a n-grams links at similarity t only
if it shares ceil(t a) of them, so two sets that link have an entry of the product in the first a - ceil(t a) + 1
columns of both, in whatever order all columns are taken. Rare columns come first, by the counts of all n-grams of
all documents in a table that grows with them, so that what many documents have in common (a line, a passage) brings few
pairs together. A column's documents of about one size make a block of rows, a family, around the least of them;
overlaps are accumulated for the pairs of a family, whichever column brought them together.

Equal sets are compared once. A large family is dealt into parts: all pairs within a part, and of
each member with the family's least, are compared first; then only members outside the family's
largest component so far meet the other parts. Links are kept as forests: they connect all that is
linked, without listing all pairs of a group.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankframe.llm.common import bounded_batches, drop, release, save, save_at, trim, whole_rows
from rankframe.llm.components import components, forest

#: Sets of which a task remembers that it has posted them.
REMEMBERED = 250_000
#: Bits of the number of counts of n-grams, at most, and the parts in which a task sends its counts.
MOST_COUNTS, CHUNKS = 24, 64
#: Levels of a count within a binary magnitude, as bits. Where a count holds many n-grams, common ones still stand out.
FINE = 3
#: Tables of counts that are added up in one task.
TABLES = 256
#: Magnitude of the rows of a column beyond which it is dealt by salt, at least.
HOT = 16
#: Fewest and most buckets of the summary that rules pairs out before their sets are fetched; in between, one for eight entries.
SKETCH, LARGE_SKETCH = 64, 4096
#: Members of a family that are compared in one task.
PART = 256
#: Members, and entries of their sets, on either side of a task that compares parts of a large family.
ACROSS, ENTRIES = 512, 1_500_000
#: Columns of a block of the product.
COLUMNS = 1024
#: Entries of a part's sets from which freed memory goes back to the system at once.
LARGE = 1_000_000
#: Bits of the filter that says which documents to read again, at most.
MOST_BITS = 1 << 26
U = np.uint64

def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads its input's bits."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the runs of so many words, A-Z in lower case.

    A text of fewer words has its whole sequence as its only run, one without words has none.
    """
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), dtype=U, count=len(split))
    k = min(words, len(h))
    run = _mix(h[: len(h) - k + 1] + U(k))
    for j in range(1, k):
        run = _mix(run + h[j : len(h) - k + 1 + j])
    return np.unique(run)


class Bands:
    """Sizes in bands, so that sets that link lie in one band or in neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den, starts = num, den, [1]
        while starts[-1] < 1 << 40:
            starts.append(max(starts[-1] + 1, -(-starts[-1] * den // num)))
        self.starts = np.array(starts)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, side="right")) - 1


def level(total: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale: level >> FINE is the binary magnitude, up to 31; equal counts have equal levels, larger ones none that are lower."""
    m, e = np.frexp(total.astype(np.float64))
    return np.minimum((e.astype(np.int64) << FINE) + ((2 * m - 1) * (1 << FINE)).astype(np.int64) * (total > 0), 255).astype(np.uint8)


def rarest(s: np.ndarray, levels: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The first columns of a set in the order of (level of their count, name), as many as a link needs, and their levels."""
    seen = levels[bucket(s, len(levels))]
    order = np.lexsort((_mix(s), seen))
    first = order[: len(s) + 1 - -(-num * len(s) // den)]
    return s[first], seen[first]


def bucket(s: np.ndarray, n: int) -> np.ndarray:
    """Where n-grams are counted in a table of n counts, n a power of two."""
    return (s >> U(65 - n.bit_length())).astype(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Entries of a set per bucket of columns, up to 255. The sum of differences is a lower bound of the sets'.

    The number of buckets is a power of two that grows with the set: sets of unrelated texts differ by the root
    of entries times buckets, which has to be more than what linked ones of that size may differ by.
    """
    size = SKETCH
    while 8 * size < len(s) and size < LARGE_SKETCH:
        size *= 2
    return np.minimum(np.bincount((s >> U(40)).astype(np.int64) % size, minlength=size), 255).astype(np.uint8).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Summaries as rows of one number of buckets, that of the smallest: buckets that agree modulo it are added up."""
    size = min(map(len, sketches))
    return np.stack([np.frombuffer(x, dtype=np.uint8).reshape(-1, size).sum(axis=0, dtype=np.int32) for x in sketches])


def product(sets: list[np.ndarray], num: int, den: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of all linked pairs of sets; with rows, of pairs of which one is in rows.

    Overlaps are accumulated over blocks of columns; columns of one set only are left out.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    left = np.arange(len(sets)) if rows is None else rows
    need = -(-num * (n[left][:, None] + n[None, :]) // (num + den))
    alive = np.minimum(n[left][:, None], n[None, :]) >= need
    alive &= left[:, None] != np.arange(len(sets))[None, :]
    if not alive.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = count[at] > 1
    column = (np.cumsum(count > 1) - 1)[at[shared]]
    row = row[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    rest = np.bincount(row, minlength=len(sets))
    sums = np.zeros(alive.shape, dtype=np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, total - start)), dtype=np.float32)
        part[row[a:b], column[a:b] - start] = 1
        live = alive.any(axis=1)
        sums[live] += part[left[live]] @ part.T
        rest = rest - np.bincount(row[a:b], minlength=len(sets))
        alive &= sums + np.minimum(rest[left][:, None], rest[None, :]) >= need
        if not alive.any():
            break
    alive &= sums >= need
    i, j = np.nonzero(alive)
    i = left[i]
    ordered = np.unique(np.c_[np.minimum(i, j), np.maximum(i, j)], axis=0)
    return ordered[:, 0], ordered[:, 1]


def _profiles(src: DataFrame, words: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, set, more, sketch of each row, and the level of how many rows hold n-grams of each bucket.

    Tasks count in tables of their own, up to 255 in a byte, which they send in CHUNKS packed parts after their rows; those of up
    to TABLES tasks are added up first, and then what that makes. The counts only order the columns: results do not depend on them.
    """
    rows = src.count()
    size = 1 << min(MOST_COUNTS, max(12, (64 * rows).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.uint16)
        for b in batches:
            n, names, more, sketches, buckets = [], [], [], [], [np.zeros(0, dtype=np.int64)]
            for t in b.column(1):
                s = shingle_set(t.as_py(), words)
                buckets.append(bucket(s, size))
                d = xxhash.xxh3_128_intdigest(s.tobytes(), seed)
                n.append(len(s))
                names.append((d & (2**64 - 1)) - 2**63 if len(s) else None)
                more.append((d >> 64) - 2**63 if len(s) else None)
                sketches.append(sketch(s) if len(s) else None)
            touched = np.concatenate(buckets)
            np.add.at(counts, touched, np.uint16(1))
            counts[touched] = np.minimum(counts[touched], 255)
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(more, pa.int64()), pa.array(sketches, pa.binary()), *none], names_)
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts.astype(np.uint8), CHUNKS)] if counts.any() else []
        none = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names_)
        trim()

    schema = "doc_id long, n long, set long, more long, sketch binary, chunk int, counts binary"
    names_ = [x.split()[0] for x in schema.split(", ")]
    made = save(src.select("doc_id", "text").mapInArrow(run, schema), "profiles")

    tables = made.where("chunk is not null").select("chunk", "counts")
    levels = np.zeros(size, dtype=np.uint8)
    bins = -(-tables.count() // (CHUNKS * TABLES))
    tables = tables.withColumn("bin", F.pmod(F.xxhash64("counts"), F.lit(max(1, bins))))
    tables = tables.groupBy("chunk", "bin").applyInArrow(_adder("u1", "<u4"), "chunk int, counts binary")
    tables = tables.groupBy("chunk").applyInArrow(_adder("<u4", "<u8", last=True), "chunk int, counts binary")
    for chunk, raw in tables.collect():  # CHUNKS rows
        at = chunk * (size // CHUNKS)
        levels[at : at + size // CHUNKS] = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    return made.where("chunk is null").drop("chunk", "counts"), levels


def _adder(kind: str, total_kind: str, last: bool = False):
    """Add up packed tables of one kind of numbers to another, or to the levels of the sums."""

    def run(key, batch):
        total = np.zeros(1, dtype=total_kind)
        for x in batch["counts"]:
            total = total + np.frombuffer(zlib.decompress(x.as_py()), dtype=kind)
        if last:
            total = level(total)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    return run


def bitmap(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A filter of fixed size for the integers of a column: its words, and its number of bits."""
    n = ids.count()
    bits = 1 << 10
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    bit = f"pmod(xxhash64(`{column}`), {bits}L)"
    word = ids.selectExpr(f"cast({bit} div 32 as int) w", f"shiftleft(1L, cast({bit} % 32 as int)) b")
    out = np.zeros(bits // 32, dtype=np.int64)
    for w, b in word.groupBy("w").agg(F.bit_or("b")).collect():  # bits / 32 rows at most
        out[w] = b
    return out, bits


def maybe_in(words: np.ndarray, bits: int, column: str):
    """A boolean column: false only for integers that are not in the bitmap."""
    @F.pandas_udf("boolean")
    def test(bit: pd.Series) -> pd.Series:
        return pd.Series(_is_set(words, bit.to_numpy(np.int64)))

    return test(_bit(bits, column))


def _bit(bits: int, column: str):
    """The bit of a bitmap that stands for a column's integer."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(bits))


def _is_set(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which of these bits of a bitmap are set."""
    return (words[bit // 32] >> (bit % 32)) & 1 == 1


def jaccard_components(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, num: int = 9, den: int = 10
) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of df; sets link from a similarity of num / den on.

    component_id is the smallest doc_id that links reach. Null and empty texts, and texts without
    words, have no n-grams and link with nothing. A repeated row is linked with itself; a row with
    a null doc_id is counted, but not compared, and its component_id is null. Other columns are
    ignored. An empty table gives no rows. N-grams go by 64-bit hashes: n_shingles is short by one where two
    n-grams of one text collide (a chance of 1e-11 for 20,000 n-grams). Names of sets are tested for collisions.
    """
    spark = df.sparkSession
    src = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known, links = _links(src, words, num, den)
    roots = components(links)
    named = known.where("doc_id is not null and `set` is not null").groupBy("set").agg(F.min("doc_id").alias("least"))
    named = named.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = save(named, "named")
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(heads, "root").select("set", "component_id")
    out = known.select("doc_id", "n", "set").join(labels, "set", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _links(src: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows, and links (a, b) between sets."""
    spark, bands = src.sparkSession, Bands(num, den)
    bounded_batches(spark)
    for seed in range(8):
        known, levels = _profiles(src, words, seed)
        sets = known.where("`set` is not null and doc_id is not null").groupBy("set").agg(
            F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("sketch").alias("sketch"), F.min("more").alias("more"), F.max("more").alias("most")
        )
        sets = save(sets, "sets")
        if sets.where("more <> most").isEmpty():
            break  # else two sets share a name: take other names

    # Magnitude m: up to 2^m rows hold n-grams of the bucket. Hot is what has many, and far more than most.
    hot = max(HOT, int(np.median(levels >> FINE)) + 3)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # copies in one task are posted once; a third of all rows may be copies
        for b in batches:
            keys, salts, names, sizes = [], [], [], []
            for t in b.column(0):
                s = shingle_set(t.as_py(), words)
                if not len(s):
                    continue
                name = (xxhash.xxh3_128_intdigest(s.tobytes(), seed) & (2**64 - 1)) - 2**63
                if name in done:
                    continue
                if len(done) < REMEMBERED:
                    done.add(name)
                key, seen = rarest(s, levels, num, den)
                seen = seen >> FINE
                keys.append(key.view(np.int64))
                salts.append(np.where(seen > hot, 1 + name % (1 << np.minimum(np.maximum(seen.astype(np.int64) - hot, 0), 24)), 0).astype(np.int32))
                names.append(np.full(len(key), name, dtype=np.int64))
                sizes.append(np.full(len(key), bands.of(len(s)), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, salts, names, sizes)], ["key", "salt", "set", "band"])
        trim()

    posted = src.where("doc_id is not null").select("text").mapInArrow(post, "key long, salt int, set long, band int")
    # A set meets those of its band and the next, and those of its band and the one before, around the least of each.
    near_bands = lambda w, col: (F.min(col).over(w.rangeBetween(0, 1)), F.min(col).over(w.rangeBetween(-1, 0)))
    up, down = near_bands(Window.partitionBy("key", "salt").orderBy("band"), "set")
    both = posted.withColumn("up", up).withColumn("down", down).where("salt > 0 or `set` <> up or `set` <> down")
    both, columns = save_at(both, "columns")
    release(spark)
    # A column of more than so many documents is dealt by salt; its least sets are found by aggregation.
    least = both.where("salt > 0").groupBy("key", "band").agg(F.min("set").alias("m"))
    up, down = near_bands(Window.partitionBy("key").orderBy("band"), "m")
    least = save(least.select("key", "band", up.alias("up"), down.alias("down")), "least")
    many = both.where("salt > 0").drop("up", "down").join(least, ["key", "band"])
    pairs = both.where("salt = 0").select("set", "up", "down").unionByName(many.select("set", "up", "down"))
    pairs = pairs.select("set", F.explode(F.array("up", "down")).alias("head")).where("`set` <> head").select("head", "set").distinct()
    pairs = save(pairs, "pairs")
    drop(spark, columns)
    size = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("m")).select("head", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    size = save(size, "families")
    # The least member is in each part of its family.
    members = pairs.join(size, "head").select("head", "set", "parts", F.pmod(F.xxhash64("set"), "parts").cast("int").alias("part"))
    members = save(members, "members")
    heads = size.select("head", F.col("head").alias("set"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    tiles = members.select("head", "set", "part").unionByName(heads).join(sets.select("set", "n", "sketch"), "set")

    def sift(key, batch):
        """Members that the summaries leave a partner."""
        n = batch["n"].to_numpy().astype(np.int64)
        x = folded(batch["sketch"].to_pylist())
        keep = np.zeros(len(n), dtype=bool)
        for i in range(len(n) - 1):
            gap = np.abs(x[i + 1 :] - x[i]).sum(axis=1, dtype=np.int64)
            near = gap * (num + den) <= (den - num) * (n[i] + n[i + 1 :])
            keep[i + 1 :] |= near
            keep[i] |= near.any()
        return batch.filter(pa.array(keep)).select(["head", "part", "set"])

    near = tiles.groupBy("head", "part").applyInArrow(sift, "head long, part int, set long")
    near = save(near, "near")
    release(spark)
    tiles_of = save(_merged(near), "tiles")
    wanted = tiles_of.select("set").distinct()
    # Where a family is in parts, any member may meet one of another part: all of them are fetched.
    large = members.where("parts > 1").select("head", "set")
    far = large.select("set").union(size.where("parts > 1").select("head")).distinct()
    wanted = save(wanted.union(far).distinct().join(sets.select("set", F.col("doc_id").alias("holder")), "set"), "wanted")
    full = save(_fetch(src, wanted, words, seed), "fetched")
    release(spark)

    def overlap(key, batch):
        names, first = np.unique(batch["set"].to_numpy(), return_index=True)
        sets_ = [np.frombuffer(batch["columns"][int(k)].as_py(), dtype=U) for k in first]
        i, j = product(sets_, num, den)
        a, b = forest(names[i], names[j])
        if sum(map(len, sets_)) > LARGE:
            trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    tiled = tiles_of.join(full, "set").groupBy("head", "part").applyInArrow(overlap, "a long, b long")
    links = save(tiled, "links")
    if large.isEmpty():
        return known, links
    # Of two members that no links connect yet, one is outside the largest component of the family: those meet all parts.
    roots = save(components(links), "roots")
    labelled = large.join(roots.withColumnRenamed("node", "set"), "set", "left")
    labelled = save(labelled.select("head", "set", F.coalesce("root", "set").alias("root")), "labelled")
    per_root = labelled.groupBy("head", "root").agg(F.count(F.lit(1)).alias("m"))
    families = per_root.groupBy("head").agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("main"))
    # Sets of a family lie in the head's band or beside it, which bounds their sizes.
    families = families.join(sets.select(F.col("set").alias("head"), "n"), "head")
    families = families.withColumn("n", F.col("n") * (den * den) / (num * num) + den / num + 2)
    # As few parts as memory allows, since each member goes to all parts of the other side.
    parts = lambda m: F.ceil(F.greatest(m / ACROSS, m * F.col("n") / ENTRIES)).cast("int")
    m, main = F.col("m"), F.col("main")
    tasks = families.select("head", main["root"].alias("main"), parts(m).alias("parts"), parts(m - main["m"]).alias("rparts"))
    every = labelled.join(tasks.where("rparts > 0"), "head").select("head", "set", "parts", "rparts", (F.col("root") != F.col("main")).alias("apart"))
    every = save(every, "apart")
    one = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c, salt: F.pmod(F.xxhash64("set", F.lit(salt)), F.col(c)).cast("int")
    left = every.where("apart").select("head", "set", deal("rparts", 1).alias("i"), one("parts").alias("j"), F.lit(True).alias("is_row"))
    right = every.select("head", "set", F.pmod(F.xxhash64("set"), "parts").cast("int").alias("j"), one("rparts").alias("i"), F.lit(False).alias("is_row"))

    def across(key, batch):
        names = batch["set"].to_numpy()
        mark = batch["is_row"].to_numpy(zero_copy_only=False)
        first = dict(zip(names.tolist(), range(len(names)), strict=True))
        keep = np.array(sorted(first.values()))
        is_row = np.isin(names[keep], names[mark])
        sets_ = [np.frombuffer(batch["columns"][int(k)].as_py(), dtype=U) for k in keep]
        i, j = product(sets_, num, den, np.flatnonzero(is_row))
        a, b = forest(names[keep][i], names[keep][j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = left.unionByName(right).join(full, "set").groupBy("head", "i", "j").applyInArrow(across, "a long, b long")
    return known, links.union(save(met, "across"))


def _merged(near: DataFrame) -> DataFrame:
    """(head, part, set): the parts of near, where families that share members and have PART of them at most together are one.

    So a set goes to one task for all of its small families, and to one for each part of a large family.
    """
    roots = save(components(near.select(F.col("head").alias("a"), F.col("set").alias("b"))), "candidates")
    alone = near.select("head", "part", "set").join(roots.withColumnRenamed("node", "set"), "set", "left")
    alone = save(alone.withColumn("root", F.coalesce("root", "set")), "rooted")
    members = alone.select("root", "set").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    sized = alone.join(members, "root")
    small = sized.where(F.col("m") <= PART).select(F.col("root").alias("head"), F.lit(-1).alias("part"), "set").distinct()
    return small.unionByName(sized.where(F.col("m") > PART).select("head", "part", "set"))


def _fetch(src: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """(set, columns) of the wanted sets, from the texts of their documents.

    The bitmap is asked where the sets are made: a step of its own would need a second Python worker for each task, and
    idle workers are taken in turn, so that all of them would fill in later stages.
    """
    held, n = bitmap(wanted, "holder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()  # a row may be repeated any number of times
        for b in batches:
            ids, names, columns = [], [], []
            b = b.filter(pa.array(_is_set(held, b.column(2).to_numpy())))
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingle_set(t.as_py(), words)
                if not len(s):
                    continue
                name = (xxhash.xxh3_128_intdigest(s.tobytes(), seed) & (2**64 - 1)) - 2**63
                if (i, name) in done:
                    continue
                if len(done) < REMEMBERED:
                    done.add((i, name))
                ids.append(i)
                names.append(name)
                columns.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(columns, pa.binary())], ["holder", "set", "columns"])
        trim()

    some = src.where("doc_id is not null").select("doc_id", "text", _bit(n, "doc_id").alias("bit"))
    made = some.mapInArrow(run, "holder long, set long, columns binary")
    # A set comes from the document that holds it first, so once from each task that has a copy of that row.
    return made.join(wanted, ["holder", "set"], "left_semi").select("set", "columns")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs without those that link to one with a smaller doc_id: one of each group stays.

    Null and empty texts, and texts without words, link with nothing and stay. Of rows that repeat a doc_id one
    stays; rows with a null doc_id all stay. An empty table gives no rows. Only rows that a bitmap cannot clear
    are shuffled with their texts, and a row with a repeated id is pre-aggregated first.
    """
    found = jaccard_components(docs, doc_id, text, words, num, den).where("doc_id is not null")
    per = save(found.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n")), "groups")
    touched = per.where("c <> doc_id or n > 1").select(F.col("doc_id").alias("known"), (F.col("c") == F.col("doc_id")).alias("stays"))
    touched = save(touched, "touched")
    bits, n = bitmap(touched, "known")
    rows = whole_rows(docs, id=F.col(f"`{doc_id}`").cast("long"))
    rows = rows.withColumn("maybe", F.coalesce(F.col("id").isNotNull() & maybe_in(bits, n, "id"), F.lit(False)))
    clear = rows.where("not maybe").select("row")
    some = rows.where("maybe").join(touched, F.col("id") == F.col("known"), "left").where("known is null or stays")
    once = some.groupBy("id").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return clear.unionByName(once).select("row.*")

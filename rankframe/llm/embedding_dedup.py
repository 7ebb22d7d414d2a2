"""Near-duplicate vectors by spherical-cap filters with random product codes.

A filter is a direction; vectors with high inner products to it lie in a cap around it. Directions
are all combinations of one random codeword per block of dimensions: each vector finds the filters
nearest to it by list decoding, from a few inner products per block, however many filters there
are. Filters that differ in their last codeword only are joined together, as a bundle: vectors that share a
bundle are compared exactly. The number of filters grows with the number of vectors, so that a bundle
holds about as many unrelated vectors at every size. Every vector lists equally many filters of each of
several independent codes. As a code is rotated at random and a list depends on its vector alone, the
chance that a pair shares no bundle depends on its cosine only, not on the data: it is measured when the
codes are drawn, and codes are added until it is small enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import bounded_batches, save
from rankframe.llm.components import components, forest

THRESHOLD = 0.9
#: Bundles that a vector is in at least, filters that it lists of one code, and vectors in a bundle, about.
LISTED, PER_CODE, IN_BUNDLE = 2, 4, 1024
#: Chance that a pair just at the threshold shares no bundle, and pairs by which it is measured.
MISS, TRIALS = 0.005, 2000
#: Fewest and most codewords of a block.
FEW_WORDS, WORDS = 16, 4096
#: Rows of a tile of the exact comparison.
TILE = 1024
SEED = 11
#: Matrix products of unit vectors are this near to their cosines.
CLOSE = 1e-12


Code = tuple[np.ndarray, list[np.ndarray]]


def code(n: int, dim: int, rng: np.random.Generator) -> Code:
    """A random rotation, and the codewords of each block, for n vectors of dim dimensions."""
    bundles = max(1.0, 3.0 * n / IN_BUNDLE)  # a vector's filters of a code are in about three bundles
    blocks = 2 if dim >= 8 else 1
    while bundles ** (1 / max(1, blocks - 1)) > WORDS and 4 * (blocks + 1) <= dim:
        blocks += 1
    words = min(WORDS, max(FEW_WORDS, math.ceil(bundles ** (1 / max(1, blocks - 1)))))
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    books = []
    for part in np.array_split(np.arange(dim), blocks):
        book = rng.standard_normal((words, len(part)))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
    return turn, books


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each row, best first."""
    k = min(k, scores.shape[1])
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(scores, at, 1), axis=1), 1)


def decode(x: np.ndarray, code: Code) -> np.ndarray:
    """For each unit row of x, the numbers of the PER_CODE filters with the highest inner products."""
    turn, books = code
    out = []
    for part in np.array_split(x, max(1, math.ceil(len(x) / 256))):
        part, total, names, at = part @ turn, None, None, 0
        for book in books:
            scores = part[:, at : at + book.shape[1]] @ book.T
            at += book.shape[1]
            own = _best(scores, PER_CODE)
            scores = np.take_along_axis(scores, own, 1)
            if total is None:
                total, names = scores, own
                continue
            # The i-th best of one side and the j-th of the other have i * j sums at least as high.
            i, j = np.nonzero(np.outer(np.arange(1, total.shape[1] + 1), np.arange(1, own.shape[1] + 1)) <= PER_CODE)
            total, names = total[:, i] + scores[:, j], names[:, i] * len(book) + own[:, j]
            best = _best(total, PER_CODE)
            total, names = np.take_along_axis(total, best, 1), np.take_along_axis(names, best, 1)
        out.append(names)
    return np.concatenate(out)


def bundled(x: np.ndarray, code: Code) -> np.ndarray:
    """The bundles of the filters that decode() lists: their codewords but the last one; with one block, the filters."""
    found = decode(x, code)
    return found // len(code[1][-1]) if len(code[1]) > 1 else found


def missed(code: Code, threshold: float, rng: np.random.Generator) -> float:
    """Share of random pairs with that cosine that share no bundle of a code."""
    dim = len(code[0])
    if dim < 2 or not -1 < threshold < 1:
        return 0.0
    x, u = rng.standard_normal((2, TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    return float((bundled(x, code)[:, :, None] != bundled(y, code)[:, None, :]).all(axis=(1, 2)).mean())


def codes(n: int, dim: int, threshold: float = THRESHOLD, listed: int = LISTED, seed: int = SEED) -> list[Code]:
    """Independent codes for n vectors of dim dimensions; none where comparing all pairs is no more work."""
    rng = np.random.default_rng(seed)
    first = code(n, dim, rng)
    lost = min(max(missed(first, threshold, rng), 1 / TRIALS), 1 - 1 / TRIALS)
    rounds = max(1, listed, math.ceil(math.log(MISS) / math.log(lost)))
    if n <= IN_BUNDLE:
        return []
    return [first] + [code(n, dim, rng) for _ in range(rounds - 1)]


def filters(x: np.ndarray, drawn: list[Code]) -> list[np.ndarray]:
    """For each unit row of x, the bundles of all codes that it is in, by number, ascending; without codes, one for all."""
    if not drawn:
        return [np.zeros(1, dtype=np.int32)] * len(x)
    books = drawn[0][1]
    size = math.prod(len(b) for b in (books[:-1] or books))
    found = np.concatenate([bundled(x, c) + k * size for k, c in enumerate(drawn)], axis=1).astype(np.int32)
    return [np.unique(row) for row in found]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by powers of two, which rounds nothing, so that the largest component is near one and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit_rows(values) -> np.ndarray:
    """Rows of length one."""
    x = scaled(np.array(values, dtype=np.float64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors from exactly rounded sums, so that it does not depend on the order of the components or vectors."""
    a, b = scaled(a), scaled(b)
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def linked(raw: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows a link with which rows b: by a matrix product, and by cosine() where that is too close to the threshold to tell.

    A product of matrices rounds a pair differently from tile to tile; this way all tiles agree.
    """
    product = x[a] @ x[b].T
    hit = product >= threshold
    for i, j in zip(*np.nonzero(np.abs(product - threshold) < CLOSE), strict=True):
        hit[i, j] = cosine(raw[a[i]], raw[b[j]]) >= threshold
    return hit


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, listed: int = LISTED
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of df.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, and
    vectors of different dimensions do not link with each other. Equal vectors are compared once:
    a row's links are all other rows whose cosine, in double precision, is at least threshold.
    Pairs of which the chance to share no bundle is at most MISS at the threshold, and lower above
    it, may be missed; none is wrong. Repeated rows are vectors of their own. A null vec_id comes out with null component_id and
    kept, and still counts as a link of others. Other columns are ignored.
    """
    spark = df.sparkSession
    src = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    fine = F.coalesce(fine & F.exists("v", lambda e: e != 0), F.lit(False))
    src = src.withColumn("v", F.when(fine, F.transform("v", lambda e: e + F.lit(0.0))))  # -0.0 equals 0.0
    src = save(src.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256))), "vectors")
    distinct = src.where("v is not null").groupBy("key").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"))
    for seed in range(8):
        reps = save(distinct.withColumn("id", F.xxhash64("key", F.lit(seed))).withColumn("d", F.size("v")), "distinct")
        if reps.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break  # else two vectors share a name: take other names
    sizes = {r["d"]: r["n"] for r in reps.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per dimension
    found = [_linked(reps.where(F.col("d") == d), d, n, threshold, listed) for d, n in sizes.items() if n > 1]
    if found:
        both = found[0]
        for more in found[1:]:
            both = both.union(more)
        both = save(both, "tiles")
    else:
        both = spark.createDataFrame([], "a long, b long, n long")
    counts = both.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(both.where("a <> b").select("a", "b")).withColumnRenamed("node", "id")
    known = reps.select("key", "id", "w", "least").join(counts, "id", "left").join(roots, "id", "left")
    known = save(known.withColumn("root", F.coalesce("root", "id")), "known")
    heads = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(heads, "root").select("key", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = src.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _linked(reps: DataFrame, dim: int, n: int, threshold: float, listed: int) -> DataFrame:
    """(a, b, n): for each a the weight of its partners in a tile, and links (a, b) that connect them (n = 0)."""
    bounded_batches(reps.sparkSession)
    drawn = codes(n, dim, threshold, listed)

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.array(b.column(1).to_pylist(), dtype=np.float64)
            with np.errstate(over="ignore"):
                short = raw.astype("<f4")
            fits = (short == raw).all(axis=1)  # then four bytes a component say as much as eight
            packed = [(s if f else r).tobytes() for s, r, f in zip(short, raw, fits, strict=True)]
            found = pa.array(filters(unit_rows(raw), drawn), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary()), found], ["id", "w", "v", "filters"])

    lists = save(reps.select("id", "v", "w").mapInArrow(listing, "id long, w long, v binary, filters array<int>"), "filters")
    passed = lists.withColumn("f", F.explode("filters"))
    # A row per bundle; a vector goes to each of its bundles once, or to each tile that its part of a full one is in.
    caps = passed.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    caps = save(caps.select("f", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), "bundles")
    dealt = passed.join(caps, "f").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    one = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiles = dealt.withColumn("other", one).select("f", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "w", "v", "filters")

    def compare(key, batch):
        f, i, j = (k.as_py() for k in key)
        ids, w = batch["id"].to_numpy(), batch["w"].to_numpy()
        part = batch["part"].to_numpy()
        raw = np.stack([np.frombuffer(v, dtype="<f4" if len(v) == 4 * dim else "<f8") for v in batch["v"].to_pylist()]).astype(np.float64)
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        hit = linked(raw, unit_rows(raw), a, b, threshold)
        if i == j:
            np.fill_diagonal(hit, False)
        ra, rb = a[hit.any(axis=1)], b[hit.any(axis=0)]
        if not len(ra):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        hit = hit[np.ix_(hit.any(axis=1), hit.any(axis=0))]
        # A pair counts in the first of the bundles that both are in.
        lists_ = batch["filters"]
        rows = np.unique(np.r_[ra, rb])
        before = [np.asarray(lists_[int(r)].values) for r in rows]
        before = [q[q < f] for q in before]
        names, at, times = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(rows)), [len(q) for q in before]), times[at] > 1
        has = np.zeros((len(rows), max(1, int((times > 1).sum()))), dtype=np.float32)
        has[row[shared], (np.cumsum(times > 1) - 1)[at[shared]]] = 1
        fresh = hit & ((has[np.searchsorted(rows, ra)] @ has[np.searchsorted(rows, rb)].T) == 0)
        ends = np.nonzero(hit)
        fa, fb = forest(ids[ra][ends[0]], ids[rb][ends[1]])
        ca, cb = fresh @ w[rb], (fresh.T @ w[ra] if i != j else np.zeros(len(rb), dtype=np.int64))
        na, nb = ids[ra][ca > 0], ids[rb][cb > 0]
        return pa.table({
            "a": np.concatenate([na, nb, fa]), "b": np.concatenate([na, nb, fb]),
            "n": np.concatenate([ca[ca > 0], cb[cb > 0], np.zeros(len(fa), dtype=np.int64)]).astype(np.int64),
        })

    return tiles.groupBy("f", "i", "j").applyInArrow(compare, "a long, b long, n long")

"""What the operators of this subpackage share: tables in the shared folder,
bounded Arrow batches, exact ranks under hot keys."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Java's form of "a run of characters other than ASCII white space".
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch. Texts are long, so the default of 10,000 is too many.
BATCH_ROWS = 400

_roots: dict[str, str] = {}
_caches: dict[str, dict] = {}


def worker_cache(owner: str, name: str) -> dict:
    """A dictionary that lives as long as the Python worker, or until another owner asks for one.

    Workers are reused by later stages, which would else run beside what earlier ones kept.
    """
    key = f"{owner}.{name}"
    if key not in _caches:
        for k in [k for k in _caches if not k.startswith(f"{owner}.")]:
            del _caches[k]
        _caches[key] = {}
    return _caches[key]


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local session (tests) gets a temporary folder; any other
    session must set it, as executors could not see the driver's files.
    """
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir"):
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"file://{tempfile.mkdtemp(prefix='rankframe-')}"
    return _roots[app]


def trim() -> None:
    """Give memory that a Python worker has freed back to the system.

    Idle workers stay beside the executor's JVM, and their allocators keep what they once used.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor.
    """
    return save_at(df, tag)[0]


def save_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As save(), with the path, for drop()."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of save_at() that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are done: it does so once the driver has collected their plans as garbage."""
    spark._jvm.java.lang.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most BATCH_ROWS rows, as a few long texts fill the memory.

    Spark reads this session option when a query starts, which may be long after an operator returned
    its frame. So all operators ask for the same bound, and none raises one that is lower. Spark's own
    bound by bytes (spark.sql.execution.arrow.maxBytesPerBatch) holds besides.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def whole_rows(df: DataFrame, **more: Column) -> DataFrame:
    """Each row of df as one column ``row``, beside columns of an operator's own, whose names cannot clash then.

    select("row.*") gives df's columns back.
    """
    return df.select(F.struct(*columns(df)).alias("row"), *[c.alias(n) for n, c in more.items()])


def map_texts(
    df: DataFrame,
    carry: Sequence[str],
    texts: str,
    fn: Callable[[list], dict[str, list]],
    out: str,
) -> DataFrame:
    """A row for each row: the columns carry, and what fn makes of the batch's texts.

    out is the DDL of the columns that fn returns. All other columns of df are left out,
    so that their names cannot clash with those of out.
    """
    bounded_batches(df.sparkSession)
    src = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{texts}`").alias("__text"))
    extra = df.sparkSession.createDataFrame([], out).schema
    schema = src.drop("__text").schema
    for field in extra:
        schema = schema.add(field)
    names = [f.name for f in extra]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn(b.column(len(b.schema.names) - 1).to_pylist())
            cols = [b.column(i) for i in range(len(b.schema.names) - 1)]
            cols += [pa.array(got[n], type=arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], *names])
        trim()

    return src.mapInArrow(run, schema)


def rank_bits(rows: int) -> int:
    """For spread_rank(): so many bits that a range of a key which holds all rows has about a million of them, and 64 ranges at least."""
    return max(6, (rows >> 20).bit_length())


def spread_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str, bits: int, hashed: bool = False) -> DataFrame:
    """Add column rank: 0, 1, .. within the keys, in the order of the hash of ``order``, or with hashed of its first column, a hash.

    A key may hold a third of all rows: each key is dealt into 2**bits ranges of the hash (see
    rank_bits()), ranked by themselves, and shifted by the counts of the ranges before. Rows that agree
    in ``order`` are interchangeable, so reruns give the same rows. Null keys are a key.
    """
    h = F.col(order[0]) if hashed else F.xxhash64(*[F.col(c) for c in order])
    part = F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(2**63))), 64 - bits).cast("int")
    dealt = df.withColumn("__h", h).withColumn("__part", part)
    for i, k in enumerate(keys):
        dealt = dealt.withColumn(f"__k{i}", F.struct(F.col(k).isNull().alias("n"), F.col(k).alias("v")))
    ks = [f"__k{i}" for i in range(len(keys))]
    counts = dealt.groupBy(*ks, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*ks).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*ks, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*ks, "__part").orderBy("__h", *order)
    ranked = dealt.withColumn("__r", F.row_number().over(within) - 1)
    joined = ranked.join(shift, [*ks, "__part"])
    return joined.withColumn(rank, (F.col("__r") + F.col("__before")).cast("long")).drop(
        *ks, "__part", "__h", "__n", "__r", "__before"
    )

"""Tables in the folder that driver and executors share, which cut the lineage with files that outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session gets a temporary folder; any other must set it."""
    if root := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='rankframe-')}"
    return _local[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

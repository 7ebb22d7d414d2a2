"""Streaming forms of accumulate, insert-unique and slot reuse on event tables: extensions with watermarks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankframe.sources.shared import new_path


def windowed_statistics(events: DataFrame, ts: str, by: str, value: str, width: str, delay: str) -> DataFrame:
    """Statistics per window and group of a stream or table; late rows beyond the delay are dropped from a stream."""
    x = F.col(value)
    got = events.withWatermark(ts, delay).groupBy(F.window(ts, width), by).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("total_sq"), F.min(x).alias("least"), F.max(x).alias("greatest")
    )
    return got.select(F.col("window")["start"].alias("start"), by, "n", "total", "total_sq", "least", "greatest")


def first_seen(events: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first event of each key within the delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def recycle_stream(events: DataFrame, by: str, pos: str, op: str, arg: str) -> DataFrame:
    """(by, pos, slot) of slot stores whose operations come as a stream, each batch in the order of pos.

    A store's state is its stack of free slots and how many it has made.
    """
    names = dict(events.dtypes)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, used = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        every = pd.concat(list(batches)).sort_values(pos)
        slots = []
        for o, a in zip(every[op], every[arg], strict=True):
            if o == "remove":
                free.append(int(a))
                slots.append(int(a))
            elif free:
                slots.append(free.pop())
            else:
                slots.append(used)
                used += 1
        state.update((json.dumps(free), used))
        yield pd.DataFrame({by: key[0], pos: every[pos].to_numpy(), "slot": slots})

    return events.select(by, pos, op, arg).groupBy(by).applyInPandasWithState(
        fold, f"`{by}` {names[by]}, `{pos}` {names[pos]}, slot long", "free string, used long", "append", GroupStateTimeout.NoTimeout
    )


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has made of all that its source has now, as a table in the shared folder."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

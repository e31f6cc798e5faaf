"""Incremental ingest with Structured Streaming: new files into the lake, late bars by compaction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import clean
from ..session import scratch
from ..sources import lake

#: Instants in packed bars, to the microsecond.
PACKED = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Milliseconds after which the bars of an id's month are forgotten, if no file has brought any.
IDLE = 30 * 86_400_000


def ingest(spark: SparkSession, source: str, root: str, schema: T.StructType | str, checkpoint: str, keys: list[str] = lake.KEYS) -> StreamingQuery:
    """Append the bars of files that came since the last call, each once; ends when all are in."""
    bars = spark.readStream.schema(schema).option("recursiveFileLookup", "false").parquet(source)
    out = lake.shaped(bars, keys).writeStream.format("parquet").partitionBy(*keys)
    return out.option("path", root).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _merge(root: str, schema: T.StructType | str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        staged = scratch(batch.sparkSession, "staged")
        own = [F.desc(c) for c in batch.columns if c not in ("file_time", "file_path")]
        newest = clean.keep_last(batch, [*keys, "tick"], [F.desc("file_time"), F.desc("file_path"), *own]).drop("file_time", "file_path")
        lake.write_lake(newest, staged, keys=keys)
        if lake.exists(batch.sparkSession, root):
            lake.compact(batch.sparkSession, root, staged, schema, keys, clear=True)
        else:
            lake.write_lake(batch.sparkSession.read.schema(schema).parquet(staged), root, keys=keys)
            lake.empty(batch.sparkSession, staged)

    return merge


def _arriving(spark: SparkSession, source: str, schema: T.StructType | str) -> DataFrame:
    bars = spark.readStream.schema(schema).parquet(source)
    return bars.select("*", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file_path"))


def ingest_merged(spark: SparkSession, source: str, root: str, schema: T.StructType | str, checkpoint: str, keys: list[str] = lake.KEYS) -> StreamingQuery:
    """As ingest(), but each batch is merged into the lake: the last bar of a tick wins, however late it comes. Within a
    batch that is the one from the newest file; of bars in one file the greatest, by its columns."""
    out = _arriving(spark, source, schema).writeStream.foreachBatch(_merge(root, schema, keys))
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_changed(spark: SparkSession, source: str, root: str, schema: T.StructType | str, checkpoint: str, keys: list[str] = lake.KEYS, idle: int = IDLE) -> StreamingQuery:
    """As ingest_merged(), with the same lake in the end, but only bars that differ from what the stream last had for their
    tick are merged, so a vendor's file that comes again rewrites no partition. The lake must not be changed otherwise."""
    out = changed(_arriving(spark, source, schema), keys, idle).writeStream.foreachBatch(_merge(root, schema, keys)).outputMode("append")
    return started(spark, out.option("checkpointLocation", checkpoint).trigger(availableNow=True))


def started(spark: SparkSession, stream: DataStreamWriter) -> StreamingQuery:
    """Start a stream with timeouts that is to end when all is in: a query takes the setting as it is at its start. Else
    Spark runs batches without data for ever, to see what has timed out; so that is seen to in batches with data."""
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return stream.start()
    finally:
        spark.conf.set(setting, before)


def changed(bars: DataFrame, keys: list[str] = lake.KEYS, idle: int = IDLE) -> DataFrame:
    """The bars of a stream (with file_time and file_path) that differ from what it last had for their tick.

    The state of an id's month (of a value of `keys`) is a hash for each tick: of all bars that the newest file has for it,
    since these decide which one wins. A bar that was replaced and comes back is a change again. There is no watermark, as
    late bars count however late they are; a month that has had no bars for `idle` milliseconds is forgotten instead, and
    what comes after that is passed on, changed or not. Bars travel as packed text, so no number is rounded on the way.
    """
    data = [c for c in bars.columns if c not in ("file_time", "file_path")]
    packed = bars.select(
        *(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"{k}_of") for k in keys),
        F.coalesce(F.col("tick").cast("string"), F.lit("")).alias("tick_of"),
        F.struct("file_time", "file_path").cast("string").alias("file_of"),
        F.to_json(F.struct(*bars.columns), PACKED).alias("packed"),
        F.xxhash64(*data).alias("version"),
    )

    def differing(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts), ignore_index=True)
        rows = rows[rows["file_of"] == rows.groupby("tick_of")["file_of"].transform("max")].drop_duplicates(["tick_of", "version"])
        now = rows.groupby("tick_of")["version"].sum()  # of 64-bit numbers: it wraps, whatever their order
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        new = {tick for tick, version in now.items() if held.get(tick) != version}
        held.update({tick: int(version) for tick, version in now.items()})
        state.update((list(held), list(held.values())))
        state.setTimeoutDuration(idle)
        if new:
            yield rows.loc[rows["tick_of"].isin(new), ["packed"]]

    grouped = packed.groupBy(*(f"{k}_of" for k in keys))
    kept = grouped.applyInPandasWithState(differing, "packed string", "ticks array<string>, versions array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return kept.select(F.from_json("packed", bars.schema, PACKED).alias("bar")).select("bar.*")

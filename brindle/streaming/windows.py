"""Continuous queries over an event stream: windows with late data, sessions, dedup, incremental postings.

Each function takes a streaming or a batch DataFrame; the same plan answers both.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import shared_root


def read_stream(spark: SparkSession, path: str, schema: object, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return _timed(df, ts).withWatermark(ts, delay) if df.isStreaming else df


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need instants; a local time is taken in the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts] == "timestamp_ntz" else df


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], delay: str = "1 hour", slide: str | None = None, **aggregates: object) -> DataFrame:
    """Tumbling or, with a slide, sliding windows."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = _late(df, ts, delay).groupBy(window.alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], delay: str = "1 hour", **aggregates: object) -> DataFrame:
    """Sessions that end after a gap without events of the key."""
    out = _late(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)


def deduplicated(df: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """One event for each key, remembered for the delay."""
    return _timed(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, one file or a folder of files, as a stream."""
    path = f"{folder}/{name}.parquet"
    reader, at = spark.readStream.schema(spark.read.parquet(path).schema), spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)  # streams read folders


#: The state of a stream is as large as its keys: on the executors' disks, not in their heaps, with bounded buffers.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


def run_to_end(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over all data there is now and return the result table, which executors write to the shared folder; name becomes a view of it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows"))
    last = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/__batch={number}")
        last.append(number)

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        query = df.writeStream.foreachBatch(put).queryName(name).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state"), True)
    # In complete mode each batch is the whole table.
    whole = f"{path}/rows/__batch={last[-1]}" if mode == "complete" and last else f"{path}/rows"
    out = spark.read.schema(df.schema).parquet(whole).select(*df.columns)
    out.createOrReplaceTempView(name)
    return out

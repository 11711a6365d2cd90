"""Streaming counterparts over device events: last seen, rate limits, bursts, replays, incremental work.

Each takes and returns a streaming (or batch) DataFrame of device, ts, ...; ``drained`` runs one to
the end of what its source has now.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.graph import scratch


def events(spark: SparkSession, path: str) -> DataFrame:
    """A streaming DataFrame of a Parquet table of events."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def last_seen(df: DataFrame, device: str) -> DataFrame:
    """Latest event time and count of each device; late events never move it back."""
    return df.groupBy(device).agg(F.max("ts").alias("last_seen_at"), F.count("*").alias("n"))


def rate_windows(df: DataFrame, device: str, window: str, late: str) -> DataFrame:
    """Events of each device in fixed windows; rows later than ``late`` are dropped."""
    rows = df.withWatermark("ts", late).groupBy(device, F.window("ts", window)).agg(F.count("*").alias("n"))
    return rows.select(device, F.col("window.start").alias("start"), "n")


def once(df: DataFrame, key: str, within: str) -> DataFrame:
    """Rows whose key did not come before within the watermark."""
    return df.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def lockouts(df: DataFrame, device: str, base: int, most: int) -> DataFrame:
    """After each batch: failures of each device so far and the lock in seconds, doubling up to ``most``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({device: [key[0]], "failures": [n], "lock_s": [min(most, base * 2 ** min(n - 1, 10))]})

    return df.groupBy(device).applyInPandasWithState(run, f"{device} long, failures long, lock_s long", "n long", "update", "NoTimeout")


def incremental(df: DataFrame, key: str, reviewed: str, out: str, marks: str) -> None:
    """Reads what ``df`` has now and adds to the Parquet table ``out`` the rows whose key is new: neither in ``reviewed`` (a
    Parquet table of keys, which may have grown since the last run) nor in ``out``; of rows of a batch with the same key the first by ts.

    Each batch writes the partition of its number, and looks for known keys in the others only, so a batch that is replayed after a
    failure replaces what it wrote. Another run goes on where ``marks`` says.
    """
    spark = df.sparkSession
    schema = df.schema

    def put(batch: DataFrame, k: int) -> None:
        old = spark.read.schema(f"{key} {schema[key].dataType.simpleString()}").option("recursiveFileLookup", "true").parquet(reviewed)
        first = batch.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("ts"))).where("_k = 1").drop("_k")
        fresh = first.join(old, key, "left_anti")
        if table_there(spark, out):
            done = spark.read.schema(f"{key} {schema[key].dataType.simpleString()}, batch long").parquet(out)
            fresh = fresh.join(done.where(F.col("batch") != k).select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={k}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def table_there(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, in whatever store its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drained(df: DataFrame, mode: str, spark: SparkSession) -> DataFrame:
    """What a streaming DataFrame gives when its source has been read to the end.

    complete: the last batch's whole result; append and update: all rows of all batches.
    """
    out, marks = scratch(spark), scratch(spark)

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={k}")

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out if mode == "complete" else f"{out}/batch=*")

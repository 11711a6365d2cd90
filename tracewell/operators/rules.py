"""Rules over events, custody, chronology and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bursts(events: DataFrame, key: str, seconds: str, window: int, least: int) -> DataFrame:
    """Of each key, the first event (start_s) from which at least ``least`` events (n) fall within ``window`` seconds."""
    w = Window.partitionBy(key).orderBy(seconds).rangeBetween(0, window)
    hot = events.withColumn("n", F.count("*").over(w)).where(F.col("n") >= least)
    first = hot.groupBy(key).agg(F.min(F.struct(F.col(seconds).alias("s"), F.col("n"))).alias("x"))
    return first.select(key, F.col("x.s").alias("start_s"), F.col("x.n").alias("n"))


def hash_status(source: Column, expected: Column) -> Column:
    """match, mismatch, missing_source, missing_expected, or unsupported for digests that are not SHA-256."""
    sha = r"^[0-9a-fA-F]{64}$"
    return F.when(source.isNull() | (source == ""), "missing_source").when(expected.isNull() | (expected == ""), "missing_expected").when(~expected.rlike(sha) | ~source.rlike(sha), "unsupported").when(F.lower(source) == F.lower(expected), "match").otherwise("mismatch")


def legal_steps(changes: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Adds ``legal``: whether each (old, new) pair is one of ``allowed``; staying is legal."""
    table = F.broadcast(changes.sparkSession.createDataFrame(allowed, "old string, new string").withColumn("_ok", F.lit(True)))
    return changes.join(table, ["old", "new"], "left").withColumn("legal", (F.col("old") == F.col("new")) | F.coalesce("_ok", F.lit(False))).drop("_ok")

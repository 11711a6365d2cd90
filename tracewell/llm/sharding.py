"""Longest-processing-time scheduling of groups onto shards.

A group (rows with equal texts) stays together. Groups, sorted by size, go one by one to the
least-loaded shard of a heap. Groups of equal size are a class, and only classes (size and number of
groups) reach the driver: their sizes differ, so of B bytes in all there are at most sqrt(2 B). A
class is served at once: while the shards at the bottom of the heap fill up to the next one, they
take groups in turn, so the groups of a class fall into at most one stretch of turns a shard. Each
group then finds its shard from its place among the groups of its class.

Defined results: a null text has no bytes and is grouped with the empty one; each row counts its
bytes plus 1; equal loads go to the lower shard and equal sizes are taken by the hash of the text;
repeated rows are copies like any other; slots follow doc_id, null first, then the order of reading;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import running_start, staged

#: Classes up to which their table is broadcast.
BROADCAST = 20_000
#: Rows of a group from which it is joined through a table of such groups, if that is small.
MANY = 10_000


def turns(loads: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """How ``count`` groups of one size are dealt out, the least-loaded shard first; ``loads`` are updated.

    Stretches (first group, shards): the groups from there on go to these shards in turn.
    """
    waiting = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(waiting)
    out, first, active = [], 0, [heapq.heappop(waiting)]
    while first < count:
        # how many groups the active shards take before the next one is due
        if waiting:
            load, s = waiting[0]
            room = sum(max(0, (load - x + size - 1) // size + (1 if (load - x) % size == 0 and y < s and load >= x else 0)) for x, y in active)
        else:
            room = count
        active.sort()
        n, k = min(room, count - first), len(active)
        if n:
            out.append((first, [y for _, y in active]))
            active = [(x + size * (n // k + (i < n % k)), y) for i, (x, y) in enumerate(active)]
            first += n
        if waiting:
            active.append(heapq.heappop(waiting))
    for x, y in active:
        loads[y] = x
    return out


def schedule(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """Stretches of turns for each class (size, number of groups), the largest first."""
    loads = [0] * shards
    return [(size, turns(loads, size, count)) for size, count in sorted(classes, reverse=True)]


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """Slim rows of ``docs`` (doc_id, text): doc_id, size, text_crc32, group, shard, slot.

    Four shuffles of slim rows: groups, their places, their rows, and slots.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
    rows = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "shard")
    groups = rows.groupBy("group").agg(F.sum("size").alias("total"), F.count("*").alias("copies"))
    groups = staged(groups.withColumns({"h": F.xxhash64("group"), "one": F.lit(1)}), "groups")
    classes = [tuple(r) for r in groups.groupBy("total").count().orderBy("total").collect()]
    starts, at = {}, 0
    for size, count in classes:
        starts[size], at = at, at + count
    table = [(size, starts[size], out) for size, out in schedule(classes, shards)]
    table = spark.createDataFrame(table, "total long, start long, turns array<struct<first:long,shards:array<int>>>")
    if len(classes) <= BROADCAST:
        table = F.broadcast(table)
    placed = running_start(groups, ["total", "h", "group"], "one", "place").join(table, "total")
    mine = F.element_at(F.filter("turns", lambda t: t["first"] <= F.col("place") - F.col("start")), -1)
    i = F.call_function("mod", F.col("place") - F.col("start") - F.col("_t.first"), F.size("_t.shards")).cast("int")
    placed = placed.withColumn("_t", mine).select(F.col("group"), "copies", F.element_at("_t.shards", i + 1).alias("shard"))
    placed = staged(placed, "groups")
    hot = placed.where(F.col("copies") >= MANY).select(F.col("group").alias("big"), F.col("shard").alias("own"))
    if hot.limit(BROADCAST + 1).count() <= BROADCAST:
        # rows of large groups need no shuffle, which would bring each group to one task
        rows = rows.join(F.broadcast(hot), F.col("group") == F.col("big"), "left").drop("big")
        large, rows = rows.where("own is not null").withColumnRenamed("own", "shard"), rows.where("own is null").drop("own")
        rows = rows.join(placed.drop("copies"), "group").unionByName(large)
    else:
        rows = rows.join(placed.drop("copies"), "group")
    rows = staged(rows.select("doc_id", "rid", "size", "text_crc32", "group", "shard", F.lit(1).alias("one")), "shard")
    return running_start(rows, ["doc_id", "rid"], "one", "slot", ["shard"]).drop("one", "rid")


def op9_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """All of ``documents`` on 16 shards of near equal bytes."""
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

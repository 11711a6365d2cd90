"""Entity matching, typed relationships from mentions, and merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text

#: Order in which typed pairs of mentions are read, and the relationship of each. Fixed values.
PAIRS = (
    ("person", "phone", "called"), ("person", "vehicle", "owns"), ("person", "account", "owns"), ("person", "organization", "works_for"), ("person", "location", "located_at"),
    ("person", "event", "associated_with"), ("phone", "phone", "called"), ("phone", "location", "visited"), ("vehicle", "location", "visited"), ("organization", "location", "located_at"),
    ("event", "location", "visited"), ("account", "account", "transferred_to"), ("organization", "organization", "associated_with"),
)
AUTO, REVIEW = 92.0, 78.0


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit by bit."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - bin(row & ((1 << len(a)) - 1)).count("1")


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * longest common subsequence / lengths; 100 for two empty texts, null for a null one."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else 100.0 if not p and not q else 200.0 * _common(p, q) / (len(p) + len(q)) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def proposals(entities: DataFrame, review: float = REVIEW, auto: float = AUTO) -> DataFrame:
    """a, b, score, band of pairs in one block whose names are alike; exact ones score 100.

    Lengths bound the ratio from above, so most pairs are dropped before any text is compared.
    """
    e = entities.select("entity_id", "entity_type", "canonical_value").withColumn("block", text.blocking_key(F.col("entity_type"), F.col("canonical_value")))
    # equal names meet once, so copies of a name are no square
    names = e.groupBy("entity_type", "block", "canonical_value").agg(F.min("entity_id").alias("id"))
    x = names.select("entity_type", "block", F.col("id").alias("a"), F.col("canonical_value").alias("va"))
    y = names.select("entity_type", "block", F.col("id").alias("b"), F.col("canonical_value").alias("vb"))
    bound = 200 * F.least(F.length("va"), F.length("vb")) / (F.length("va") + F.length("vb"))
    near = x.join(y, ["entity_type", "block"]).where((F.col("a") < F.col("b")) & (bound >= review)).withColumn("score", indel_ratio(F.col("va"), F.col("vb"))).where(F.col("score") >= review)
    same = e.join(names, ["entity_type", "block", "canonical_value"]).where("entity_id <> id").select(F.col("id").alias("a"), F.col("entity_id").alias("b"), F.lit(100.0).alias("score"))
    return near.select("a", "b", "score").union(same).select("a", "b", F.round("score", 2).alias("score"), F.when(F.col("score") >= auto, "strong").otherwise("ambiguous").alias("band"))


def structured_relationships(mentions: DataFrame, most: int = 15) -> DataFrame:
    """record_id, src, dst, rel_type from mentions (record_id, kind, id, pos) of a record, at most ``most`` each.

    Pairs of one kind go from the lesser id to the greater.
    """
    from pyspark.sql import Window

    plan = F.broadcast(mentions.sparkSession.createDataFrame([(k, *p) for k, p in enumerate(PAIRS)], "step int, ka string, kb string, rel_type string"))
    m = mentions.select("record_id", "kind", "id").distinct()
    a, b = m.select("record_id", F.col("kind").alias("ka"), F.col("id").alias("src")), m.select("record_id", F.col("kind").alias("kb"), F.col("id").alias("dst"))
    rows = a.join(plan, "ka").join(b, ["record_id", "kb"]).where((F.col("ka") != F.col("kb")) | (F.col("src") < F.col("dst")))
    w = Window.partitionBy("record_id").orderBy("step", "src", "dst")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("record_id", "src", "dst", "rel_type")


def merged(edges: DataFrame, into: DataFrame) -> DataFrame:
    """Edges (src, dst) with merged entities (src, into) replaced at either end; without loops and duplicates."""
    one = edges.join(into, "src", "left").select(F.coalesce("into", "src").alias("src"), "dst")
    two = one.join(into.select(F.col("src").alias("dst"), "into"), "dst", "left").select("src", F.coalesce("into", "dst").alias("dst"))
    return two.where("src <> dst").distinct()

"""Connected components of an edge table, on Spark.

Defined results: repeated links and loops say nothing; a node that is only in loops has no row; nulls in
a or b drop the link; no links give no rows; further columns are ignored. A node of very many links is
one group of a partial aggregate, never a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for each node of ``edges`` (a, b: comparable, not null).

    Alternates large-star and small-star steps: each node links its neighbours to the least of
    them, so paths halve and the stars that remain are the components. A step is a partial
    aggregate and a join on the node; each is written to the shared folder, which cuts the lineage.
    Nodes and links stay on the executors; only the count of links that changed reaches the driver.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    for _ in range(rounds):
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: e and its lower neighbours go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        new = staged(small, "cc")
        roots = new.select("b").distinct().join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        e = new
        if roots == 0:  # no node is both below another and above one: all are stars
            many = e.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
            if many == 0:
                return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
    raise RuntimeError("components did not settle")

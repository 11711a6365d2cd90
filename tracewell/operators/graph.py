"""Graph operators over vertex and edge tables. Cases are independent; no graph is gathered whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the session's shared folder."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tracewell-{spark.sparkContext.applicationId}/loop-{uuid.uuid4().hex[:12]}"
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared folder and read back, so that loops keep a short lineage. The write's shuffle files go when it ends."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch(spark), spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def endpoints(rels: DataFrame) -> DataFrame:
    """case_id, node, other, rel_type, created_at: each relationship from both of its ends.

    An OR over the two ends becomes an equi-join on ``node``.
    """
    one = rels.select("case_id", F.col("src").alias("node"), F.col("dst").alias("other"), "rel_type", "created_at")
    return one.union(rels.select("case_id", F.col("dst").alias("node"), F.col("src").alias("other"), "rel_type", "created_at"))


def undirected(rels: DataFrame) -> DataFrame:
    """case_id, a, b with a < b: distinct simple edges; self loops are dropped."""
    return rels.where("src <> dst").select("case_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def neighbours(rels: DataFrame) -> DataFrame:
    """case_id, node, other: distinct neighbours, both ways."""
    e = undirected(rels)
    return e.select("case_id", F.col("a").alias("node"), F.col("b").alias("other")).union(e.select("case_id", F.col("b").alias("node"), F.col("a").alias("other")))


def degrees(vertices: DataFrame, rels: DataFrame) -> DataFrame:
    """case_id, entity_id, degree, in_degree, out_degree; zero for vertices without edges. Parallel edges count in and out."""
    near = neighbours(rels).groupBy("case_id", F.col("node").alias("entity_id")).agg(F.count("*").alias("degree"))
    directed = rels.where("src <> dst")
    out = directed.groupBy("case_id", F.col("src").alias("entity_id")).agg(F.count("*").alias("out_degree"))
    into = directed.groupBy("case_id", F.col("dst").alias("entity_id")).agg(F.count("*").alias("in_degree"))
    key = ["case_id", "entity_id"]
    rows = vertices.select(*key).join(near, key, "left").join(into, key, "left").join(out, key, "left")
    return rows.select(*key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("degree", "in_degree", "out_degree")])


def ranked(df: DataFrame, value: str, limit: int | None = None, key: str = "entity_id", by: str = "case_id") -> DataFrame:
    """Adds rank: row number by value descending, then key; the first ``limit`` of each case only, if given."""
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), key)))
    return df if limit is None else df.where(F.col("rank") <= limit)


def common_neighbours(rels: DataFrame, actors: DataFrame) -> DataFrame:
    """case_id, a, b, shared: pairs of actors (case_id, entity_id), not adjacent, with a neighbour in common.

    Paths of two steps are counted by pair before any further shuffle.
    """
    near = neighbours(rels)
    of = near.join(actors.select("case_id", F.col("entity_id").alias("node")), ["case_id", "node"], "left_semi")
    left = of.select("case_id", F.col("other").alias("via"), F.col("node").alias("a"))
    right = of.select("case_id", F.col("other").alias("via"), F.col("node").alias("b"))
    pairs = left.join(right, ["case_id", "via"]).where("a < b").groupBy("case_id", "a", "b").agg(F.count("*").alias("shared"))
    return pairs.join(undirected(rels), ["case_id", "a", "b"], "left_anti")


def triangles(rels: DataFrame) -> DataFrame:
    """case_id, a, b, c with a < b < c, each pair adjacent.

    Each edge points to its end of higher degree, so paths start at the lower end and hubs are not squared.
    """
    e = undirected(rels)
    both = e.select("case_id", F.col("a").alias("n")).union(e.select("case_id", F.col("b").alias("n")))
    deg = both.groupBy("case_id", "n").agg(F.count("*").alias("d"))
    up = e.join(deg.select("case_id", F.col("n").alias("a"), F.col("d").alias("da")), ["case_id", "a"]).join(deg.select("case_id", F.col("n").alias("b"), F.col("d").alias("db")), ["case_id", "b"])
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    up = up.select("case_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi"))
    x, y = up.select("case_id", "lo", F.col("hi").alias("p")), up.select("case_id", "lo", F.col("hi").alias("q"))
    wedges = x.join(y, ["case_id", "lo"]).where("p < q")
    closed = wedges.join(e.select("case_id", F.col("a").alias("p"), F.col("b").alias("q")), ["case_id", "p", "q"], "left_semi")
    return closed.select("case_id", F.sort_array(F.array("lo", "p", "q")).alias("t")).select("case_id", F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def pagerank(vertices: DataFrame, rels: DataFrame, damping: float = 0.85, rounds: int = 30, leak: bool = False) -> DataFrame:
    """case_id, entity_id, pagerank, by case. The rank of vertices without out-edges is dealt to all.

    leak: shares are divided by the number of parallel edges but go to distinct targets once.
    """
    key = ["case_id", "entity_id"]
    directed = rels.where("src <> dst")
    links = directed.select("case_id", "src", "dst").distinct()
    out = (directed if leak else links).groupBy("case_id", "src").agg(F.count("*").alias("out"))
    links = cut(links.join(out, ["case_id", "src"]))
    size = vertices.groupBy("case_id").agg(F.count("*").alias("size"))
    nodes = cut(vertices.select(*key).join(size, "case_id").join(out.select("case_id", F.col("src").alias("entity_id"), "out"), key, "left"))
    rank = nodes.select(*key, "size", "out", (1 / F.col("size")).alias("r"))
    for _ in range(rounds):
        got = links.join(rank.select("case_id", F.col("entity_id").alias("src"), "r"), ["case_id", "src"]).groupBy("case_id", F.col("dst").alias("entity_id")).agg(F.sum(F.col("r") / F.col("out")).alias("got"))
        lost = rank.groupBy("case_id").agg(F.sum(F.when(F.col("out").isNull(), F.col("r")).otherwise(0.0)).alias("lost"))
        new = (1 - damping) / F.col("size") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("size"))
        # read twice in the next round, so written each time
        rank = cut(nodes.join(got, key, "left").join(lost, "case_id").select(*key, "size", "out", new.alias("r")))
    return rank.select(*key, F.col("r").alias("pagerank"))


def _order(c: str) -> Column:
    return F.struct(F.xxhash64("case_id", c).alias("h"), F.col(c).alias("x"))


def contracted(rels: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Spanning forest of ``rels`` (case_id, a, b), and the rounds' tables (case_id, c, d): component c became part of d.

    In a round every component hooks to the neighbour of least hash among those below its own, hooks are followed to their
    roots by doubling, and the edges between roots go on; so at least half of the components that have edges end.
    """
    e = cut(undirected(rels).select("case_id", F.col("a").alias("c"), F.col("b").alias("d"), "a", "b"))
    tree, rounds = None, []
    while e.limit(1).count():
        both = e.unionByName(e.select("case_id", F.col("d").alias("c"), F.col("c").alias("d"), "a", "b"))
        down = both.where(_order("d") < _order("c"))
        to = down.groupBy("case_id", "c").agg(F.min(F.struct(_order("d").alias("o"), "d", "a", "b")).alias("x")).select("case_id", "c", "x.d", "x.a", "x.b")
        while True:  # four steps at once
            to = cut(_followed(_followed(to)))
            if not to.join(to.select("case_id", F.col("c").alias("d")), ["case_id", "d"], "left_semi").limit(1).count():
                break
        used, to = to.select("case_id", "a", "b"), to.select("case_id", "c", "d")
        tree = used if tree is None else tree.union(used)
        rounds.append(to)
        for x in ("c", "d"):
            e = e.join(to.select("case_id", F.col("c").alias(x), F.col("d").alias("_to")), ["case_id", x], "left").withColumn(x, F.coalesce("_to", x)).drop("_to")
        x, y = F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")
        e = cut(e.where("c <> d").groupBy("case_id", x, y).agg(F.min(F.struct("a", "b")).alias("u")).select("case_id", "c", "d", "u.a", "u.b"))
    return (e.select("case_id", "a", "b") if tree is None else tree), rounds


def _followed(to: DataFrame) -> DataFrame:
    on = to.select("case_id", F.col("c").alias("d"), F.col("d").alias("_up"))
    return to.join(on, ["case_id", "d"], "left").select("case_id", "c", F.coalesce("_up", "d").alias("d"), "a", "b")


def labelled(vertices: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """case_id, entity_id, component (its least entity_id) of ``vertices``."""
    rows = vertices.select("case_id", "entity_id", F.col("entity_id").alias("c"))
    for to in rounds:
        rows = rows.join(to.select("case_id", "c", F.col("d").alias("_to")), ["case_id", "c"], "left").select("case_id", "entity_id", F.coalesce("_to", "c").alias("c"))
    rows = cut(rows)
    least = rows.groupBy("case_id", "c").agg(F.min("entity_id").alias("component"))
    return rows.join(least, ["case_id", "c"]).select("case_id", "entity_id", "component")


def components(vertices: DataFrame, rels: DataFrame) -> DataFrame:
    """case_id, entity_id, component (its least entity_id), in rounds that grow with the logarithm of the vertices."""
    return labelled(vertices, contracted(rels)[1])


def shortest_paths(rels: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """case_id, source, target, length, path: all shortest paths of 1 to ``hops`` steps from ``sources`` (case_id, entity_id).

    Level by level: only paths to vertices first reached at that level go on.
    """
    near = neighbours(rels)
    at = sources.select("case_id", F.col("entity_id").alias("source"), F.col("entity_id").alias("target"), F.array("entity_id").alias("path"))
    seen, out = at.select("case_id", "source", "target"), None
    for k in range(1, hops + 1):
        step = at.join(near.select("case_id", F.col("node").alias("target"), "other"), ["case_id", "target"]).select("case_id", "source", F.col("other").alias("target"), F.concat("path", F.array("other")).alias("path"))
        at = cut(step.join(seen, ["case_id", "source", "target"], "left_anti"))
        seen = seen.union(at.select("case_id", "source", "target").distinct())
        rows = at.select("case_id", "source", "target", F.lit(k).alias("length"), "path")
        out = rows if out is None else out.union(rows)
    return out


def simple_paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """case_id, source, path, end_state: maximal simple directed paths of up to ``hops`` steps; dead_end or depth_limit."""
    at, out = starts.select("case_id", F.col("entity_id").alias("source"), F.array("entity_id").alias("path")), None
    e = edges.select("case_id", "src", "dst").distinct()
    for k in range(hops):
        on = F.col("path")[k]
        step = at.withColumn("src", on).join(e, ["case_id", "src"], "left").withColumn("ok", F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst")))
        step = cut(step)
        alive = step.where("ok").select("case_id", "source", F.concat("path", F.array("dst")).alias("path"))
        dead = step.groupBy("case_id", "source", "path").agg(F.bool_or("ok").alias("any")).where("not any").select("case_id", "source", "path", F.lit("dead_end").alias("end_state"))
        out, at = dead if out is None else out.union(dead), alive
    return out.union(at.select("case_id", "source", "path", F.lit("depth_limit").alias("end_state")))


def bounded_paths(edges: DataFrame, starts: DataFrame, hops: int, most: int) -> DataFrame:
    """``simple_paths``, but of each source the first ``most`` in the order of paths, found without expanding the others.

    Each path begun is whole in the end (as a dead end or at the depth limit), and what comes after two beginnings of which neither
    continues the other is in their order; so after each hop the first ``most`` beginnings of a source are enough. A path at v goes
    on to the first ``most`` targets of v that it has not visited, so of each vertex the first most + hops are kept.
    """
    e = edges.select("case_id", "src", "dst").where("src <> dst").distinct()
    e = cut(e.withColumn("_k", F.row_number().over(Window.partitionBy("case_id", "src").orderBy("dst"))).where(F.col("_k") <= most + hops).drop("_k"))
    at = starts.select("case_id", F.col("entity_id").alias("source"), F.array("entity_id").alias("path"), F.lit(False).alias("dead"))
    w = Window.partitionBy("case_id", "source").orderBy("path")
    for k in range(hops):
        step = at.where("not dead").withColumn("src", F.col("path")[k]).join(e, ["case_id", "src"], "left")
        step = step.withColumn("ok", F.col("dst").isNotNull() & ~F.array_contains("path", F.coalesce("dst", F.lit(""))))
        on = step.where("ok").select("case_id", "source", F.concat("path", F.array("dst")).alias("path"), "dead")
        ended = step.groupBy("case_id", "source", "path").agg(F.bool_or("ok").alias("any")).where("not any").select("case_id", "source", "path", F.lit(True).alias("dead"))
        rows = on.unionByName(ended).unionByName(at.where("dead"))
        at = cut(rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k"))
    return at.select("case_id", "source", "path", F.when(F.col("dead"), "dead_end").otherwise("depth_limit").alias("end_state"))


def harmonic_closeness(vertices: DataFrame, rels: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """case_id, entity_id, closeness of ``sources``: sum of 1/distance within ``hops`` steps, over the other vertices."""
    size = vertices.groupBy("case_id").agg(F.count("*").alias("n"))
    near = neighbours(rels)
    at = sources.select("case_id", F.col("entity_id").alias("source"), F.col("entity_id").alias("target"))
    seen, out = at, None
    for k in range(1, hops + 1):
        step = at.join(near.select("case_id", F.col("node").alias("target"), "other"), ["case_id", "target"]).select("case_id", "source", F.col("other").alias("target")).distinct()
        at = cut(step.join(seen, ["case_id", "source", "target"], "left_anti"))
        seen = seen.union(at)
        rows = at.groupBy("case_id", "source").agg((F.count("*") / k).alias("s"))
        out = rows if out is None else out.union(rows)
    total = out.groupBy("case_id", F.col("source").alias("entity_id")).agg(F.sum("s").alias("s"))
    return sources.select("case_id", "entity_id").join(total, ["case_id", "entity_id"], "left").join(size, "case_id").select("case_id", "entity_id", F.when(F.col("n") > 1, F.coalesce("s", F.lit(0.0)) / (F.col("n") - 1)).otherwise(0.0).alias("closeness"))



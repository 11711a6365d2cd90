"""Graph queries over the cases: degrees, ranks, components, paths, patterns, strengths, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.domain import entities, records, relationships, with_sql
from tracewell.operators import blocks, graph, hypotheses, measures, network, structure
from tracewell.plans.registry import query

DEG = "deg AS (SELECT e.case_id, e.entity_id, count(DISTINCT n.other) AS degree FROM ents e LEFT JOIN ends n ON n.node = e.entity_id AND n.case_id = e.case_id GROUP BY 1, 2)"


def _graph(spark, d):
    return entities(spark, d), relationships(spark, d)


@query("G32_relationship_count", with_sql("SELECT * FROM (SELECT e.case_id, e.entity_id, count(n.node) AS n, CAST(row_number() OVER (PARTITION BY e.case_id ORDER BY count(n.node) DESC, e.entity_id) AS INT) AS rank FROM ents e LEFT JOIN ends n ON n.node = e.entity_id AND n.case_id = e.case_id GROUP BY 1, 2) WHERE rank <= 50"))
def g32(spark, d):
    e, r = _graph(spark, d)
    n = graph.endpoints(r).groupBy("case_id", F.col("node").alias("entity_id")).agg(F.count("*").alias("n"))
    rows = e.select("case_id", "entity_id").join(n, ["case_id", "entity_id"], "left").na.fill(0, ["n"])
    return graph.ranked(rows, "n", 50)


@query("G10_centrality_records")
def g10_records(spark, d):
    return measures.centrality_records(*_graph(spark, d))


@query("G32_ranked_by_metric", with_sql(f"""WITH {DEG},
n AS (SELECT e.case_id, e.entity_id, count(n.node) AS n FROM ents e LEFT JOIN ends n ON n.node = e.entity_id AND n.case_id = e.case_id GROUP BY 1, 2),
v AS (SELECT case_id, entity_id, 'relationship_count' AS metric, n::DOUBLE AS value FROM n UNION ALL SELECT case_id, entity_id, unnest(['distinct_neighbors', 'degree']), degree::DOUBLE FROM deg),
c AS (SELECT case_id, count(*) AS entities FROM ents GROUP BY 1)
SELECT v.case_id, entity_id, metric, value, (row_number() OVER (PARTITION BY v.case_id, metric ORDER BY value DESC, entity_id))::INT AS rank, entities FROM v JOIN c ON c.case_id = v.case_id QUALIFY rank <= 20"""))
def g32_metrics(spark, d):
    e, r = _graph(spark, d)
    out = None
    for metric in ("relationship_count", "distinct_neighbors", "degree"):
        rows = measures.ranked_by(e, r, metric, 20)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("G02_degree", with_sql(f"WITH {DEG} SELECT deg.*, (SELECT count(*) FROM rels WHERE dst = deg.entity_id AND rels.case_id = deg.case_id) AS in_degree, (SELECT count(*) FROM rels WHERE src = deg.entity_id AND rels.case_id = deg.case_id) AS out_degree FROM deg"))
def g02(spark, d):
    return graph.degrees(*_graph(spark, d))


def _levels(names: str, step: str, rounds: int) -> str:
    """CTEs that repeat ``step`` (with {k} and {i} for this round and the one before)."""
    return ", ".join(f"{names.format(k=k)} AS MATERIALIZED ({step.format(k=k, i=k - 1)})" for k in range(1, rounds + 1))


NEAR = "near AS MATERIALIZED (SELECT DISTINCT case_id, node, other FROM ends WHERE node <> other)"
LABELS = f"WITH {NEAR}, l0 AS MATERIALIZED (SELECT case_id, entity_id AS node, entity_id AS m FROM ents), " + _levels("l{k}", "SELECT l.case_id, l.node, least(l.m, coalesce(min(x.m), l.m)) AS m FROM l{i} l LEFT JOIN near n ON n.case_id = l.case_id AND n.node = l.node LEFT JOIN l{i} x ON x.case_id = n.case_id AND x.node = n.other GROUP BY l.case_id, l.node, l.m", 8)


@query("G03_components", with_sql(f"{LABELS} SELECT case_id, node AS entity_id, m AS component FROM l8"))
def g03(spark, d):
    return graph.components(*_graph(spark, d))


@query("G03_component_sizes", with_sql(f"{LABELS} SELECT case_id, m AS component, count(*) AS size FROM l8 GROUP BY 1, 2"))
def g03b(spark, d):
    return graph.components(*_graph(spark, d)).groupBy("case_id", "component").agg(F.count("*").alias("size"))


@query("G34_component_fallback", with_sql(f"{LABELS} SELECT case_id, node AS entity_id, m AS community FROM l8"))
def g34(spark, d):
    return structure.communities(*_graph(spark, d), exact=20)


@query("G04_G05_G11_structure")
def g04(spark, d):
    e, r = _graph(spark, d)
    key = ["case_id", "entity_id"]
    out = blocks.cut_structure(e, r).join(structure.centrality(e, r), key)
    return out.select(*key, "cut_vertex", F.round("bridge_score", 9).alias("bridge_score"), F.round("betweenness", 6).alias("betweenness"), "exact")


@query("G15_bridge_pattern")
def g15(spark, d):
    return blocks.cut_structure(*_graph(spark, d)).where("cut_vertex").select("case_id", "entity_id", F.round("bridge_score", 9).alias("bridge_score"))


CLOSE = f"WITH {NEAR}, d0 AS MATERIALIZED (SELECT case_id, entity_id AS s, entity_id AS node FROM ents), n0 AS (SELECT case_id, s, node FROM d0 WHERE false), d1 AS MATERIALIZED (SELECT case_id, node AS s, other AS node FROM near), " + ", ".join(f"d{k} AS MATERIALIZED (SELECT DISTINCT p.case_id, p.s, n.other AS node FROM d{k - 1} p JOIN near n ON n.case_id = p.case_id AND n.node = p.node ANTI JOIN d{k - 1} a ON a.s = p.s AND a.case_id = p.case_id AND a.node = n.other ANTI JOIN d{k - 2} b ON b.s = p.s AND b.case_id = p.case_id AND b.node = n.other)" for k in range(2, 8))


@query("G06_closeness", with_sql(CLOSE + ", c AS (SELECT case_id, s, sum(x) AS x FROM (" + " UNION ALL ".join(f"SELECT case_id, s, count(*) / {k}.0::DOUBLE AS x FROM d{k} GROUP BY 1, 2" for k in range(1, 8)) + ") GROUP BY 1, 2), n AS (SELECT case_id, count(*) AS n FROM ents GROUP BY 1) SELECT e.case_id, entity_id, round(coalesce(x, 0) / (n - 1), 6) AS closeness FROM ents e JOIN n ON n.case_id = e.case_id LEFT JOIN c ON c.case_id = e.case_id AND c.s = entity_id"))
def g06(spark, d):
    return structure.closeness(*_graph(spark, d)).select("case_id", "entity_id", F.round("closeness", 6).alias("closeness"))


@query("G33_sampled_centrality")
def g33(spark, d):
    """Cases of over 50 vertices by about 16 searches each."""
    out = structure.centrality(*_graph(spark, d), exact=50, pivots=16)
    return out.select("case_id", "entity_id", F.round("betweenness", 6).alias("betweenness"), F.round("closeness", 6).alias("closeness"), "exact")


PAGERANK = with_sql("""
WITH links AS MATERIALIZED (SELECT l.case_id, src, dst, out FROM (SELECT DISTINCT case_id, src, dst FROM rels) l JOIN (SELECT case_id, src, count(DISTINCT dst) AS out FROM rels GROUP BY 1, 2) o USING (case_id, src)),
nodes AS MATERIALIZED (SELECT e.case_id, entity_id, count(*) OVER (PARTITION BY e.case_id) AS size, o.out FROM ents e LEFT JOIN (SELECT case_id, src, count(DISTINCT dst) AS out FROM rels GROUP BY 1, 2) o ON o.src = entity_id AND o.case_id = e.case_id),
pr AS (
  SELECT 0 AS it, case_id, entity_id, 1.0::DOUBLE / size AS r FROM nodes
  UNION ALL
  SELECT pr.it + 1, n.case_id, n.entity_id, 0.15::DOUBLE / n.size + 0.85::DOUBLE * (coalesce(g.got, 0) + l.lost / n.size)
  FROM nodes n JOIN (SELECT DISTINCT it FROM pr) AS pr ON pr.it < 30
  LEFT JOIN (SELECT k.case_id, k.dst, sum(p.r / k.out) AS got FROM pr p JOIN links k ON k.src = p.entity_id AND k.case_id = p.case_id GROUP BY 1, 2) g ON g.dst = n.entity_id AND g.case_id = n.case_id
  JOIN (SELECT p.case_id, sum(CASE WHEN m.out IS NULL THEN p.r ELSE 0 END) AS lost FROM pr p JOIN nodes m USING (case_id, entity_id) GROUP BY 1) l ON l.case_id = n.case_id)
SELECT case_id, entity_id, round(r, 9) AS pagerank FROM pr WHERE it = 30
""")


@query("G07_pagerank", PAGERANK)
def g07(spark, d):
    return graph.pagerank(*_graph(spark, d)).select("case_id", "entity_id", F.round("pagerank", 9).alias("pagerank"))


@query("G12_G13_communities")
def g12(spark, d):
    e, r = _graph(spark, d)
    return structure.community_summary(structure.communities(e, r), e, r)


@query("G14_shared_identifier", with_sql(f"WITH {DEG}, m AS (SELECT case_id, max(degree) AS most FROM deg GROUP BY 1) SELECT case_id, entity_id, degree, severity, score, confidence FROM (SELECT deg.case_id, deg.entity_id, degree, CASE WHEN degree >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(degree / most, 6) AS score, round(least(1.0, 0.5 + 0.1 * (degree - 3) / 3), 6)::DOUBLE AS confidence, row_number() OVER (PARTITION BY deg.case_id ORDER BY round(degree / most, 6) DESC, deg.entity_id) AS k FROM deg JOIN m USING (case_id) WHERE entity_id LIKE 'S%' AND degree >= 3) WHERE k <= 5"))
def g14(spark, d):
    e, r = _graph(spark, d)
    return network.shared_identifiers(graph.degrees(e, r), e.where("entity_type = 'organization'"))


@query("G16_concentration", with_sql(f"WITH {DEG}, m AS (SELECT case_id, max(degree) AS most, list_sort(list(degree))[floor(count(*) * 0.95)::INT] AS tail FROM deg GROUP BY 1) SELECT case_id, entity_id, degree, threshold, severity, score, confidence FROM (SELECT case_id, entity_id, degree, threshold, CASE WHEN degree >= threshold * 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(degree / most, 6) AS score, round(least(1.0, 0.5 + 0.2 * (degree - threshold) / greatest(1, threshold)), 6)::DOUBLE AS confidence, row_number() OVER (PARTITION BY case_id ORDER BY round(degree / most, 6) DESC, entity_id) AS k FROM (SELECT deg.*, most, greatest(5, tail) AS threshold FROM deg JOIN m USING (case_id)) WHERE degree >= threshold) WHERE k <= 5"))
def g16(spark, d):
    return network.concentration(graph.degrees(*_graph(spark, d)))


@query("G17_circular_structure", with_sql("SELECT case_id, a, b, c FROM (SELECT DISTINCT x.case_id, list_sort([x.src, x.dst, y.dst])[1] AS a, list_sort([x.src, x.dst, y.dst])[2] AS b, list_sort([x.src, x.dst, y.dst])[3] AS c FROM rels x JOIN rels y ON x.src = y.src AND y.rel_type = 'located_at' JOIN rels z ON z.src = x.dst AND z.dst = y.dst AND z.rel_type = 'located_at' WHERE x.rel_type = 'transferred_to') QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY a, b, c) <= 5"))
def g17(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("case_id").orderBy("a", "b", "c")
    return graph.triangles(relationships(spark, d)).withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")


@query("G18_location_identifier", with_sql("SELECT case_id, entity_id, locations, identifiers, score FROM (SELECT case_id, node AS entity_id, count(DISTINCT other) FILTER (other LIKE 'N%') AS locations, count(DISTINCT other) FILTER (other LIKE 'S%') AS identifiers, round(least(1.0, count(DISTINCT other) / 4), 6)::DOUBLE AS score, row_number() OVER (PARTITION BY case_id ORDER BY least(1.0, count(DISTINCT other) / 4) DESC, node) AS k FROM ends WHERE node LIKE 'C%' GROUP BY 1, 2 HAVING count(DISTINCT other) FILTER (other LIKE 'S%') > 0) WHERE k <= 5"))
def g18(spark, d):
    e, r = _graph(spark, d)
    return network.location_identifier(r, e, "person", "organization")


@query("G19_rapid_expansion", with_sql("SELECT case_id, node AS entity_id, date_diff('second', min(created_at), max(created_at)) AS seconds FROM ends WHERE created_at IS NOT NULL GROUP BY 1, 2 HAVING date_diff('second', min(created_at), max(created_at)) >= 3600"))
def g19(spark, d):
    return network.rapid_expansion(relationships(spark, d))


def _actors(e):
    return e.where("entity_type in ('person', 'organization')")


def component_communities(e, r):
    """Connected components as communities, as in cases above the bound."""
    return graph.components(e, r).withColumnRenamed("component", "community")


@query("G20_missing_links", with_sql(f"""{LABELS},
p AS (SELECT x.case_id, x.node AS a, y.node AS b, count(*) AS shared FROM near x JOIN near y ON x.other = y.other AND x.case_id = y.case_id AND x.node < y.node WHERE x.node NOT LIKE 'N%' AND y.node NOT LIKE 'N%' GROUP BY 1, 2, 3),
q AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM near z WHERE z.case_id = p.case_id AND z.node = a AND z.other = b)),
m AS (SELECT case_id, max(shared) AS most FROM q GROUP BY 1),
r AS (SELECT q.case_id, a, b, shared, most, x.m = y.m AS same_community FROM q JOIN m ON m.case_id = q.case_id JOIN l8 x ON x.case_id = q.case_id AND x.node = a JOIN l8 y ON y.case_id = q.case_id AND y.node = b)
SELECT case_id, a, b, shared, same_community, round(0.55 * shared / most + CASE WHEN same_community THEN 0.30 ELSE 0 END + 0.15, 6)::DOUBLE AS score, round(least(1.0, 0.35 + 0.15 * shared), 6)::DOUBLE AS confidence, CASE WHEN shared >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM r QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, a, b) <= 25"""))
def g20(spark, d):
    e, r = _graph(spark, d)
    r = graph.cut(graph.undirected(r)).withColumnsRenamed({"a": "src", "b": "dst"})
    return hypotheses.missing_links(r, _actors(e), component_communities(e, r))


def community_links(e, r):
    return hypotheses.missing_links(r, _actors(e), structure.communities(e, r))


@query("G20_hypotheses")
def g20_hypotheses(spark, d):
    """With communities by modularity, and the type that the relationships around a pair suggest."""
    e, r = map(graph.cut, _graph(spark, d))
    return hypotheses.supported(community_links(e, r), r)


def _evidence(spark, d):
    rec = records(spark, d).where("case_id = payee_case")
    per = rec.groupBy("case_id", F.col("party").alias("src"), F.col("account").alias("dst")).agg(F.count("*").alias("n"), F.count_distinct("evidence_type").alias("kinds"), F.count_distinct("record_id").alias("records"), F.count_distinct("file_id").alias("files"))
    all_of = rec.groupBy("case_id").agg(F.count_distinct("record_id").alias("records_all"), F.count_distinct("file_id").alias("files_all"))
    return per, per.groupBy("case_id").agg(F.max("n").alias("most")).join(all_of, "case_id")


@query("G21_strength", with_sql("WITH r AS (SELECT * FROM recs WHERE case_id = payee_case), p AS (SELECT case_id, party AS src, account AS dst, count(*) AS n, count(DISTINCT evidence_type) AS kinds, count(DISTINCT record_id) AS records, count(DISTINCT file_id) AS files FROM r GROUP BY 1, 2, 3), t AS (SELECT case_id, count(DISTINCT record_id) AS ra, count(DISTINCT file_id) AS fa FROM r GROUP BY 1), m AS (SELECT case_id, max(n) AS most FROM p GROUP BY 1) SELECT p.case_id, src, dst, round(0.30::DOUBLE * ln(1 + n) / ln(1 + most) + 0.15::DOUBLE * kinds / 2 + 0.20::DOUBLE * records / ra + 0.20::DOUBLE * files / fa + 0.15::DOUBLE * (x.confidence + y.confidence) / 2, 6) AS strength FROM p JOIN t USING (case_id) JOIN m USING (case_id) JOIN ents x ON x.entity_id = src JOIN ents y ON y.entity_id = dst"))
def g21(spark, d):
    per, totals = _evidence(spark, d)
    return network.strength(per, totals, entities(spark, d)).select("case_id", "src", "dst", "strength")


@query("G24_two_hop_pairs", with_sql("WITH near AS (SELECT DISTINCT case_id, node, other FROM ends) SELECT x.case_id, count(DISTINCT (x.node, y.node)) AS pairs FROM near x JOIN near y ON x.other = y.other AND x.case_id = y.case_id AND x.node < y.node WHERE x.node LIKE 'S%' AND y.node LIKE 'S%' GROUP BY 1"))
def g24(spark, d):
    e, r = _graph(spark, d)
    return graph.common_neighbours(r, e.where("entity_type = 'organization'")).groupBy("case_id").agg(F.count("*").alias("pairs"))


@query("G25_strongest", with_sql("SELECT case_id, arg_max(src || '>' || dst, (n_records, src, dst)) AS strongest, count(*) FILTER (n_records = 1) AS thin FROM rels WHERE rel_type = 'transferred_to' GROUP BY 1"))
def g25(spark, d):
    r = relationships(spark, d).where("rel_type = 'transferred_to'")
    best = F.max(F.struct("n_records", "src", "dst"))
    return r.groupBy("case_id").agg(F.concat(best["src"], F.lit(">"), best["dst"]).alias("strongest"), F.count_if(F.col("n_records") == 1).alias("thin"))


@query("G26_shortest_paths", with_sql("WITH e AS (SELECT DISTINCT case_id, node, other FROM ends), a AS MATERIALIZED (SELECT case_id, node AS source, other AS target, 1 AS length, [node, other] AS path FROM e WHERE node LIKE 'N%'), b AS (SELECT a.case_id, a.source, e.other AS target, 2 AS length, list_append(a.path, e.other) AS path FROM a JOIN e ON e.node = a.target AND e.case_id = a.case_id WHERE e.other <> a.source AND NOT EXISTS (SELECT 1 FROM a x WHERE x.source = a.source AND x.target = e.other)) SELECT * FROM a UNION ALL SELECT * FROM b"))
def g26(spark, d):
    e, r = _graph(spark, d)
    return graph.shortest_paths(r, e.where("entity_type = 'location'"), 2)


@query("G27_pair_paths", with_sql("WITH e AS (SELECT DISTINCT case_id, node, other FROM ends) SELECT x.case_id, x.node AS source, y.other AS target, 2 AS length, [x.node, x.other, y.other] AS path FROM e x JOIN e y ON y.node = x.other AND y.case_id = x.case_id WHERE x.node LIKE 'N%' AND y.other LIKE 'S%' AND NOT EXISTS (SELECT 1 FROM e z WHERE z.node = x.node AND z.other = y.other)"))
def g27(spark, d):
    e, r = _graph(spark, d)
    return graph.shortest_paths(r, e.where("entity_type = 'location'"), 2).where("length >= 2 and target LIKE 'S%'")


@query("G28_ego", with_sql("SELECT node AS center, other, rel_type FROM ends WHERE node LIKE 'N%'"))
def g28(spark, d):
    return graph.endpoints(relationships(spark, d)).where("node LIKE 'N%'").select(F.col("node").alias("center"), "other", "rel_type")


@query("G29_association_network", with_sql("SELECT case_id, least(party, account) AS a, greatest(party, account) AS b, count(*) AS n FROM recs GROUP BY 1, 2, 3"))
def g29(spark, d):
    return records(spark, d).groupBy("case_id", F.least("party", "account").alias("a"), F.greatest("party", "account").alias("b")).agg(F.count("*").alias("n"))


@query("G30_trace", with_sql("SELECT a.src AS source, a.src || '>' || a.dst || '>' || b.dst AS path, 'dead_end' AS end_state FROM rels a JOIN rels b ON b.src = a.dst AND b.case_id = a.case_id WHERE a.rel_type = 'transferred_to'"))
def g30(spark, d):
    r = relationships(spark, d)
    starts = r.where("rel_type = 'transferred_to'").select("case_id", F.col("src").alias("entity_id")).distinct()
    edges = r.where("rel_type = 'transferred_to' or src LIKE 'S%'")
    return graph.simple_paths(edges, starts, 4).select("source", F.array_join("path", ">").alias("path"), "end_state")


def _measures(e, r, group):
    """The raw measures of profiles, from entities, relationships and communities that are written already."""
    key = ["case_id", "entity_id"]
    deg, rank = graph.degrees(e, r), graph.pagerank(e, r)
    bridge = blocks.cut_structure(e, r).select(*key, F.col("bridge_score").alias("bridging"))
    depth = r.select("case_id", "src", "dst", "n_records")
    depth = depth.select("case_id", F.col("src").alias("entity_id"), "n_records").union(depth.select("case_id", "dst", "n_records")).groupBy(*key).agg(F.sum("n_records").cast("double").alias("evidence_depth"))
    span = graph.neighbours(r).join(group.select("case_id", F.col("entity_id").alias("other"), "community"), ["case_id", "other"]).groupBy("case_id", F.col("node").alias("entity_id")).agg(F.count_distinct("community").cast("double").alias("community_span"))
    rows = e.select(*key).join(deg, key).join(rank, key).join(bridge, key).join(depth, key, "left").join(span, key, "left")
    whole = lambda c: F.col(c).cast("double")
    return rows.select(*key, whole("degree").alias("prominence"), F.col("pagerank").alias("influence"), "bridging", whole("out_degree").alias("reach"), whole("in_degree").alias("anchorage"), (whole("in_degree") + whole("out_degree")).alias("activity"), F.coalesce("evidence_depth", F.lit(0.0)).alias("evidence_depth"), F.coalesce("community_span", F.lit(0.0)).alias("community_span"))


@query("G22_profiles")
def g22(spark, d):
    # many steps read both, so they are made once
    e, r = map(graph.cut, _graph(spark, d))
    return network.profiles(_measures(e, r, structure.communities(e, r))).select("case_id", "entity_id", "overall_score", "tier")


@query("G23_priorities")
def g23(spark, d):
    """Findings of an entity are its patterns by severity, hypotheses the missing links that name it."""
    e, r = map(graph.cut, _graph(spark, d))
    key, group = ["case_id", "entity_id"], graph.cut(structure.communities(e, r))
    deg = graph.degrees(e, r)
    found = network.concentration(deg).select(*key, "severity").unionByName(network.shared_identifiers(deg, e.where("entity_type = 'organization'")).select(*key, "severity"))
    found = found.groupBy(*key).agg(*[F.count_if(F.col("severity") == s).cast("int").alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")])
    links = hypotheses.missing_links(r, _actors(e), group)
    guessed = links.select("case_id", F.col("a").alias("entity_id")).union(links.select("case_id", "b")).groupBy(*key).agg(F.count("*").cast("int").alias("hypotheses"))
    p = network.profiles(_measures(e, r, group)).select(*key, "prominence", "influence", "bridging", "reach")
    rows = p.join(found, key, "left").join(guessed, key, "left").na.fill(0, ["high", "medium", "low", "hypotheses"])
    return network.priorities(rows).select(*key, "priority_score", "priority_tier")


@query("A24_community_stats", with_sql("""WITH m AS (SELECT case_id, src AS entity_id, dst AS community FROM rels WHERE rel_type = 'located_at'),
e AS (SELECT DISTINCT case_id, least(src, dst) AS a, greatest(src, dst) AS b FROM rels WHERE rel_type = 'transferred_to'),
s AS (SELECT x.case_id, x.community AS p, y.community AS q FROM e JOIN m x ON x.entity_id = e.a JOIN m y ON y.entity_id = e.b),
c AS (SELECT case_id, community, count(*) FILTER (same) AS internal, count(*) FILTER (NOT same) AS external FROM (SELECT case_id, p AS community, p = q AS same FROM s UNION ALL SELECT case_id, q, false FROM s WHERE p <> q) GROUP BY 1, 2),
k AS (SELECT m.case_id, community, entity_type, count(*) AS n FROM m JOIN ents ON ents.entity_id = m.entity_id GROUP BY 1, 2, 3),
t AS (SELECT case_id, community, sum(n)::BIGINT AS size, list(entity_type ORDER BY n DESC, entity_type)[1:3] AS top_types FROM k GROUP BY 1, 2)
SELECT t.case_id, t.community, size, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, CASE WHEN size > 1 THEN round(2 * coalesce(internal, 0) / (size * (size - 1)), 6) ELSE 0 END AS density, top_types FROM t LEFT JOIN c ON c.case_id = t.case_id AND c.community = t.community"""))
def a24(spark, d):
    e, r = _graph(spark, d)
    home = r.where("rel_type = 'located_at'").select("case_id", F.col("src").alias("entity_id"), F.col("dst").alias("community"))
    return structure.community_summary(home, e, r.where("rel_type = 'transferred_to'"))


@query("A28_tier_counts")
def a28(spark, d):
    return g22(spark, d).groupBy("case_id", "tier").agg(F.count("*").alias("n"), F.round(F.avg("overall_score"), 4).alias("mean_score"))

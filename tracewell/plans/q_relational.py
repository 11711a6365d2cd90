"""Relational queries: predicates, joins, aggregates, windows, top-k and set operations over cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.domain import entities, records, relationships, table, with_sql
from tracewell.operators import graph, relational
from tracewell.plans.registry import query

ENDS = "(SELECT case_id, src AS node, dst AS other, rel_type FROM rels UNION ALL SELECT case_id, dst, src, rel_type FROM rels)"


@query("P01_first_hit", "SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE o_orderpriority END), ''), o_orderstatus) AS value FROM orders")
def p01(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.trim(F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.col("o_orderpriority"))).alias("a"), "o_orderstatus")
    return rows.select("o_orderkey", relational.first_present("a", "o_orderstatus").alias("value"))


@query("P03_flatten", "SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def p03(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(relational.flattened(F.col("props"))).alias("key", "value"))


@query("P08_unit_content", "SELECT event_id, event_type || chr(10) || props AS content FROM events")
def p08(spark, d):
    return table(spark, d, "events").select("event_id", F.concat_ws("\n", "event_type", "props").alias("content"))


@query("P09_case_scope", with_sql("SELECT entity_id, entity_type, status FROM ents WHERE case_id = 2"))
def p09(spark, d):
    return relational.filtered(entities(spark, d), case_id=2).select("entity_id", "entity_type", "status")


@query("P10_optional_filters", with_sql("SELECT entity_id, display_value FROM ents WHERE case_id = 1 AND entity_type IN ('person', 'organization') AND status = 'active'"))
def p10(spark, d):
    return relational.filtered(entities(spark, d), case_id=1, entity_type=["person", "organization"], status="active", confidence=None).select("entity_id", "display_value")


@query("P11_substring", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'small r') OR contains(lower(p_name), 're%d')")
def p11(spark, d):
    return table(spark, d, "part").where(relational.escaped_like("p_name", "SMALL R") | relational.escaped_like("p_name", "re%d")).select("p_partkey", "p_name")


@query("P12_time_range", "SELECT event_id, ts FROM events WHERE ts BETWEEN (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def p12(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    at = e.agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("lo"), (F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("hi"))
    return e.crossJoin(F.broadcast(at)).where("ts BETWEEN lo AND hi").select("event_id", "ts")


@query("P13_in_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def p13(spark, d):
    return relational.filtered(table(spark, d, "orders"), o_orderstatus=["F", "P"]).select("o_orderkey")


@query("P14_array_overlap", "SELECT o_orderkey, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS ids FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING list_has_any(list(l_suppkey), [1, 2, 3])")
def p14(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("ids"))
    return lines.where(F.arrays_overlap("ids", F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]))).join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("P15_json_path", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 7")
def p15(spark, d):
    return table(spark, d, "events").where(F.get_json_object("props", "$.k").cast("int") == 7).select("event_id")


MEMBERS_SQL = "cases AS (SELECT o_orderkey AS case_id, o_custkey % 50 AS owner_id FROM orders), members AS (SELECT l_orderkey AS case_id, l_suppkey % 50 AS user_id FROM lineitem)"


def _members(spark, d):
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 50).alias("owner_id"))
    return cases, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 50).alias("user_id"))


@query("P16_visibility", f"WITH {MEMBERS_SQL} SELECT case_id, owner_id FROM cases WHERE owner_id = 7 OR case_id IN (SELECT case_id FROM members WHERE user_id = 7)")
def p16(spark, d):
    cases, members = _members(spark, d)
    return relational.visible(cases, members, F.lit(7)).select("case_id", "owner_id")


@query("P17_all_sides_visible", "WITH c AS (SELECT l_partkey AS id, list(DISTINCT l_orderkey) AS s FROM lineitem GROUP BY 1) SELECT id FROM c WHERE id NOT IN (SELECT id FROM (SELECT id, unnest(s) AS o FROM c) JOIN orders ON o = o_orderkey WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%')")
def p17(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("l_orderkey").alias("sides"))
    ok = table(spark, d, "orders").where("NOT (o_orderstatus = 'P' AND o_orderpriority LIKE '1%')").select(F.col("o_orderkey").alias("case_id"))
    return relational.all_sides_visible(c, "sides", ok, "id").select("id")


@query("P18_case_reference", "WITH r AS (SELECT r_name AS ref FROM region UNION ALL SELECT 'nowhere'), m AS (SELECT ref, count(r_regionkey) AS n, min(r_regionkey) AS id FROM r LEFT JOIN region ON lower(ref) = lower(r_name) GROUP BY 1) SELECT ref, CASE n WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN id END AS case_id FROM m")
def p18(spark, d):
    r = table(spark, d, "region")
    refs = r.select(F.col("r_name").alias("ref")).union(spark.createDataFrame([("nowhere",)], "ref string"))
    m = refs.join(r, F.lower("ref") == F.lower("r_name"), "left").groupBy("ref").agg(F.count("r_regionkey").alias("n"), F.min("r_regionkey").alias("id"))
    return m.select("ref", F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("state"), F.when(F.col("n") == 1, F.col("id")).alias("case_id"))


@query("P20_clip", r"SELECT doc_id, CASE WHEN length(t) > 300 THEN left(t, 299) || '…' ELSE t END AS clip FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS t FROM documents)")
def p20(spark, d):
    t = F.trim(F.regexp_replace("text", "[ \t\r\n]+", " "))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.when(F.char_length("t") > 300, F.concat(F.substring("t", 1, 299), F.lit("…"))).otherwise(F.col("t")).alias("clip"))


@query("J01_records_of_case", with_sql("SELECT record_id, file_id, record_no FROM recs WHERE case_id = 0"))
def j01(spark, d):
    return records(spark, d).where("case_id = 0").select("record_id", "file_id", "record_no")


@query("J02_evidence_left_records", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def j02(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("J03_relationships_at_either_end", with_sql(f"SELECT entity_id, count(e.node) AS n FROM ents LEFT JOIN {ENDS} e ON e.node = entity_id AND e.case_id = ents.case_id WHERE entity_type = 'organization' GROUP BY 1"))
def j03(spark, d):
    e = entities(spark, d).where("entity_type = 'organization'")
    ends = graph.endpoints(relationships(spark, d)).withColumnRenamed("node", "entity_id")
    return e.join(ends, ["case_id", "entity_id"], "left").groupBy("entity_id").agg(F.count("other").alias("n"))


@query("J04_other_endpoint", with_sql(f"SELECT entity_id, count(DISTINCT e.other) AS others FROM ents JOIN {ENDS} e ON e.node = entity_id AND e.case_id = ents.case_id GROUP BY 1"))
def j04(spark, d):
    ends = graph.endpoints(relationships(spark, d)).withColumnRenamed("node", "entity_id")
    return entities(spark, d).join(ends, ["case_id", "entity_id"]).groupBy("entity_id").agg(F.count_distinct("other").alias("others"))


@query("J05_alias_entity", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j05(spark, d):
    return table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("J07_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j07(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("J08_provenance_chain", "SELECT DISTINCT n_nationkey FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%'")
def j08(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1"))
    lines = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    s = table(spark, d, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")
    return table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select("n_nationkey")


@query("J09_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def j09(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority LIKE '1%'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("J10_replay", "SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def j10(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


@query("J11_endpoint_lookup", with_sql("SELECT r.src, r.dst, a.display_value AS from_name, b.display_value AS to_name FROM rels r JOIN ents a ON a.entity_id = r.src JOIN ents b ON b.entity_id = r.dst WHERE rel_type = 'located_at'"))
def j11(spark, d):
    e = entities(spark, d)
    r = relationships(spark, d).where("rel_type = 'located_at'").select("src", "dst")
    return r.join(e.select(F.col("entity_id").alias("src"), F.col("display_value").alias("from_name")), "src").join(e.select(F.col("entity_id").alias("dst"), F.col("display_value").alias("to_name")), "dst").select("src", "dst", "from_name", "to_name")


@query("J12_enrichment", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def j12(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("J14_exact_alias_pairs", "SELECT a.doc_id AS a, min(b.doc_id) AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id > b.doc_id GROUP BY 1")
def j14(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.withColumn("b", F.min("doc_id").over(Window.partitionBy("h"))).where("doc_id > b").select(F.col("doc_id").alias("a"), "b")


@query("J17_cross_case_groups", with_sql("SELECT part, count(*) AS n, count(DISTINCT case_id) AS cases FROM recs GROUP BY 1 HAVING count(DISTINCT case_id) >= 2"))
def j17(spark, d):
    return records(spark, d).groupBy("part", "case_id").agg(F.count("*").alias("m")).groupBy("part").agg(F.sum("m").alias("n"), F.count("*").alias("cases")).where("cases >= 2")


@query("J19_common_neighbours", with_sql("WITH near AS (SELECT DISTINCT case_id, node, other FROM ends) SELECT x.case_id, x.node AS a, y.node AS b, count(*) AS shared FROM near x JOIN near y ON x.other = y.other AND x.case_id = y.case_id AND x.node < y.node WHERE x.node LIKE 'S%' AND y.node LIKE 'S%' GROUP BY 1, 2, 3"))
def j19(spark, d):
    return graph.common_neighbours(relationships(spark, d), entities(spark, d).where("entity_type = 'organization'"))


@query("J20_G09_triangles", with_sql("SELECT x.case_id, count(*) AS triangles FROM rels x JOIN rels y ON x.src = y.src AND x.case_id = y.case_id AND y.rel_type = 'located_at' JOIN rels z ON z.src = x.dst AND z.dst = y.dst AND z.rel_type = 'located_at' WHERE x.rel_type = 'transferred_to' GROUP BY 1"))
def j20(spark, d):
    return graph.triangles(relationships(spark, d)).groupBy("case_id").agg(F.count("*").alias("triangles"))


@query("J21_same_day", "SELECT l_orderkey, l_linenumber, l_partkey, min(o_orderkey) AS o_orderkey FROM (SELECT l.*, o_custkey AS c FROM lineitem l JOIN orders ON l_orderkey = o_orderkey) l JOIN orders o ON c = o.o_custkey AND l_shipdate::DATE = o_orderdate::DATE GROUP BY 1, 2, 3")
def j21(spark, d):
    """Order lines and the first order that their customer made on the day they were shipped."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    drafts = table(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", F.to_date("l_shipdate").alias("day"))
    return drafts.join(o, ["o_custkey", "day"]).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("J22_W04_duplicates", "SELECT doc_id, first_value(doc_id) OVER w AS keeper FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id) QUALIFY row_number() OVER w > 1")
def j22(spark, d):
    w = Window.partitionBy("h").orderBy("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.select("doc_id", F.first("doc_id").over(w).alias("keeper"), F.row_number().over(w).alias("k")).where("k > 1").drop("k")


@query("J23_manifest", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 1 THEN 'match' ELSE 'mismatch' END AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j23(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "match").otherwise("mismatch").alias("verdict"))


@query("J24_receipt_after_transfer", "SELECT event_id FROM events t WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = t.user_id AND r.event_type = 'view' AND r.ts >= t.ts)")
def j24(spark, d):
    e = table(spark, d, "events").withColumn("last", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(Window.partitionBy("user_id")))
    return e.where((F.col("event_type") == "purchase") & (F.col("last").isNull() | (F.col("last") < F.col("ts")))).select("event_id")


@query("J25_A20_unmatched_loss", "SELECT c_custkey, CAST(abs(CAST(c_acctbal AS DECIMAL(18,2))) AS VARCHAR) AS loss FROM customer WHERE c_acctbal < 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE CAST(l_extendedprice AS DECIMAL(18,2)) = abs(CAST(c_acctbal AS DECIMAL(18,2))))")
def j25(spark, d):
    loss = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", F.abs(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(18,2)").cast("string").alias("loss"))
    return loss.join(table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("loss")), "loss", "left_anti").select("c_custkey", "loss")


@query("J27_edge_validity", with_sql("SELECT src, dst FROM rels WHERE src IN (SELECT entity_id FROM ents WHERE status = 'active') AND dst IN (SELECT entity_id FROM ents WHERE status = 'active')"))
def j27(spark, d):
    ok = entities(spark, d).where("status = 'active'")
    r = relationships(spark, d).select("src", "dst")
    return r.join(ok, F.col("src") == F.col("entity_id"), "left_semi").join(ok, F.col("dst") == F.col("entity_id"), "left_semi")


@query("A01_count_by_type", with_sql("SELECT case_id, entity_type, count(*) AS n FROM ents GROUP BY 1, 2"))
def a01(spark, d):
    return entities(spark, d).groupBy("case_id", "entity_type").agg(F.count("*").alias("n"))


@query("A02_histogram", with_sql("SELECT rel_type, count(*) AS n, max(confidence) AS best FROM rels GROUP BY 1"))
def a02(spark, d):
    return relationships(spark, d).groupBy("rel_type").agg(F.count("*").alias("n"), F.max("confidence").alias("best")).orderBy(F.desc("n"))


@query("A03_relationship_count", with_sql(f"SELECT ents.case_id, entity_id, count(e.node) AS n FROM ents LEFT JOIN {ENDS} e ON e.node = entity_id AND e.case_id = ents.case_id GROUP BY 1, 2"))
def a03(spark, d):
    n = graph.endpoints(relationships(spark, d)).groupBy("case_id", F.col("node").alias("entity_id")).agg(F.count("*").alias("n"))
    return entities(spark, d).select("case_id", "entity_id").join(n, ["case_id", "entity_id"], "left").na.fill(0, ["n"])


@query("A04_distinct_neighbours", with_sql(f"SELECT case_id, node AS entity_id, count(DISTINCT other) AS n FROM {ENDS} GROUP BY 1, 2"))
def a04(spark, d):
    return graph.neighbours(relationships(spark, d)).groupBy("case_id", F.col("node").alias("entity_id")).agg(F.count("*").alias("n"))


@query("A05_evidence_stats", with_sql("SELECT party AS src, account AS dst, count(*) AS n, list(DISTINCT evidence_type ORDER BY evidence_type) AS kinds, count(DISTINCT file_id) AS files FROM recs WHERE case_id = payee_case GROUP BY 1, 2"))
def a05(spark, d):
    return records(spark, d).where("case_id = payee_case").groupBy(F.col("party").alias("src"), F.col("account").alias("dst")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("evidence_type")).alias("kinds"), F.count_distinct("file_id").alias("files"))


@query("A06_evidence_totals", with_sql("SELECT case_id, max(n) AS most, sum(n) AS records FROM (SELECT case_id, file_id, count(*) AS n FROM recs GROUP BY 1, 2) GROUP BY 1"))
def a06(spark, d):
    return records(spark, d).groupBy("case_id", "file_id").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.max("n").alias("most"), F.sum("n").alias("records"))


@query("A07_finding_stats", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def a07(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("a07_orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM a07_orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")


@query("A08_graph_stats", with_sql("SELECT n.case_id, nodes, edges FROM (SELECT case_id, count(*) AS nodes FROM ents GROUP BY 1) n JOIN (SELECT case_id, count(*) AS edges FROM rels GROUP BY 1) e ON n.case_id = e.case_id"))
def a08(spark, d):
    n = entities(spark, d).groupBy("case_id").agg(F.count("*").alias("nodes"))
    return n.join(relationships(spark, d).groupBy("case_id").agg(F.count("*").alias("edges")), "case_id")


@query("A09_A10_device_stats", "SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def a09(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("A27_by_status", with_sql("SELECT status, count(*) AS n FROM ents GROUP BY 1"))
def a27(spark, d):
    return entities(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("A29_K03_page", with_sql("SELECT entity_id, total FROM (SELECT entity_id, count(*) OVER () AS total FROM ents WHERE case_id = 3) ORDER BY entity_id LIMIT 20 OFFSET 40"))
def a29(spark, d):
    return relational.page(entities(spark, d).where("case_id = 3").select("entity_id"), [F.col("entity_id")], 20, 40)


@query("A30_case_counts", with_sql("SELECT 'entities' AS what, count(*) AS n FROM ents UNION ALL SELECT 'relationships', count(*) FROM rels UNION ALL SELECT 'records', count(*) FROM recs"))
def a30(spark, d):
    out = None
    for name, df in (("entities", entities(spark, d)), ("relationships", relationships(spark, d)), ("records", records(spark, d))):
        row = df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


@query("A31_severity", "SELECT o_custkey, max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) AS worst, count(*) AS n FROM orders GROUP BY 1")
def a31(spark, d):
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max(rank).alias("worst"), F.count("*").alias("n"))


@query("A33_mode", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def a33(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where("k = 1").select("user_id", "event_type")


@query("A36_share", "SELECT o_orderpriority, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def a36(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("o_orderpriority", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("W01_rank", with_sql("SELECT case_id, entity_id, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, entity_id) AS rank FROM (SELECT case_id, node AS entity_id, count(*) AS n FROM ends GROUP BY 1, 2)"))
def w01(spark, d):
    n = graph.endpoints(relationships(spark, d)).groupBy("case_id", F.col("node").alias("entity_id")).agg(F.count("*").alias("n"))
    return graph.ranked(n, "n").select("case_id", "entity_id", "rank")


@query("W03_normalised", with_sql("SELECT case_id, entity_id, round(n / max(n) OVER (PARTITION BY case_id), 8) AS share FROM (SELECT case_id, node AS entity_id, count(*) AS n FROM ends GROUP BY 1, 2)"))
def w03(spark, d):
    n = graph.endpoints(relationships(spark, d)).groupBy("case_id", F.col("node").alias("entity_id")).agg(F.count("*").alias("n"))
    top = n.groupBy("case_id").agg(F.max("n").alias("m"))
    return n.join(top, "case_id").select("case_id", "entity_id", F.round(F.col("n") / F.coalesce(F.nullif("m", F.lit(0)), F.lit(1)), 8).alias("share"))


@query("W05_running_maximum", "SELECT o_orderkey, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier, o_orderdate < max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM orders")
def w05(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.max("o_orderdate").over(w).alias("earlier"))
    return rows.select("o_orderkey", "earlier", (F.col("o_orderdate") < F.col("earlier")).alias("back"))


@query("W06_first_seen", "SELECT l_orderkey, l_linenumber, l_returnflag <> first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS conflict FROM lineitem")
def w06(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") != F.first("l_returnflag").over(w)).alias("conflict"))


@query("W07_spread", with_sql("SELECT case_id, node AS entity_id, date_diff('second', min(created_at), max(created_at)) AS seconds FROM ends WHERE created_at IS NOT NULL GROUP BY 1, 2"))
def w07(spark, d):
    e = graph.endpoints(relationships(spark, d)).where("created_at is not null")
    return e.groupBy("case_id", F.col("node").alias("entity_id")).agg((F.unix_seconds(F.max("created_at").cast("timestamp")) - F.unix_seconds(F.min("created_at").cast("timestamp"))).alias("seconds"))


@query("W08_burst_window", "SELECT user_id, min(s) AS start_s, CAST(arg_min(n, s) AS BIGINT) AS n FROM (SELECT user_id, epoch(ts)::BIGINT AS s, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN CURRENT ROW AND 600 FOLLOWING) AS n FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)) WHERE n >= 2 GROUP BY 1")
def w08(spark, d):
    from tracewell.operators.rules import bursts

    return bursts(table(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")), "user_id", "s", 600, 2)


@query("W09_earliest_latest", "SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS first_purchase, max(ts) FILTER (event_type = 'view') AS last_view FROM events GROUP BY 1")
def w09(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("first_purchase"), F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last_view"))


@query("W10_bucket_cap", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5")
def w10(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).alias("k")).where("k <= 5").drop("k")


@query("W11_backoff", "SELECT event_id, least(3600, 30 * pow(2, least(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, 10)))::BIGINT AS ttl FROM events WHERE event_type = 'error'")
def w11(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", F.least(F.lit(3600), 30 * F.pow(F.lit(2), F.least(n - 1, F.lit(10)))).cast("long").alias("ttl"))


@query("K01_K02_ordered", with_sql("SELECT src, dst, confidence FROM rels ORDER BY confidence DESC NULLS LAST, src, dst LIMIT 50"))
def k01(spark, d):
    return relationships(spark, d).select("src", "dst", "confidence").orderBy(F.desc_nulls_last("confidence"), "src", "dst").limit(50)


@query("K04_bounded", "SELECT event_id, true AS bounded FROM events ORDER BY ts, event_id LIMIT 100")
def k04(spark, d):
    return relational.bounded(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], 100).select("event_id", "bounded")


@query("K07_capped_ids", "SELECT o_custkey, list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 5) AS ids, count(*) > 5 AS capped FROM orders GROUP BY 1")
def k07(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(relational.capped(F.collect_list("o_orderkey"), 5).alias("x")).select("o_custkey", "x.ids", "x.capped")


@query("K08_sorted_cut", with_sql("SELECT case_id, record_id FROM recs QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY amount DESC, record_id) <= 25"))
def k08(spark, d):
    w = Window.partitionBy("case_id").orderBy(F.desc("amount"), "record_id")
    return records(spark, d).select("case_id", "record_id", F.row_number().over(w).alias("k")).where("k <= 25").drop("k")


@query("K09_max_by", with_sql("SELECT case_id, arg_max(record_id, (amount, record_id)) AS record_id FROM recs GROUP BY 1"))
def k09(spark, d):
    return records(spark, d).groupBy("case_id").agg(F.max(F.struct("amount", "record_id"))["record_id"].alias("record_id"))


@query("K10_most_connected", with_sql("SELECT node AS entity_id, count(*) AS n FROM ends WHERE case_id = 1 GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 15"))
def k10(spark, d):
    return graph.endpoints(relationships(spark, d)).where("case_id = 1").groupBy(F.col("node").alias("entity_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(15)


@query("U01_union_search", "SELECT priority, id FROM (SELECT 1 AS priority, 'S' || s_suppkey AS id FROM supplier WHERE contains(lower(s_name), '1') UNION ALL SELECT 2, 'N' || n_nationkey FROM nation WHERE contains(lower(n_name), '1') UNION ALL SELECT 3, 'P' || p_partkey FROM part WHERE contains(lower(p_name), '1')) ORDER BY priority, id LIMIT 40")
def u01(spark, d):
    out = None
    for k, (name, letter, key, label) in enumerate((("supplier", "S", "s_suppkey", "s_name"), ("nation", "N", "n_nationkey", "n_name"), ("part", "P", "p_partkey", "p_name")), 1):
        rows = table(spark, d, name).where(relational.escaped_like(label, "1")).select(F.lit(k).alias("priority"), F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("priority", "id").limit(40)


@query("U03_set_functions", "SELECT x.l_orderkey, len(list_intersect(x.s, y.s)) AS both, len(list_distinct(list_concat(x.s, y.s))) AS any_of FROM (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) x JOIN (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) y ON y.l_orderkey = x.l_orderkey + 1")
def u03(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    y = s.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("s").alias("t"))
    return s.join(y, "l_orderkey").select("l_orderkey", F.size(F.array_intersect("s", "t")).cast("long").alias("both"), F.size(F.array_union("s", "t")).cast("long").alias("any_of"))


@query("U04_U05_union", "SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS id FROM orders UNION ALL SELECT 'event', CAST(event_id AS VARCHAR) FROM events")
def u04(spark, d):
    return table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id")).unionByName(table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id")))


@query("U06_undirected_edges", with_sql("SELECT DISTINCT case_id, least(src, dst) AS a, greatest(src, dst) AS b FROM rels WHERE src <> dst"))
def u06(spark, d):
    return graph.undirected(relationships(spark, d))

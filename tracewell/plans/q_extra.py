"""Ranks, projections, assembled findings, citations and value checks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.domain import entities, relationships, table, with_sql
from tracewell.functions import claims as check
from tracewell.functions import text, values
from tracewell.operators import audit, graph, network
from tracewell.plans import q_graph
from tracewell.plans.registry import oracle_of, query

DEG = q_graph.DEG


@query("W02_top_ranks", with_sql(f"WITH {DEG} SELECT case_id, entity_id, degree, CAST(row_number() OVER (PARTITION BY case_id ORDER BY degree DESC, entity_id) AS INT) AS rank FROM deg QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY degree DESC, entity_id) <= 50"))
def w02(spark, d):
    """Ranks 1 to N, where a wish for 500 is held to 50."""
    deg = graph.degrees(entities(spark, d), relationships(spark, d)).select("case_id", "entity_id", "degree")
    return graph.ranked(deg, "degree", max(1, min(50, 500)))


@query("F32_clamped", "SELECT o_orderkey, round(least(1.0, greatest(0.0, o_totalprice / 250000 - 0.1)), 6) AS share, round(ln(1 + o_totalprice) / ln(1 + (SELECT max(o_totalprice) FROM orders)), 6) AS scale FROM orders")
def f32(spark, d):
    o = table(spark, d, "orders")
    top = o.agg(F.max("o_totalprice").alias("m"))
    scale = F.round(F.log1p("o_totalprice") / F.log1p("m"), 6)
    return o.crossJoin(F.broadcast(top)).select("o_orderkey", network.clamped(F.col("o_totalprice") / 250000 - 0.1).alias("share"), scale.alias("scale"))


@query("G01_graph", with_sql("SELECT e.case_id, e.entity_id, list_sort(list(DISTINCT n.other) FILTER (n.other IS NOT NULL AND n.other <> e.entity_id))[1:10] AS near, count(DISTINCT n.other) AS degree FROM ents e LEFT JOIN ends n ON n.node = e.entity_id AND n.case_id = e.case_id WHERE e.entity_type <> 'person' GROUP BY 1, 2 HAVING count(n.other) > 0"))
def g01(spark, d):
    """Vertices that are no persons, with their degree and their ten first neighbours, for display."""
    e = entities(spark, d).where("entity_type <> 'person'").select("case_id", F.col("entity_id").alias("node"))
    near = graph.neighbours(relationships(spark, d)).join(e, ["case_id", "node"], "left_semi")
    deg = near.groupBy("case_id", "node").agg(F.count("*").alias("degree"))
    first = graph.ranked(near.withColumn("one", F.lit(1)), "one", 10, key="other", by="node")
    shown = first.groupBy("case_id", "node").agg(F.sort_array(F.collect_list("other")).alias("near"))
    return deg.join(shown, ["case_id", "node"]).select("case_id", F.col("node").alias("entity_id"), "near", "degree")


@query("G08_common_neighbours", with_sql("WITH near AS (SELECT DISTINCT case_id, node, other FROM ends) SELECT x.case_id, x.node AS a, y.node AS b, count(*) AS shared FROM near x JOIN near y ON x.other = y.other AND x.case_id = y.case_id AND x.node < y.node WHERE x.node LIKE 'N%' AND y.node LIKE 'N%' GROUP BY 1, 2, 3"))
def g08(spark, d):
    return graph.common_neighbours(relationships(spark, d), entities(spark, d).where("entity_type = 'location'"))


FOUND = {"concentration": ("G16_concentration", "entity_id"), "shared_identifier": ("G14_shared_identifier", "entity_id"), "missing_link": ("G20_missing_links", "a || '>' || b")}


@query("R21_findings", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, case_id, {who} AS entity_id, severity, score FROM ({oracle_of(name)})" for kind, (name, who) in FOUND.items()) + ") QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, score DESC, kind, entity_id) <= 200")
def r21(spark, d):
    e, r = entities(spark, d), relationships(spark, d)
    deg = graph.degrees(e, r)
    firms = e.where("entity_type = 'organization'")
    links = q_graph.g20(spark, d)
    parts = {"concentration": network.concentration(deg), "shared_identifier": network.shared_identifiers(deg, firms), "missing_link": links.withColumn("entity_id", F.concat("a", F.lit(">"), "b"))}
    return network.assembled(parts)


@query("F49_citation_codes", """WITH c AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity || '-' || l_extendedprice AS citation_id, CASE WHEN l_quantity = 50 THEN 'memo' ELSE 'record' END AS kind, CASE WHEN l_tax = 0.08 THEN '' WHEN l_discount = 0.1 THEN 'x' || l_orderkey ELSE l_orderkey::VARCHAR END AS cited, CASE WHEN l_returnflag = 'A' THEN 'status' WHEN l_returnflag = 'R' THEN 'color' END AS loc, l_linestatus AS value, 'order ' || CASE WHEN l_linenumber = 7 THEN 'z' ELSE '' END || l_orderkey AS quote FROM lineitem)
SELECT citation_id, list_sort(list_filter([CASE WHEN kind = 'memo' THEN 'unknown_kind' END, CASE WHEN kind <> 'memo' AND cited = '' THEN 'invalid_id' END, CASE WHEN kind <> 'memo' AND cited <> '' AND o_orderkey IS NULL THEN 'record_missing' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'unauthorized' END, CASE WHEN o_orderstatus = 'P' THEN 'wrong_case' END,
  CASE WHEN o_orderkey IS NOT NULL AND loc = 'color' THEN 'locator_invalid' END, CASE WHEN loc = 'status' AND value <> o_orderstatus THEN 'value_mismatch' END, CASE WHEN o_orderkey IS NOT NULL AND NOT contains('order ' || o_orderkey || ' placed', quote) THEN 'quote_unsupported' END], lambda x: x IS NOT NULL)) AS codes
FROM c LEFT JOIN orders ON kind <> 'memo' AND o_orderkey::VARCHAR = cited""")
def f49(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    sources = o.select(F.lit("record").alias("kind"), key.alias("source_id"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("case_id"), (F.col("o_orderpriority") != "5-LOW").alias("visible"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("fields"), F.concat(F.lit("order "), key, F.lit(" placed")).alias("body"))
    li = table(spark, d, "lineitem")
    line = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    order = F.col("l_orderkey").cast("string")
    cited = F.when(F.col("l_tax") == 0.08, "").when(F.col("l_discount") == 0.1, F.concat(F.lit("x"), order)).otherwise(order)
    quote = F.concat(F.lit("order "), F.when(F.col("l_linenumber") == 7, "z").otherwise(""), order)
    rows = li.select(line.alias("citation_id"), F.when(F.col("l_quantity") == 50, "memo").otherwise("record").alias("kind"), cited.alias("cited_id"), F.lit(1).alias("case_id"), F.when(F.col("l_returnflag") == "A", "status").when(F.col("l_returnflag") == "R", "color").alias("locator"), F.col("l_linestatus").alias("value"), quote.alias("quote"))
    return audit.citation_codes(rows, sources)


@query("F30_values_equal", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity = round(l_discount * 100) AS numbers, l_shipdate::DATE = o_orderdate::DATE AS days, l_linestatus = o_orderstatus AS words FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def f30(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    number = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    numbers = values.values_equal(F.concat(F.lit("INR "), number("l_quantity")), F.round(F.col("l_discount") * 100).cast("long").cast("string"))
    days = values.values_equal(F.date_format("l_shipdate", "dd.MM.yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    words = values.values_equal(F.concat(F.lit(" State  "), F.lower("l_linestatus")), F.concat(F.lit("state "), "o_orderstatus"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", numbers.alias("numbers"), days.alias("days"), words.alias("words"))


@query("F28_time_field_meanings", "SELECT event_id, CASE event_type WHEN 'view' THEN 'extraction' WHEN 'click' THEN 'uploaded' WHEN 'purchase' THEN 'document_created' ELSE 'record_occurs_on' END AS meaning, event_type NOT IN ('click', 'signup') AS strong, event_type <> 'signup' AS hint FROM events")
def f28(spark, d):
    kind = F.col("event_type")
    name = F.when(kind == "view", "Parsed_Date").when(kind == "click", "uploaded_when").when(kind == "purchase", "created_at").when(kind == "signup", "remark").otherwise("incident")
    return table(spark, d, "events").select("event_id", text.time_meaning(name).alias("meaning"), text.is_strong_time_field(name).alias("strong"), text.is_time_field(name).alias("hint"))


@query("F42_labels_and_scripts", "SELECT doc_id, lang <> 'fr' AS fits FROM documents")
def f42(spark, d):
    """French texts carry the label hindi, German ones are put into Devanagari digits and labelled marathi, others unknown or english."""
    lang = F.col("lang")
    script = F.when(lang == "de", "devanagari").otherwise("latin")
    label = F.when(lang == "fr", "hindi").when(lang == "de", "marathi").when(lang == "en", "english").otherwise("unknown")
    return table(spark, d, "documents").select("doc_id", check.label_fits(script, label).alias("fits"))


@query("F47_metric_statements", with_sql(f"WITH {DEG} SELECT case_id, entity_id, degree = CASE WHEN entity_id LIKE 'S%' THEN 3 ELSE degree END AS holds FROM deg"))
def f47(spark, d):
    """Statements like "degree of S1 is 3", read back and held against the degrees."""
    deg = graph.degrees(entities(spark, d), relationships(spark, d))
    told = F.when(F.col("entity_id").startswith("S"), "3").otherwise(F.col("degree").cast("string"))
    said = deg.select("case_id", "degree", F.concat(F.lit("The degree of "), "entity_id", F.lit(" is "), told, F.lit(".")).alias("t"))
    m = r"degree of (\S+) is (\d+(?:\.\d+)?)"
    return said.select("case_id", F.regexp_extract("t", m, 1).alias("entity_id"), check.metric_holds(F.regexp_extract("t", m, 2).cast("double"), F.col("degree").cast("double")).alias("holds"))

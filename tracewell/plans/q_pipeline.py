"""Sources, sinks, the evidence-to-graph pipeline, timelines, custody, state machines and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.domain import entities, records, relationships, table, with_sql
from tracewell.functions import text
from tracewell.operators import matching, relational, rules
from tracewell.plans.registry import query
from tracewell.sources import files


@query("S04_S11_paragraphs", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS record_no, length(p) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE trim(p) <> ''")
def s04(spark, d):
    return files.paragraphs(table(spark, d, "documents"), "doc_id", "text", "\n").select("doc_id", "record_no", F.char_length("text").cast("long").alias("n"))


@query("S06_format", "SELECT page_id, CASE WHEN lower(left(ltrim(html), 1)) = '<' THEN 'html' ELSE 'txt' END AS format FROM pages")
def s06(spark, d):
    return table(spark, d, "pages").select("page_id", files.sniffed(F.col("url"), F.col("html")).alias("format"))


@query("S09_size_cap", "SELECT doc_id, strlen(text) AS size, strlen(text) <= 5242880 AS ok FROM documents")
def s09(spark, d):
    size = F.octet_length("text").cast("long")
    return table(spark, d, "documents").select("doc_id", size.alias("size"), (size <= 5 * 1024 * 1024).alias("ok"))


@query("S10_upload_dedupe", "SELECT source, sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def s10(spark, d):
    return table(spark, d, "documents").groupBy("source", F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("S12_T07_append", "SELECT o_orderkey AS id, 'old' AS origin FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'P'")
def s12(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("origin"))
    return relational.appended(o.select(F.col("o_orderkey").alias("id"), F.lit("new").alias("origin")), old, ["id"])


@query("S14_soft_delete", "SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0")
def s14(spark, d):
    return table(spark, d, "customer").withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01"))).where("deleted_at is null").select("c_custkey")


@query("S15_S18_case_report", with_sql("SELECT case_id, count(*) AS entities, count(*) FILTER (status = 'active') AS active, min(display_value) AS first_name FROM ents GROUP BY 1"))
def s15(spark, d):
    return entities(spark, d).groupBy("case_id").agg(F.count("*").alias("entities"), F.count_if(F.col("status") == "active").alias("active"), F.min("display_value").alias("first_name"))


@query("S19_timeline", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS position FROM events")
def s19(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("position"))


@query("S20_S21_projection", with_sql("SELECT case_id, src, dst, rel_type FROM rels WHERE case_id = 2"))
def s20(spark, d):
    """Edges written by case, so that reading a case prunes the others."""
    from tracewell.operators.graph import scratch

    path = scratch(spark)
    relationships(spark, d).select("case_id", "src", "dst", "rel_type").write.partitionBy("case_id").parquet(path)
    return spark.read.parquet(path).where("case_id = 2").select(F.col("case_id").cast("int").alias("case_id"), "src", "dst", "rel_type")


@query("S22_S23_manifest_check", "SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) > 1 AS duplicate FROM documents")
def s22(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    again = docs.groupBy("h").agg((F.count("*") > 1).alias("duplicate"))
    return docs.join(again, "h").select("doc_id", "duplicate")


@query("P05_P06_headers", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS header FROM part")
def p05(spark, d):
    return table(spark, d, "part").select("p_partkey", text.header(F.col("p_type")).alias("header"))


@query("E01_field_mentions", with_sql("SELECT entity_id, entity_type, canonical FROM (SELECT entity_id, entity_type, CASE entity_type WHEN 'location' THEN replace(canonical_value, '_', ' ') WHEN 'organization' THEN replace(canonical_value, '#', ' ') ELSE canonical_value END AS canonical FROM ents)"))
def e01(spark, d):
    return entities(spark, d).select("entity_id", "entity_type", text.normalized(F.col("entity_type"), F.col("display_value")).alias("canonical"))


@query("E02_rule_mentions", r"SELECT doc_id, raw FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\+?[0-9][0-9\t\n\r ().-]{6,}[0-9]')) AS raw FROM documents) WHERE NOT (length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 12 AND NOT raw LIKE '+%' AND regexp_full_match(raw, '[0-9]+|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}'))")
def e02(spark, d):
    raw = F.col("raw")
    found = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\+?[0-9][0-9\t\n\r ().-]{6,}[0-9])"), F.lit(1))).alias("raw"))
    number = (F.length(F.regexp_replace(raw, "[^0-9]", "")) >= 12) & ~raw.startswith("+") & raw.rlike("^([0-9]+|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4})$")
    return found.where(~number)


@query("E05_J13_pair_proposals")
def e05(spark, d):
    return matching.proposals(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.lit("person").alias("entity_type"), F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("canonical_value")))


@query("E07_E09_structured_pairs", with_sql("SELECT record_id, src, dst, rel_type FROM (SELECT DISTINCT record_id, 1 AS step, party AS src, account AS dst, 'works_for' AS rel_type FROM recs UNION ALL SELECT DISTINCT record_id, 2, a.account, b.account, 'associated_with' FROM recs a JOIN recs b USING (record_id) WHERE a.account < b.account) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY step, src, dst) <= 15"))
def e07(spark, d):
    r = records(spark, d)
    m = r.select("record_id", F.lit("person").alias("kind"), F.col("party").alias("id")).union(r.select("record_id", F.lit("organization"), F.col("account")))
    return matching.structured_relationships(m.withColumn("pos", F.lit(0)))


@query("E11_edge_dedupe", with_sql("SELECT party, account, count(*) AS evidence FROM recs GROUP BY 1, 2"))
def e11(spark, d):
    return records(spark, d).groupBy("party", "account").agg(F.count("*").alias("evidence"))


@query("E12_merge", with_sql("SELECT DISTINCT CASE WHEN src LIKE 'S%' AND CAST(substr(src, 2) AS BIGINT) > 0 THEN 'S0' ELSE src END AS src, dst FROM rels WHERE rel_type = 'located_at'"))
def e12(spark, d):
    r = relationships(spark, d).where("rel_type = 'located_at'").select("src", "dst")
    merged = entities(spark, d).where("entity_type = 'organization' and entity_id <> 'S0'").select(F.col("entity_id").alias("src"), F.lit("S0").alias("into"))
    return matching.merged(r, merged)


@query("E17_alias_map", "SELECT c_nationkey, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS aliases FROM customer GROUP BY 1")
def e17(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("aliases"))


@query("E18_duplicate_edges", with_sql("SELECT party, account, min(record_id) AS keeper FROM recs GROUP BY 1, 2"))
def e18(spark, d):
    w = Window.partitionBy("party", "account").orderBy("record_id")
    return records(spark, d).select("party", "account", F.col("record_id").alias("keeper"), F.row_number().over(w).alias("k")).where("k = 1").drop("k")


@query("R13_R17_observations", "SELECT page_id, 'url_query' AS rule, 'low' AS severity FROM pages WHERE contains(url, '?') UNION ALL SELECT page_id, 'url_plain_http', 'medium' FROM pages WHERE url LIKE 'http://%'")
def r13(spark, d):
    p = table(spark, d, "pages")
    a = p.where(F.contains("url", F.lit("?"))).select("page_id", F.lit("url_query").alias("rule"), F.lit("low").alias("severity"))
    return a.unionByName(p.where(F.col("url").startswith("http://")).select("page_id", F.lit("url_plain_http").alias("rule"), F.lit("medium").alias("severity")))


@query("R23_state_machine", "SELECT user_id, event_id, old, new, coalesce(old = new OR (old, new) IN (('view', 'click'), ('click', 'purchase'), ('signup', 'view')), false) AS legal FROM (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, event_type AS new FROM events) WHERE old IS NOT NULL")
def r23(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, d, "events").select("user_id", "event_id", F.lag("event_type").over(w).alias("old"), F.col("event_type").alias("new")).where("old is not null")
    return rules.legal_steps(steps, [("view", "click"), ("click", "purchase"), ("signup", "view")])


@query("R24_evidence_weight", "SELECT o_orderkey, (count(*) FILTER (l_returnflag = 'A') - count(*) FILTER (l_returnflag = 'R'))::BIGINT AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def r24(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderkey").agg((F.count_if(F.col("l_returnflag") == "A") - F.count_if(F.col("l_returnflag") == "R")).alias("weight"))


@query("F16_indel_ratio")
def f16(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("b"))
    return p.select("p_partkey", matching.indel_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query("T06_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def t06(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("m")))).where("ts >= m - INTERVAL 7 DAY").select("event_id")


@query("T08_future_skew", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' + INTERVAL 300 SECOND")
def t08(spark, d):
    return table(spark, d, "events").where("ts > TIMESTAMP_NTZ '2024-01-20' + INTERVAL 300 SECOND").select("event_id")

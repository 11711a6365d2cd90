"""Queries that check statements, citations and model output against their sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.domain import entities, records, relationships, table, with_sql
from tracewell.functions import claims, text, values
from tracewell.operators import graph, matching
from tracewell.plans.registry import query
from tracewell.plans.q_text import TEL

#: Order lines as sentences.
LINES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'parts ' || CAST(l_quantity AS BIGINT) || ' and ' || l_partkey || ', total ' || (CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber = 1 THEN l_partkey + 1 ELSE l_partkey END) AS t FROM lineitem)"


def _lines(spark, d):
    q = F.col("l_quantity").cast("long")
    total = q + F.col("l_partkey") + F.when(F.col("l_linenumber") == 1, 1).otherwise(0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("parts "), q.cast("string"), F.lit(" and "), F.col("l_partkey").cast("string"), F.lit(", total "), total.cast("string")).alias("t"))


@query("F23_F24_arithmetic", f"SELECT l_orderkey, l_linenumber, l_linenumber <> 1 AS holds FROM {LINES}")
def f23(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", claims.total_holds(F.col("t")).alias("holds"))


@query("F27_dates_in_text", "SELECT o_orderkey, [CAST(o_orderdate AS DATE), DATE '2024-02-29'] AS dates FROM orders")
def f27(spark, d):
    t = F.concat(F.lit("on "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(", not 31/02/2024, or 2024-02-29."))
    return table(spark, d, "orders").select("o_orderkey", claims.dates(t).alias("dates"))


@query("F29_dates_agree", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) = CAST(o_orderdate AS DATE) AS agree FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def f29(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", values.values_equal(F.date_format("l_shipdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "d/M/yyyy")).alias("agree"))


@query("F35_F36_json", "SELECT event_id, props IS NOT NULL AS found, ['missing:v'] AS issues FROM events")
def f35(spark, d):
    raw = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, d, "events").select("event_id", claims.json_object(raw).alias("o")).select("event_id", F.col("o").isNotNull().alias("found"), claims.schema_issues(F.col("o"), ["k", "v"]).alias("issues"))


@query("F37_F31_value_in_source", "SELECT d.doc_id, contains(d.text, b.text) AS whole, contains(d.text, d.text) AS own FROM documents d JOIN benchmark b ON b.item_id = d.doc_id")
def f37(spark, d):
    """Whole benchmark texts, and documents themselves, looked up in whole documents."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("value"))
    rows = table(spark, d, "documents").join(items, "doc_id")
    return rows.select("doc_id", F.contains("text", F.col("value")).alias("whole"), F.contains("text", F.col("text")).alias("own"))


@query("F41_negation", r"SELECT doc_id, regexp_matches(text, '(?i)\b(not|no|never|none|neither|den(?:y|ied|ies)|refus(?:e|ed)|without)\b') AS negated FROM documents")
def f41(spark, d):
    return table(spark, d, "documents").select("doc_id", claims.negated(F.col("text")).alias("negated"))


@query("F42_label_fits", "SELECT doc_id, lang = 'en' AS fits FROM documents")
def f42(spark, d):
    label = F.when(F.col("lang") == "en", "english").when(F.col("lang") == "fr", "hindi").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", claims.label_fits(F.lit("latin"), label).alias("fits"))


@query("F43_claim_tokens", f"SELECT l_orderkey, l_linenumber, len(list_distinct(list_filter(regexp_extract_all(t, '[0-9]+'), lambda x: length(x) >= 3))) AS n FROM {LINES}")
def f43(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.size(claims.tokens(F.col("t"))).cast("long").alias("n"))


@query("F40_material_missing", r"SELECT l_orderkey, l_linenumber, list_sort(list_filter(list_distinct(regexp_extract_all(t, '[0-9]+')), lambda x: NOT contains('part ' || l_partkey, x))) AS missing FROM " + LINES)
def f40(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.array_sort(claims.material_missing(F.col("t"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")))).alias("missing"))


@query("F47_metric_claims", with_sql("SELECT entity_id, confidence = 0.9::DOUBLE AS holds FROM ents"))
def f47(spark, d):
    return entities(spark, d).select("entity_id", claims.metric_holds(F.lit(0.9), F.col("confidence")).alias("holds"))


@query("F48_fabricated_numbers", f"SELECT l_orderkey, l_linenumber, len(list_filter(list_distinct(regexp_extract_all(t, '[0-9]{{2,}}')), lambda x: x <> l_partkey::VARCHAR)) AS made_up FROM {LINES}")
def f48(spark, d):
    found = F.array_distinct(F.regexp_extract_all("t", F.lit("([0-9]{2,})"), F.lit(1)))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.size(F.array_except(found, F.array(F.col("l_partkey").cast("string")))).cast("long").alias("made_up"))


@query("F49_citations", "SELECT l.doc_id, list_filter([CASE WHEN d.doc_id IS NULL THEN 'record_missing' END, CASE WHEN d.lang <> 'en' THEN 'wrong_case' END], lambda x: x IS NOT NULL) AS issues FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id + 1")
def f49(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), "lang")
    rows = table(spark, d, "labels").select("doc_id").join(docs, "doc_id", "left")
    return rows.select("doc_id", F.array_compact(F.array(F.when(F.col("lang").isNull(), "record_missing"), F.when(F.col("lang") != "en", "wrong_case"))).alias("issues"))


@query("R20_audit", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'high' ELSE 'none' END AS severity FROM {LINES}")
def r20(spark, d):
    codes = F.array_compact(F.array(F.when(~claims.total_holds(F.col("t")), "numeric_mismatch")))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", claims.worst(codes).alias("severity"))


@query("J06_roles", "SELECT conv_id, role, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1, 2")
def j06(spark, d):
    roles = F.broadcast(spark.createDataFrame([("user",), ("assistant",)], "role string"))
    return table(spark, d, "conversations").join(roles, "role").groupBy("conv_id", "role").agg(F.count("*").alias("n"))


@query("J18_contributing", with_sql("WITH k AS (SELECT DISTINCT file_id FROM recs WHERE discount = 0 AND currency = 'R') SELECT record_id, part FROM recs WHERE file_id IN (SELECT file_id FROM k)"))
def j18(spark, d):
    r = records(spark, d).select("record_id", "file_id", "part", "discount", "currency")
    return r.join(r.where("discount = 0 and currency = 'R'").select("file_id").distinct(), "file_id", "left_semi").select("record_id", "part")


@query("J29_job_artifacts", "SELECT d.doc_id, count(l.doc_id) AS artifacts FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def j29(spark, d):
    n = table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("artifacts"))
    return table(spark, d, "documents").select("doc_id").join(n, "doc_id", "left").na.fill(0, ["artifacts"])


@query("A23_identifier_index", f"SELECT lower(w) AS id, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, {TEL})) AS w FROM documents) GROUP BY 1")
def a23(spark, d):
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(\+?[0-9][0-9\t\n\r ().-]{6,}[0-9])"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", found.alias("w")).groupBy(F.lower("w").alias("id")).agg(F.count_distinct("doc_id").alias("docs"))


@query("K05_K06_merged_top", "SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL SELECT * FROM (SELECT 'part', p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5)")
def k05(spark, d):
    rows = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")).unionByName(table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")))
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "id")
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")


@query("U02_first_mention", "SELECT w, min(k) AS source FROM (SELECT lower(s_name) AS w, 1 AS k FROM supplier UNION ALL SELECT lower(c_name), 2 FROM customer UNION ALL SELECT lower(p_name), 3 FROM part) GROUP BY 1")
def u02(spark, d):
    out = None
    for k, (name, col) in enumerate((("supplier", "s_name"), ("customer", "c_name"), ("part", "p_name")), 1):
        rows = table(spark, d, name).select(F.lower(col).alias("w"), F.lit(k).alias("k"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("w").agg(F.min("k").alias("source"))


@query("P02_P07_aliases", "SELECT event_id, json_extract_string(props, '$.k') AS amount, event_type AS note FROM events")
def p02(spark, d):
    m = F.from_json("props", "map<string,string>")
    first = F.coalesce(*[F.nullif(F.element_at(m, F.lit(k)), F.lit("")) for k in ("amount", "transaction_amount", "value", "k")])
    return table(spark, d, "events").select("event_id", first.alias("amount"), F.concat_ws(" ", "event_type").alias("note"))


@query("P19_case_search", with_sql("SELECT entity_id, display_value FROM ents WHERE contains(lower(display_value), 'nation_1') ORDER BY display_value, entity_id LIMIT 5"))
def p19(spark, d):
    from tracewell.operators.relational import escaped_like

    return entities(spark, d).where(escaped_like("display_value", "NATION_1")).orderBy("display_value", "entity_id").limit(5).select("entity_id", "display_value")


@query("E04_E06_resolution")
def e04(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("mention"), F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("canonical_value"))
    pairs = matching.proposals(names.select(F.format_string("%09d", "mention").alias("entity_id"), F.lit("person").alias("entity_type"), "canonical_value"))
    first = pairs.where("band = 'strong'").groupBy("b").agg(F.min("a").alias("target"))
    return names.select(F.format_string("%09d", "mention").alias("b")).join(first, "b", "left").select(F.col("b").alias("mention"), F.coalesce("target", "b").alias("entity"))


@query("E08_E10_co_occurrence", "SELECT a, b, count(*) AS n FROM (SELECT DISTINCT x.l_orderkey, x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey) GROUP BY 1, 2")
def e08(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = s.withColumnRenamed("l_suppkey", "a").join(s.withColumnRenamed("l_suppkey", "b"), "l_orderkey").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("E13_E14_E15_review", with_sql("SELECT case_id, entity_type, status, count(*) AS n FROM ents GROUP BY 1, 2, 3"))
def e13(spark, d):
    return entities(spark, d).groupBy("case_id", "entity_type", "status").agg(F.count("*").alias("n"))


@query("G10_centrality", with_sql("WITH g AS (SELECT e.case_id, e.entity_id, count(DISTINCT n.other) AS degree FROM ents e LEFT JOIN ends n ON n.node = e.entity_id AND n.case_id = e.case_id GROUP BY 1, 2) SELECT case_id, entity_id, degree::DOUBLE AS raw, round(degree / greatest(1, max(degree) OVER (PARTITION BY case_id)), 8) AS normalized, CAST(row_number() OVER (PARTITION BY case_id ORDER BY degree DESC, entity_id) AS INT) AS rank FROM g"))
def g10(spark, d):
    deg = graph.degrees(entities(spark, d), relationships(spark, d)).select("case_id", "entity_id", F.col("degree").cast("double").alias("raw"))
    top = deg.groupBy("case_id").agg(F.max("raw").alias("m"))
    rows = deg.join(top, "case_id").select("case_id", "entity_id", "raw", F.round(F.col("raw") / F.greatest(F.lit(1.0), F.col("m")), 8).alias("normalized"))
    return graph.ranked(rows, "raw")


@query("R15_manifest", "SELECT doc_id, len(regexp_extract_all(text, '[0-9a-f]{16,}')) AS digests FROM documents")
def r15(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("([0-9a-f]{16,})"), F.lit(1))).cast("long").alias("digests"))


@query("R25_digests", with_sql("SELECT case_id, count(*) AS entities, count(*) FILTER (entity_type = 'person') AS persons, count(*) FILTER (status = 'review') AS to_review FROM ents GROUP BY 1"))
def r25(spark, d):
    return entities(spark, d).groupBy("case_id").agg(F.count("*").alias("entities"), F.count_if(F.col("entity_type") == "person").alias("persons"), F.count_if(F.col("status") == "review").alias("to_review"))


@query("S01_S02_csv_round_trip", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events")
def s01(spark, d):
    from tracewell.operators.graph import scratch
    from tracewell.sources.files import read_csv

    base = scratch(spark)
    table(spark, d, "events").select("event_id", "event_type").write.option("header", True).csv(f"{base}-csv")
    return read_csv(spark, f"{base}-csv").select(F.element_at("raw", "event_id").alias("event_id"), F.element_at("raw", "event_type").alias("event_type"))


@query("S03_S16_json_round_trip", "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1")
def s03(spark, d):
    from tracewell.operators.graph import scratch

    base = scratch(spark)
    table(spark, d, "conversations").select("conv_id", "turn", "role").write.json(f"{base}-json")
    return spark.read.schema("conv_id long, turn int, role string").json(f"{base}-json").groupBy("conv_id").agg(F.count("*").alias("turns"))

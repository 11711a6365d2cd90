"""Report audit. An order is a draft, its lines are the claims, one after another; parts are what they cite."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.domain import table
from tracewell.functions import claims as check
from tracewell.operators import audit
from tracewell.operators.graph import cut
from tracewell.plans.registry import query

CLAIMS = """WITH li AS (SELECT l_orderkey AS draft_id, l_linenumber AS n, min(l_partkey) AS part, min(CAST(l_quantity AS BIGINT)) AS q, min(l_shipdate) AS day, min(l_returnflag) AS flag, min(l_linestatus) AS st, min(l_discount) AS disc, min(l_tax) AS tax FROM lineitem GROUP BY 1, 2),
txt AS (SELECT *, 'c' || CASE WHEN tax = 0 THEN 1 ELSE n END AS claim_id, CASE WHEN q = 50 THEN 'gossip' WHEN flag = 'N' THEN 'timeline' ELSE 'financial' END AS category,
  CASE WHEN flag = 'N' THEN 'Shipped on ' || strftime(day, '%Y-%m-%d') || '.' WHEN flag = 'A' THEN 'Paid ' || CASE WHEN st = 'F' THEN 'USD ' ELSE 'EUR ' END || q || '.00 for it.' ELSE 'Parts ' || q || ' and ' || part || ', total ' || (q + part + CASE WHEN st = 'F' THEN 1 ELSE 0 END) || '.' END AS text FROM li),
c AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY draft_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN disc = 0.1 THEN 1 ELSE 0 END AS start FROM txt),
cit AS (SELECT draft_id, claim_id, p_size <= 10 AS wrong, p_retailprice > 1500 AS off FROM c JOIN part ON part = p_partkey),
f AS (
  SELECT draft_id, claim_id, 'claim_extraction_invalid' AS code FROM (SELECT *, row_number() OVER (PARTITION BY draft_id, claim_id ORDER BY start, text) AS k FROM c) WHERE category = 'gossip' OR k > 1 OR disc = 0.1
  UNION ALL SELECT draft_id, claim_id, 'numeric_mismatch' FROM cit WHERE off
  UNION ALL SELECT draft_id, claim_id, 'invalid_citation' FROM cit WHERE wrong
  UNION ALL SELECT draft_id, claim_id, 'numeric_mismatch' FROM c WHERE flag = 'R' AND st = 'F'
  UNION ALL SELECT draft_id, claim_id, 'timeline_discrepancy' FROM (SELECT *, max(day) OVER (PARTITION BY draft_id ORDER BY start, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c WHERE category = 'timeline') WHERE day < before
  UNION ALL SELECT DISTINCT x.draft_id, x.claim_id, 'currency_mismatch' FROM c x JOIN (SELECT draft_id, q, arg_min(st, (start, claim_id)) AS st FROM c WHERE flag = 'A' GROUP BY 1, 2) y ON x.draft_id = y.draft_id AND x.q = y.q AND x.st <> y.st WHERE flag = 'A'
  UNION ALL SELECT draft_id, claim_id, CASE WHEN tax > 0.06 THEN 'assessment_unverified' WHEN disc < 0.01 THEN 'contradicted' WHEN disc < 0.02 THEN 'partially_supported' ELSE 'not_established' END FROM c JOIN part ON part = p_partkey WHERE p_size > 10 AND p_retailprice <= 1500 AND (tax > 0.06 OR disc < 0.03)
  UNION ALL SELECT DISTINCT c.draft_id, c.claim_id, 'counter_evidence_candidate' FROM c JOIN (SELECT DISTINCT o_custkey::VARCHAR AS w FROM orders) ON w = part::VARCHAR WHERE flag = 'R' AND part >= 100)
"""
LEVEL = "CASE WHEN code IN ('partially_supported', 'not_established', 'assessment_unverified') THEN 'medium' WHEN code = 'counter_evidence_candidate' THEN 'info' ELSE 'high' END"


def _inputs(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("n")).agg(*[F.min(c).alias(a) for c, a in (("l_partkey", "part"), ("l_quantity", "q"), ("l_shipdate", "day"), ("l_returnflag", "flag"), ("l_linestatus", "st"), ("l_discount", "disc"), ("l_tax", "tax"))])
    li = li.withColumn("q", F.col("q").cast("long"))
    q, part, late = F.col("q").cast("string"), F.col("part").cast("string"), F.col("st") == "F"
    plain, paid = F.col("flag") == "N", F.col("flag") == "A"
    total = (F.col("q") + F.col("part") + F.when(late, 1).otherwise(0)).cast("string")
    said = F.when(plain, F.concat(F.lit("Shipped on "), F.date_format("day", "yyyy-MM-dd"), F.lit("."))).when(paid, F.concat(F.lit("Paid "), F.when(late, "USD ").otherwise("EUR "), q, F.lit(".00 for it."))).otherwise(F.concat(F.lit("Parts "), q, F.lit(" and "), part, F.lit(", total "), total, F.lit(".")))
    rows = li.withColumns({"text": said, "claim_id": F.concat(F.lit("c"), F.when(F.col("tax") == 0, 1).otherwise(F.col("n")).cast("string")), "category": F.when(F.col("q") == 50, "gossip").when(plain, "timeline").otherwise("financial")})
    before = Window.partitionBy("draft_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)) + F.when(F.col("disc") == 0.1, 1).otherwise(0)
    rows = rows.withColumn("start", at).withColumn("end", F.col("start") + F.length("text"))
    # every check reads the claims, so they are made once
    rows = cut(rows.select("draft_id", "n", "claim_id", "start", "end", "category", "text", "part", "disc", "tax", "flag"))
    drafts = rows.groupBy("draft_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("body"))
    cited = rows.join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_size", "p_retailprice"), "part")
    codes = F.array_compact(F.array(F.when(F.col("p_size") <= 10, "wrong_case"), F.when(F.col("p_retailprice") > 1500, "citation_value_mismatch")))
    cited = cited.withColumn("codes", codes)
    verdict = F.when(F.col("disc") < 0.01, "contradicted").when(F.col("disc") < 0.02, "partially_supported").when(F.col("disc") < 0.03, "not_established").otherwise("supported")
    quotes = F.when(F.col("tax") > 0.06, F.array(F.concat("text", F.lit("?")), F.col("text"))).otherwise(F.array(F.col("text")))
    judged = cited.where(F.size("codes") == 0).select("draft_id", "claim_id", verdict.alias("verdict"), check.unverified(quotes, F.concat(F.lit("Excerpt: "), "text")).alias("unverified"))
    words = rows.where("flag = 'R' and part >= 100").select(F.struct("draft_id", "claim_id").alias("claim"), part.alias("word"))
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").cast("string").alias("word"))
    counter = audit.counter_matches(words, known).select("claim.draft_id", "claim.claim_id")
    return rows.select("draft_id", "claim_id", "start", "end", "category", "text"), drafts, cited.select("draft_id", "claim_id", "codes"), judged, counter


@query("R20_audit_findings", f"{CLAIMS} SELECT draft_id, claim_id, code, {LEVEL} AS severity FROM f")
def r20_findings(spark, d):
    return audit.findings(*_inputs(spark, d))


@query("R20_A31_claim_severities", f"{CLAIMS} SELECT c.draft_id, c.claim_id, coalesce(n, 0) AS findings, coalesce(severity, 'none') AS severity FROM (SELECT DISTINCT draft_id, claim_id FROM c) c LEFT JOIN (SELECT draft_id, claim_id, count(*) AS n, arg_max({LEVEL}, CASE {LEVEL} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS severity FROM f GROUP BY 1, 2) x ON x.draft_id = c.draft_id AND x.claim_id = c.claim_id")
def r20_severities(spark, d):
    parts = _inputs(spark, d)
    return audit.severities(parts[0], audit.findings(*parts))


@query("F44_unverified_quotes", "WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations) SELECT conv_id, turn, (CASE WHEN contains(after, text) THEN 0 ELSE 1 END + CASE WHEN contains(after, array_to_string(list_reverse(string_split(after, ' ')), ' ')) THEN 0 ELSE 1 END)::INT AS bad FROM t WHERE after IS NOT NULL AND text IS NOT NULL")
def f44(spark, d):
    """Each turn and the next one read backwards as quotes from the next; the next one itself is always found."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, d, "conversations").select("conv_id", "turn", "text", after.alias("after")).where("after is not null and text is not null")
    back = F.array_join(F.reverse(F.split("after", " ")), " ")
    return t.select("conv_id", "turn", F.size(check.unverified(F.array(F.col("text"), back, F.col("after")), F.col("after"))).alias("bad"))


@query("F50_spans", "WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text <> ''), p AS (SELECT doc_id, text, a[len(a)] AS part, length(text) - length(a[len(a)]) AS pos FROM s) SELECT doc_id, length(part) > 0 AS good, length(part) > 0 AND pos > 0 AND substr(text, pos, length(part)) = part AS moved FROM p")
def f50(spark, d):
    """The last line of each whole text at its place, and one character before it."""
    docs = table(spark, d, "documents").where("text <> ''")
    part = F.element_at(F.split("text", "\n"), -1)
    rows = docs.select("doc_id", "text", part.alias("part"), (F.length("text") - F.length(part)).alias("at"))
    at, stop = F.col("at"), F.col("at") + F.length("part")
    return rows.select("doc_id", check.span_holds(F.col("text"), at, stop, F.col("part")).alias("good"), check.span_holds(F.col("text"), at - 1, stop - 1, F.col("part")).alias("moved"))


@query("J26_counter_evidence", "WITH d AS (SELECT DISTINCT doc_id, lower(w) AS w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) >= 6), b AS (SELECT DISTINCT item_id, lower(w) AS w FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 6) SELECT item_id, doc_id FROM (SELECT DISTINCT item_id, doc_id FROM b JOIN d USING (w)) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id) <= 3")
def j26(spark, d):
    words = lambda name, key: table(spark, d, name).select(F.col(key), F.explode(F.split("text", " ")).alias("w")).where("length(w) >= 6").select(key, F.lower("w").alias("word"))
    hits = audit.counter_matches(words("benchmark", "item_id").withColumnRenamed("item_id", "claim"), words("documents", "doc_id").withColumnRenamed("doc_id", "record_id"))
    return hits.select(F.col("claim").alias("item_id"), F.col("record_id").alias("doc_id"))

"""Timeline proposals. Orders are records, their customer is the evidence file, order lines are extracted dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.domain import table
from tracewell.operators import timeline
from tracewell.plans.registry import query

FIELDS = """WITH f AS (
  SELECT o_orderkey AS record_id, o_custkey AS evidence_id, o_orderkey AS record_no, 'record' AS origin, unnest(['occurred_on_date', 'incident_stamp', 'billing_period', 'created_at', 'remark']) AS field, NULL::INT AS idx,
    unnest([strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority, o_orderpriority, strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%Y-%m-%d')]) AS value
  FROM orders WHERE o_orderstatus <> 'P'),
a AS (
  SELECT l_orderkey AS record_id, o_custkey AS evidence_id, l_orderkey AS record_no, 'artifact' AS origin, CASE WHEN l_returnflag = 'N' THEN 'transaction_dates' ELSE 'events' END AS field, l_linenumber AS idx,
    CASE WHEN l_returnflag = 'N' THEN strftime(CASE WHEN l_linestatus = 'F' THEN o_orderdate ELSE l_shipdate END, '%Y-%m-%d') WHEN l_returnflag = 'A' THEN 'shipped on ' || strftime(l_shipdate, '%Y-%m-%d') || ' by ' || l_suppkey ELSE 'returned later' END AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'),
one AS (SELECT record_id, evidence_id, record_no, origin, field, idx, field || ': ' || value AS title, value AS original, try_strptime(value, ['%Y-%m-%d', '%d/%m/%Y']) AS occurred_at,
  CASE WHEN field LIKE '%created%' THEN 'document_created' ELSE 'record_occurs_on' END AS meaning FROM f WHERE field <> 'remark'),
first AS (SELECT * FROM one WHERE NOT (field = 'billing_period' AND occurred_at IS NULL)),
said AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY idx, value) AS k FROM a WHERE field = 'events'),
drafts AS (
  SELECT * FROM first
  UNION ALL SELECT record_id, evidence_id, record_no, origin, field, idx, field || ': ' || value, value, try_strptime(value, '%Y-%m-%d'), 'record_occurs_on' FROM a WHERE field = 'transaction_dates'
  UNION ALL SELECT record_id, evidence_id, record_no, origin, field, idx, value, value, try_strptime(regexp_extract(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '%Y-%m-%d'), 'statement_refers_to_event' FROM said WHERE k <= 10)
"""
ANNOTATED = FIELDS + """,
days AS (SELECT record_id, occurred_at::DATE AS day, bool_or(origin = 'record') AS own, bool_or(origin = 'artifact') AS other FROM drafts WHERE occurred_at IS NOT NULL GROUP BY 1, 2),
apart AS (SELECT record_id, bool_or(own) AND bool_or(other) AND NOT bool_or(own AND other) AS apart FROM days GROUP BY 1),
old AS (SELECT o_custkey AS evidence_id, o_orderdate::DATE AS day, min(o_orderkey) AS existing_event_id FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2),
marked AS (
  SELECT d.*, d.occurred_at IS NOT NULL AND row_number() OVER (PARTITION BY d.evidence_id, d.occurred_at, lower(title) ORDER BY record_no, d.record_id, origin, field, idx) > 1 AS duplicate,
    d.occurred_at IS NOT NULL AND coalesce(apart, false) AS conflicting, existing_event_id
  FROM drafts d LEFT JOIN apart USING (record_id) LEFT JOIN old ON old.evidence_id = d.evidence_id AND old.day = d.occurred_at::DATE)
"""


def _drafts(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    pairs = [("occurred_on_date", iso("o_orderdate")), ("incident_stamp", F.col("o_orderpriority")), ("billing_period", F.col("o_orderpriority")), ("created_at", F.date_format("o_orderdate", "dd/MM/yyyy")), ("remark", iso("o_orderdate"))]
    keys = [F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("evidence_id"), F.col("o_orderkey").alias("record_no")]
    fields = o.select(*keys, F.lit("record").alias("origin"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in pairs])).alias("x"))
    fields = fields.select("record_id", "evidence_id", "record_no", "origin", "x.field", F.lit(None).cast("int").alias("idx"), "x.value")
    lines = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    plain = F.col("l_returnflag") == "N"
    said = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("shipped on "), iso("l_shipdate"), F.lit(" by "), F.col("l_suppkey").cast("string"))).otherwise("returned later")
    found = lines.select(*keys, F.lit("artifact").alias("origin"), F.when(plain, "transaction_dates").otherwise("events").alias("field"), F.col("l_linenumber").alias("idx"), F.when(plain, iso(F.when(F.col("l_linestatus") == "F", F.col("o_orderdate")).otherwise(F.col("l_shipdate")))).otherwise(said).alias("value"))
    return timeline.field_drafts(fields).unionByName(timeline.artifact_drafts(found))


def _existing(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("evidence_id"), F.col("o_orderdate").alias("occurred_at"))


@query("R05_R06_timeline_drafts", FIELDS + "SELECT record_id, origin, field, idx, title, occurred_at::DATE AS day, meaning, occurred_at IS NULL AS missing, CASE WHEN occurred_at IS NOT NULL THEN 'date' END AS granularity FROM drafts")
def r05(spark, d):
    return _drafts(spark, d).select("record_id", "origin", "field", "idx", "title", F.to_date("occurred_at").alias("day"), "meaning", "missing", "granularity")


@query("R06_timeline_annotation", ANNOTATED + "SELECT record_id, origin, field, idx, original, duplicate, conflicting, existing_event_id FROM marked")
def r06(spark, d):
    return timeline.annotated(_drafts(spark, d), _existing(spark, d)).select("record_id", "origin", "field", "idx", "original", "duplicate", "conflicting", "existing_event_id")


@query("R07_commit", ANNOTATED + "SELECT DISTINCT evidence_id, record_id, origin, field, idx, original FROM marked WHERE occurred_at IS NOT NULL AND meaning <> 'document_created' AND NOT (origin = 'artifact' AND field = 'events')")
def r07(spark, d):
    drafts = _drafts(spark, d)
    keyed = drafts.withColumn("proposal_key", timeline.proposal_key(drafts))
    out = timeline.committed(drafts, keyed.where("meaning <> 'document_created'"), keyed.where("origin = 'artifact' and field = 'events'"))
    return out.select("evidence_id", "record_id", "origin", "field", "idx", "original")

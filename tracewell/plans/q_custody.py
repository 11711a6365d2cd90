"""Custody rules. Orders are evidence items, order lines their custody events."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tracewell.domain import table
from tracewell.operators import custody
from tracewell.plans.registry import query

SQL = """WITH ev AS (
  SELECT o_orderkey AS evidence_id, CASE WHEN o_orderstatus <> 'P' THEN sha256(o_orderpriority) END AS sha256,
    CASE WHEN o_orderpriority <> '5-LOW' THEN sha256(CASE WHEN o_totalprice > 300000 THEN o_orderstatus ELSE o_orderpriority END) END AS object_hash, o_orderpriority = '1-URGENT' AS audited
  FROM orders),
ce AS (
  SELECT l_orderkey || '-' || l_linenumber AS event_id, CASE WHEN l_tax > 0 THEN l_orderkey END AS evidence_id, CASE l_returnflag WHEN 'A' THEN 'transferred' WHEN 'R' THEN 'received' ELSE 'collected' END AS event_type,
    l_shipdate AS occurred_at, o_orderdate AS recorded_at, CASE WHEN l_linestatus = 'F' THEN sha256(o_orderpriority) END AS sha256,
    CASE WHEN l_discount > 0 THEN 'desk ' || l_suppkey END AS collector, CASE WHEN l_discount > 0.02 THEN 'desk ' || l_suppkey END AS transferor, CASE WHEN l_quantity > 5 THEN 'desk ' || l_partkey END AS recipient
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ends AS (SELECT evidence_id, min(occurred_at) FILTER (event_type = 'transferred') AS first_transfer, max(occurred_at) FILTER (event_type = 'received') AS last_receipt FROM ce WHERE evidence_id IS NOT NULL GROUP BY 1)
"""
_NONE = "SELECT evidence_id, '' AS event_ids FROM ev WHERE"
_EACH = "SELECT ce.evidence_id, event_id AS event_ids FROM ce"
RULE_SQL = {
    "hash_missing": f"{_NONE} sha256 IS NULL",
    "hash_mismatch": f"{_NONE} object_hash <> sha256",
    "recorded_hash_mismatch": f"{_EACH} JOIN ev USING (evidence_id) WHERE ce.sha256 <> object_hash",
    "source_missing": f"{_NONE} object_hash IS NULL",
    "no_documented_custody": f"{_NONE} NOT audited AND evidence_id NOT IN (SELECT evidence_id FROM ce WHERE evidence_id IS NOT NULL)",
    "missing_required_field": f"{_EACH} WHERE evidence_id IS NOT NULL AND CASE event_type WHEN 'collected' THEN collector IS NULL WHEN 'transferred' THEN transferor IS NULL OR recipient IS NULL ELSE recipient IS NULL END",
    "duplicate_event": "SELECT evidence_id, string_agg(event_id, ',' ORDER BY event_id) AS event_ids FROM ce WHERE evidence_id IS NOT NULL GROUP BY evidence_id, event_type, occurred_at HAVING count(*) > 1",
    "chronology_future": f"{_EACH} WHERE evidence_id IS NOT NULL AND occurred_at > TIMESTAMP '1998-06-01' + INTERVAL 300 SECOND",
    "chronology_recorded_before_occurred": f"{_EACH} WHERE evidence_id IS NOT NULL AND recorded_at + INTERVAL 300 SECOND < occurred_at",
    "chronology_received_before_transfer": f"{_EACH} JOIN ends USING (evidence_id) WHERE event_type = 'received' AND occurred_at < first_transfer",
    "unacknowledged_transfer": f"{_EACH} JOIN ends USING (evidence_id) WHERE event_type = 'transferred' AND (last_receipt IS NULL OR last_receipt < occurred_at)",
    "orphaned_event": f"{_EACH} WHERE evidence_id IS NULL",
}


def custody_tables(spark, d):
    """Evidence and custody events, as the SQL above has them."""
    o = table(spark, d, "orders")
    has = lambda test, value: F.when(test, value)
    sha = F.sha2("o_orderpriority", 256)
    ev = o.select(F.col("o_orderkey").alias("evidence_id"), has(F.col("o_orderstatus") != "P", sha).alias("sha256"), has(F.col("o_orderpriority") != "5-LOW", F.sha2(F.when(F.col("o_totalprice") > 300000, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")), 256)).alias("object_hash"), (F.col("o_orderpriority") == "1-URGENT").alias("audited"))
    rows = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    desk = lambda c: F.concat(F.lit("desk "), F.col(c).cast("string"))
    ce = rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"), has(F.col("l_tax") > 0, F.col("l_orderkey")).alias("evidence_id"),
        F.when(F.col("l_returnflag") == "A", "transferred").when(F.col("l_returnflag") == "R", "received").otherwise("collected").alias("event_type"), F.col("l_shipdate").alias("occurred_at"), F.col("o_orderdate").alias("recorded_at"),
        has(F.col("l_linestatus") == "F", sha).alias("sha256"), has(F.col("l_discount") > 0, desk("l_suppkey")).alias("collector"), has(F.col("l_discount") > 0.02, desk("l_suppkey")).alias("transferor"), has(F.col("l_quantity") > 5, desk("l_partkey")).alias("recipient"),
    )
    return ev, ce


def _issues(spark, d, rules=None):
    out = custody.issues(*custody_tables(spark, d), F.expr("TIMESTAMP_NTZ '1998-06-01'"), F.expr("INTERVAL 300 SECOND"), rules)
    return out.withColumn("event_ids", F.array_join("event_ids", ","))


def _rule(name, spark, d):
    return _issues(spark, d, [name]).select("evidence_id", "event_ids")


for _name in custody.RULES:
    query(f"R10_{_name}", f"{SQL} {RULE_SQL[_name]}")(partial(_rule, _name))


@query("R10_custody", SQL + " UNION ALL ".join(f"SELECT '{n}' AS rule, '{custody.SEVERITY[n]}' AS severity, evidence_id, event_ids FROM ({q})" for n, q in RULE_SQL.items()))
def r10(spark, d):
    return _issues(spark, d)

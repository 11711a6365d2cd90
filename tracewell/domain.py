"""The given tables seen as cases: entities, typed relationships, evidence records and transaction facts.

A case is a region. Customers are persons, suppliers organisations, nations locations. A customer
transfers to each supplier of the same region that an order of theirs names; persons and
organisations are located at their nation. Each order line is an evidence record and a transaction
fact. The SQL strings say the same for DuckDB, as a WITH clause to put before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, case_id, entity_type, display_value, canonical_value, confidence, status."""
    nation = table(spark, sf_dir, "nation")
    home = F.broadcast(nation.select("n_nationkey", F.col("n_regionkey").alias("case_id")))

    def of(name: str, letter: str, key: str, label: str, balance: str, kind: str) -> DataFrame:
        rows = table(spark, sf_dir, name)
        place = f"{letter.lower()}_nationkey"
        bad = F.col(balance) < 0
        return rows.join(home, F.col(place) == F.col("n_nationkey")).select(
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("entity_id"), "case_id", F.lit(kind).alias("entity_type"), F.col(label).alias("display_value"), F.lower(label).alias("canonical_value"),
            F.when(bad, 0.6).otherwise(0.9).alias("confidence"), F.when(bad, "review").otherwise("active").alias("status"),
        )

    places = nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_regionkey").alias("case_id"), F.lit("location").alias("entity_type"), F.col("n_name").alias("display_value"), F.lower("n_name").alias("canonical_value"), F.lit(1.0).alias("confidence"), F.lit("active").alias("status"))
    return of("customer", "C", "c_custkey", "c_name", "c_acctbal", "person").unionByName(of("supplier", "S", "s_suppkey", "s_name", "s_acctbal", "organization")).unionByName(places)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as evidence records and transaction facts, with the ends and cases of both parties."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    party = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("case_id"))
    payee = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("payee_case"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_discount", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(party, F.col("o_custkey") == F.col("c_custkey")).join(payee, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("record_no"), "case_id", "payee_case",
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("party"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("account"), F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.col("o_orderstatus").alias("status"), F.col("l_returnflag").alias("currency"), F.col("l_linestatus").alias("evidence_type"), F.col("l_discount").alias("discount"), F.col("o_orderdate").alias("ordered_at"), F.col("l_shipdate").alias("occurred_at"), F.col("l_partkey").alias("part"),
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, src, dst, rel_type, confidence, created_at, n_records: one row per typed pair."""
    moved = records(spark, sf_dir).where("case_id = payee_case").groupBy("case_id", F.col("party").alias("src"), F.col("account").alias("dst")).agg((1 - F.max("discount")).alias("confidence"), F.min("ordered_at").alias("created_at"), F.count("*").alias("n_records"))
    moved = moved.select("case_id", "src", "dst", F.lit("transferred_to").alias("rel_type"), "confidence", "created_at", "n_records")
    home = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("case_id")))
    placed = None
    for name, letter, key in (("customer", "C", "c_custkey"), ("supplier", "S", "s_suppkey")):
        place = f"{letter.lower()}_nationkey"
        rows = table(spark, sf_dir, name).join(home, F.col(place) == F.col("n_nationkey")).select("case_id", F.concat(F.lit(letter), F.col(key).cast("string")).alias("src"), F.concat(F.lit("N"), F.col(place).cast("string")).alias("dst"), F.lit("located_at").alias("rel_type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(0).cast("long").alias("n_records"))
        placed = rows if placed is None else placed.unionByName(rows)
    return moved.unionByName(placed)


SQL = """
ents AS (
  SELECT 'C' || c_custkey AS entity_id, n_regionkey AS case_id, 'person' AS entity_type, c_name AS display_value, lower(c_name) AS canonical_value,
    CASE WHEN c_acctbal < 0 THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN c_acctbal < 0 THEN 'review' ELSE 'active' END AS status
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'S' || s_suppkey, n_regionkey, 'organization', s_name, lower(s_name), CASE WHEN s_acctbal < 0 THEN 0.6 ELSE 0.9 END::DOUBLE, CASE WHEN s_acctbal < 0 THEN 'review' ELSE 'active' END
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'N' || n_nationkey, n_regionkey, 'location', n_name, lower(n_name), 1.0::DOUBLE, 'active' FROM nation),
recs AS (
  SELECT l_orderkey || '-' || l_linenumber AS record_id, l_orderkey AS file_id, l_linenumber AS record_no, cn.n_regionkey AS case_id, sn.n_regionkey AS payee_case,
    'C' || o_custkey AS party, 'S' || l_suppkey AS account, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, o_orderstatus AS status, l_returnflag AS currency,
    l_linestatus AS evidence_type, l_discount AS discount, o_orderdate AS ordered_at, l_shipdate AS occurred_at, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey),
rels AS (
  SELECT case_id, party AS src, account AS dst, 'transferred_to' AS rel_type, 1 - max(discount) AS confidence, min(ordered_at) AS created_at, count(*) AS n_records
  FROM recs WHERE case_id = payee_case GROUP BY 1, 2, 3
  UNION ALL SELECT n_regionkey, 'C' || c_custkey, 'N' || c_nationkey, 'located_at', 1.0, NULL, 0 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 'S' || s_suppkey, 'N' || s_nationkey, 'located_at', 1.0, NULL, 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ends AS (SELECT case_id, src AS node, dst AS other, rel_type, created_at FROM rels UNION ALL SELECT case_id, dst, src, rel_type, created_at FROM rels)
"""


def with_sql(query: str) -> str:
    """A DuckDB query over ents, recs, rels and ends."""
    rest = query.strip()
    return f"WITH RECURSIVE {SQL}, {rest[4:].strip()}" if rest.upper().startswith("WITH") else f"WITH RECURSIVE {SQL} {rest}"

"""Money queries over order lines as transaction facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.domain import records, table, with_sql
from tracewell.operators import finance
from tracewell.plans.registry import query


def _facts(spark, d):
    return records(spark, d).withColumn("ref", F.when(F.col("record_no") <= 3, F.col("file_id").cast("string")))


FACTS = "facts AS (SELECT *, CASE WHEN record_no <= 3 THEN file_id::VARCHAR END AS ref FROM recs), keyed AS (SELECT *, CASE WHEN ref IS NOT NULL THEN 'txn:' || ref ELSE 'amtacct:' || amount || '|' || account END AS dedupe_key FROM facts)"


@query("A11_R01_coverage", with_sql(f"WITH {FACTS} SELECT case_id, count(*) AS n, count(amount) AS with_amount, count(currency) AS with_currency, count(occurred_at) AS with_occurred_at, count(ref) AS with_ref, count(account) AS with_account, count(party) AS with_party, count(*) - count(amount) AS without_amount, count(*) - count(currency) AS without_currency, count(*) - count(occurred_at) AS without_occurred_at, count(*) - count(ref) AS without_ref FROM facts GROUP BY 1"))
def a11(spark, d):
    return finance.coverage(_facts(spark, d), "case_id")


@query("A12_currency_buckets", with_sql(f"WITH {FACTS}, g AS (SELECT case_id, currency, dedupe_key, count(*) AS n, sum(amount) AS s, min(amount) AS lo, max(amount) AS hi FROM keyed GROUP BY 1, 2, 3) SELECT case_id, currency, sum(n)::BIGINT AS n, count(*) AS groups, count(*) FILTER (lo <> hi) AS conflicting, min(lo) AS least, max(hi) AS most, sum(s)::DECIMAL(38,2) AS total_records, (sum(lo) FILTER (lo = hi))::DECIMAL(38,2) AS total_distinct FROM g GROUP BY 1, 2"))
def a12(spark, d):
    return finance.currency_buckets(_facts(spark, d), "case_id")


@query("A13_conflicting_groups", with_sql(f"WITH {FACTS} SELECT dedupe_key, count(DISTINCT amount) AS amounts FROM keyed GROUP BY 1 HAVING count(DISTINCT amount) > 1"))
def a13(spark, d):
    return finance.with_dedupe_key(_facts(spark, d)).groupBy("dedupe_key").agg(F.count_distinct("amount").alias("amounts")).where("amounts > 1")


@query("A14_dedupe_key", with_sql(f"WITH {FACTS} SELECT record_id, dedupe_key FROM keyed"))
def a14(spark, d):
    return finance.with_dedupe_key(_facts(spark, d)).select("record_id", "dedupe_key")


@query("A15_totals_by_account", with_sql("SELECT account, status, count(*) AS n, sum(amount)::DECIMAL(38,2) AS total FROM recs GROUP BY 1, 2"))
def a15(spark, d):
    return finance.totals(records(spark, d), "account", "status")


@query("A17_duplicate_amount", with_sql("SELECT case_id, amount::VARCHAR AS amount, count(*) AS n FROM recs GROUP BY 1, 2 HAVING count(*) >= 2"))
def a17(spark, d):
    return finance.duplicate_amounts(records(spark, d), "case_id")


@query("A18_amount_threshold", with_sql("SELECT case_id, count(*) AS n, sum(amount)::DECIMAL(38,2) AS total FROM recs WHERE amount >= 5000 GROUP BY 1"))
def a18(spark, d):
    return finance.over_threshold(records(spark, d), "case_id")


@query("A19_missing_parts", with_sql(f"WITH {FACTS} SELECT case_id, count(*) FILTER (ref IS NULL) AS missing_ref FROM facts GROUP BY 1"))
def a19(spark, d):
    return _facts(spark, d).groupBy("case_id").agg(F.count_if(F.col("ref").isNull()).alias("missing_ref"))


@query("A16_A21_not_evaluable", "SELECT c_custkey, 'not_computable_no_direction' AS reason FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def a16(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("not_computable_no_direction").alias("reason"))


@query("A21_rapid_succession", with_sql("SELECT account, min(s) AS start_s, CAST(arg_min(n, s) AS BIGINT) AS n FROM (SELECT account, epoch(occurred_at)::BIGINT AS s, count(*) OVER (PARTITION BY account ORDER BY epoch(occurred_at)::BIGINT RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING) AS n FROM recs) WHERE n >= 4 GROUP BY 1"))
def a21(spark, d):
    return finance.rapid_succession(records(spark, d), 86_400, 4)


@query("A21_repeated_pair", with_sql("SELECT party, account, count(*) AS n, sum(amount)::DECIMAL(38,2) AS total FROM recs GROUP BY 1, 2 HAVING count(*) >= 4"))
def a21b(spark, d):
    return finance.repeated_pairs(records(spark, d), 4)


@query("A21_splitting", with_sql("SELECT party, CAST(occurred_at AS DATE) AS day, count(*) AS n, sum(amount)::DECIMAL(38,2) AS total FROM recs WHERE amount < 50000 GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(amount) >= 50000"))
def a21c(spark, d):
    return finance.splitting(records(spark, d), "50000", 2)


@query("A21_concentration", with_sql("WITH o AS (SELECT case_id, account, count(*) AS n, sum(amount)::DECIMAL(38,2) AS total FROM recs GROUP BY 1, 2) SELECT * FROM (SELECT case_id, account, n, total, round(total::DOUBLE / (sum(total) OVER (PARTITION BY case_id))::DOUBLE, 6) AS share FROM o) WHERE share >= 0.011"))
def a21d(spark, d):
    return finance.concentration(records(spark, d), "case_id", 0.011)


@query("A22_victim_loss", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN CAST(abs(CAST(c_acctbal AS DECIMAL(18,2))) AS VARCHAR) END AS loss, CASE WHEN c_acctbal < 0 THEN [] ELSE ['loss'] END::VARCHAR[] AS missing FROM customer")
def a22(spark, d):
    loss = F.when(F.col("c_acctbal") < 0, F.abs(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(18,2)").cast("string"))
    return table(spark, d, "customer").select("c_custkey", loss.alias("loss"), F.array_compact(F.array(F.when(F.col("c_acctbal") >= 0, "loss"))).alias("missing"))


@query("R02_largest_facts", with_sql("SELECT case_id, record_id, amount, rank FROM (SELECT case_id, record_id, amount, CAST(row_number() OVER (PARTITION BY case_id ORDER BY amount DESC, record_id) AS INT) AS rank FROM recs) WHERE rank <= 10"))
def r02(spark, d):
    return finance.ranked_amounts(records(spark, d), "case_id", 10).select("case_id", "record_id", "amount", "rank")


@query("R08_R09_cross_case", with_sql("WITH k AS (SELECT part, case_id, count(*) AS m FROM recs GROUP BY 1, 2), g AS (SELECT part, count(*) AS cases, sum(m) AS n FROM k GROUP BY 1 HAVING count(*) >= 2) SELECT part, cases, n::BIGINT AS n, (45 + least(15, 3 * (n - cases)))::BIGINT AS score FROM g"))
def r08(spark, d):
    g = records(spark, d).groupBy("part", "case_id").agg(F.count("*").alias("m")).groupBy("part").agg(F.count("*").alias("cases"), F.sum("m").alias("n")).where("cases >= 2")
    return g.select("part", "cases", "n", (45 + F.least(F.lit(15), 3 * (F.col("n") - F.col("cases")))).cast("long").alias("score"))


@query("J15_J16_R03_contradictions", with_sql("SELECT a.file_id, a.record_id AS a, b.record_id AS b, a.currency || '/' || b.currency AS vals FROM recs a JOIN recs b ON a.file_id = b.file_id AND a.part = b.part AND a.record_id < b.record_id AND a.currency <> b.currency"))
def j15(spark, d):
    r = records(spark, d).select("file_id", "part", "record_id", "currency")
    o = r.select("file_id", "part", F.col("record_id").alias("b"), F.col("currency").alias("other"))
    return r.join(o, ["file_id", "part"]).where("record_id < b and currency <> other").select("file_id", F.col("record_id").alias("a"), "b", F.concat_ws("/", "currency", "other").alias("vals"))

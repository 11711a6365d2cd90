"""Streaming queries, each drained to the end of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.domain import table
from tracewell.operators.graph import scratch
from tracewell.plans.registry import query
from tracewell.streaming import stateful, telemetry

NTZ = "timestamp_ntz"


@query("T01_T05_last_seen", "SELECT user_id, max(ts) AS last_seen_at, count(*) AS n FROM events GROUP BY 1")
def t01(spark, d):
    got = telemetry.drained(telemetry.last_seen(telemetry.events(spark, f"{d}/events.parquet"), "user_id"), "complete", spark)
    return got.select("user_id", F.col("last_seen_at").cast(NTZ).alias("last_seen_at"), "n")


@query("T02_rate_limit", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def t02(spark, d):
    got = telemetry.drained(telemetry.rate_windows(telemetry.events(spark, f"{d}/events.parquet"), "user_id", "1 hour", "400 days"), "complete", spark)
    return got.where("n > 1").select("user_id", F.col("start").cast(NTZ).alias("start"), "n")


@query("T03_lockouts", "SELECT user_id, count(*) AS failures, CAST(least(3600, 30 * pow(2, least(count(*) - 1, 10))) AS BIGINT) AS lock_s FROM events WHERE event_type = 'error' GROUP BY 1")
def t03(spark, d):
    rows = telemetry.events(spark, f"{d}/events.parquet").where("event_type = 'error'").select("user_id", "ts")
    got = telemetry.drained(telemetry.lockouts(rows, "user_id", 30, 3600), "update", spark)
    # the last batch of each device has the most failures
    return got.groupBy("user_id").agg(F.max("failures").alias("failures"), F.max("lock_s").alias("lock_s"))


@query("T04_burst_windows", "SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def t04(spark, d):
    got = telemetry.drained(telemetry.rate_windows(telemetry.events(spark, f"{d}/events.parquet"), "user_id", "10 minutes", "400 days"), "complete", spark)
    return got.where("n >= 2").select("user_id", F.col("start").cast(NTZ).alias("start"), "n")


@query("T07_T09_once", "SELECT event_type, min(user_id) AS user_id FROM events GROUP BY 1")
def t07(spark, d):
    rows = telemetry.events(spark, f"{d}/events.parquet").select("ts", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), "event_type", "user_id")
    got = telemetry.drained(telemetry.once(rows, "key", "400 days"), "append", spark)
    return got.groupBy("event_type").agg(F.min("user_id").alias("user_id"))


#: Rows that the watermark has passed when the stream ends: all before the last one, less the delay of an hour.
PASSED = "past AS (SELECT * FROM events WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM events))"
DAY = 86_400


@query("T03_locks_that_end", f"""WITH RECURSIVE two AS (SELECT * FROM events WHERE event_type IN ('error', 'purchase')),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM two WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM two)),
w(user_id, k, event_id, ts, event_type, n, until) AS (
  SELECT user_id, k, event_id, ts, event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, ts + INTERVAL 1 DAY FROM f WHERE k = 1
  UNION ALL SELECT f.user_id, f.k, f.event_id, f.ts, f.event_type, x.n, f.ts + to_days(least(8, (2 ^ (x.n - 1))::INT)) FROM w JOIN f ON f.user_id = w.user_id AND f.k = w.k + 1,
    LATERAL (SELECT CASE WHEN f.event_type = 'purchase' THEN 0 WHEN w.n > 0 AND f.ts < w.until THEN w.n + 1 ELSE 1 END AS n) x)
SELECT user_id, event_id, n::BIGINT AS failures, until FROM w WHERE event_type = 'error'""")
def t03_locks(spark, d):
    """Errors are failures, a purchase is a success; a lock of a day doubles up to eight."""
    rows = telemetry.events(spark, f"{d}/events.parquet").where("event_type in ('error', 'purchase')").withColumn("what", F.when(F.col("event_type") == "purchase", "success").otherwise("failed"))
    got = telemetry.drained(stateful.locks(rows, "user_id", "event_id", "what", DAY, 8 * DAY, "1 hour"), "append", spark)
    return got.select("user_id", F.col("seq").alias("event_id"), "failures", F.col("until").cast(NTZ).alias("until"))


@query("T04_sliding_bursts", f"""WITH {PASSED}, last AS (SELECT max(epoch_us(ts)) - 3600000000 AS mark FROM events),
n AS (SELECT user_id, ts, epoch_us(ts) AS us, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING) AS n FROM past)
SELECT user_id, min(ts) AS start, arg_min(n, ts) AS n FROM n, last WHERE n >= 3 AND us + 86400000000 < (mark // 1000) * 1000 GROUP BY user_id""")
def t04_bursts(spark, d):
    got = telemetry.drained(stateful.bursts(telemetry.events(spark, f"{d}/events.parquet"), "user_id", "event_id", DAY, 3, "1 hour"), "append", spark)
    return got.select("user_id", F.col("start").cast(NTZ).alias("start"), "n")


@query("T09_J09_incremental", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts) AS k, event_type FROM events) WHERE k = 1 AND NOT (event_type = 'error' AND user_id % 3 = 0)")
def t09_incremental(spark, d):
    """First events of each user and type, in one run after the other; errors of every third user have been reviewed."""
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key")
    out, marks, reviewed = scratch(spark), scratch(spark), scratch(spark)
    table(spark, d, "events").where("event_type = 'error' and user_id % 3 = 0").select(key).distinct().write.parquet(reviewed)
    for _ in range(2):  # the second run finds nothing new
        telemetry.incremental(telemetry.events(spark, f"{d}/events.parquet").select(key, "ts", "event_id", "user_id"), "key", reviewed, out, marks)
    return spark.read.parquet(out).select("event_id", "user_id")


CYCLE = {"signup": ("view",), "view": ("click", "error"), "click": ("purchase", "view", "error"), "purchase": ("view",), "error": ("view",)}
LEGAL = ", ".join(f"('{a}', '{b}')" for a, to in CYCLE.items() for b in to)


@query("R23_life_cycles", f"""WITH RECURSIVE {PASSED}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM past),
w(user_id, k, event_id, old, new, legal, now) AS (
  SELECT user_id, k, event_id, 'signup', event_type, x.legal, CASE WHEN x.legal THEN event_type ELSE 'signup' END FROM f, LATERAL (SELECT event_type = 'signup' OR ('signup', event_type) IN ({LEGAL}) AS legal) x WHERE k = 1
  UNION ALL SELECT f.user_id, f.k, f.event_id, w.now, f.event_type, x.legal, CASE WHEN x.legal THEN f.event_type ELSE w.now END FROM w JOIN f ON f.user_id = w.user_id AND f.k = w.k + 1, LATERAL (SELECT f.event_type = w.now OR (w.now, f.event_type) IN ({LEGAL}) AS legal) x)
SELECT user_id, event_id, old, new, legal FROM w""")
def r23_cycles(spark, d):
    got = telemetry.drained(stateful.steps(telemetry.events(spark, f"{d}/events.parquet"), "user_id", "event_id", "event_type", CYCLE, "signup", "1 hour"), "append", spark)
    return got.select("user_id", F.col("seq").alias("event_id"), "old", "new", "legal")

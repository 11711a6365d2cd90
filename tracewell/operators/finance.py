"""Transaction facts, exact money aggregates and patterns. Amounts are decimals throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUM = "decimal(38,2)"


def with_dedupe_key(facts: DataFrame) -> DataFrame:
    """Adds dedupe_key: the reference where there is one, else amount and account."""
    ref = F.when(F.col("ref").isNotNull() & (F.col("ref") != ""), F.concat(F.lit("txn:"), F.col("ref")))
    pair = F.concat(F.lit("amtacct:"), F.col("amount").cast("string"), F.lit("|"), F.coalesce("account", F.lit("")))
    return facts.withColumn("dedupe_key", F.coalesce(ref, pair))


def coverage(facts: DataFrame, by: str) -> DataFrame:
    """Counts of facts with and without each part."""
    have = lambda c: F.count(F.col(c))
    parts = ("amount", "currency", "occurred_at", "ref", "account", "party")
    return facts.groupBy(by).agg(F.count("*").alias("n"), *[have(c).alias(f"with_{c}") for c in parts], *[(F.count("*") - have(c)).alias(f"without_{c}") for c in parts[:4]])


def currency_buckets(facts: DataFrame, by: str) -> DataFrame:
    """Of each currency: count, groups, conflicting groups, min, max, the total of all records, and the total with each
    group once (groups whose amounts disagree are left out; null if all are).
    """
    groups = with_dedupe_key(facts).groupBy(by, "currency", "dedupe_key").agg(F.count("*").alias("n"), F.sum("amount").cast(SUM).alias("s"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    same = F.col("lo") == F.col("hi")
    return groups.groupBy(by, "currency").agg(
        F.sum("n").alias("n"), F.count("*").alias("groups"), F.count_if(~same).alias("conflicting"), F.min("lo").alias("least"), F.max("hi").alias("most"),
        F.sum("s").cast(SUM).alias("total_records"), F.sum(F.when(same, F.col("lo"))).cast(SUM).alias("total_distinct"),
    )


def totals(facts: DataFrame, *by: str) -> DataFrame:
    """Count and exact sum by any columns."""
    return facts.groupBy(*by).agg(F.count("*").alias("n"), F.sum("amount").cast(SUM).alias("total"))


def duplicate_amounts(facts: DataFrame, by: str) -> DataFrame:
    """Amounts, as text, that at least two records share."""
    return facts.groupBy(by, F.col("amount").cast("string").alias("amount")).agg(F.count("*").alias("n")).where("n >= 2")


def over_threshold(facts: DataFrame, by: str, least: str = "5000") -> DataFrame:
    """Count and sum of amounts of at least ``least``."""
    return totals(facts.where(F.col("amount") >= F.lit(least).cast("decimal(38,2)")), by)


def rapid_succession(facts: DataFrame, seconds: int, least: int) -> DataFrame:
    """Accounts with at least ``least`` facts within ``seconds``: the first such time and count (an extension where facts have times)."""
    from tracewell.operators.rules import bursts

    return bursts(facts.select("account", F.unix_seconds(F.col("occurred_at").cast("timestamp")).alias("s")), "account", "s", seconds, least)


def repeated_pairs(facts: DataFrame, least: int) -> DataFrame:
    """Party and account with at least ``least`` facts between them."""
    return totals(facts, "party", "account").where(F.col("n") >= least)


def concentration(facts: DataFrame, by: str, share: float) -> DataFrame:
    """Accounts that take at least ``share`` of a case's total."""
    own = totals(facts, by, "account")
    all_of = own.groupBy(by).agg(F.sum("total").cast(SUM).alias("of"))
    return own.join(all_of, by).select(by, "account", "n", "total", F.round(F.col("total").cast("double") / F.col("of").cast("double"), 6).alias("share")).where(F.col("share") >= share)


def splitting(facts: DataFrame, limit: str, least: int) -> DataFrame:
    """Party and day with at least ``least`` facts below ``limit`` that together reach it."""
    top = F.lit(limit).cast("decimal(38,2)")
    days = totals(facts.where(F.col("amount") < top).withColumn("day", F.to_date("occurred_at")), "party", "day")
    return days.where((F.col("n") >= least) & (F.col("total") >= top))


def ranked_amounts(facts: DataFrame, by: str, limit: int) -> DataFrame:
    """The largest facts of each case."""
    w = Window.partitionBy(by).orderBy(F.desc("amount"), "record_id")
    return facts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)

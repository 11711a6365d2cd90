"""Audit of a report's claims: extraction, citations, arithmetic, order in time, currencies, support and counter-evidence.

claims: draft_id, claim_id, start, end (0-based, end exclusive), category, text; drafts: draft_id, body. One row
per finding, so claims with many findings are no arrays that grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import claims as check

#: What a claim may be about. Fixed values.
CATEGORIES = ("factual", "financial", "timeline", "identity", "relationship", "other")
_MONEY = r"(?i)\b(INR|USD|EUR|GBP)\s*([\d,]+(?:\.\d+)?)"


def invalid_claims(claims: DataFrame, drafts: DataFrame) -> DataFrame:
    """draft_id, claim_id, problems (sorted): span, category, duplicate."""
    first = Window.partitionBy("draft_id", "claim_id").orderBy("start", "text")
    rows = claims.withColumn("again", F.row_number().over(first) > 1).join(drafts, "draft_id", "left")
    holds = F.coalesce(check.span_holds(F.col("body"), F.col("start"), F.col("end"), F.col("text")), F.lit(False))
    problems = F.array_compact(F.array(F.when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "category"), F.when(F.col("again"), "duplicate"), F.when(~holds, "span")))
    return rows.select("draft_id", "claim_id", problems.alias("problems")).where(F.size("problems") > 0)


def chronology(claims: DataFrame) -> DataFrame:
    """draft_id, claim_id of timeline claims that name a day before the last day that an earlier one of the draft names."""
    rows = claims.where("category = 'timeline'").withColumn("days", check.dates(F.col("text"))).where(F.size("days") > 0)
    before = F.max(F.array_max("days")).over(Window.partitionBy("draft_id").orderBy("start", "claim_id").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).where(F.array_min("days") < F.col("before")).select("draft_id", "claim_id")


def currency_conflicts(claims: DataFrame) -> DataFrame:
    """draft_id, claim_id of claims that give an amount in another currency than the draft's first claim with it."""
    found = F.regexp_extract_all("text", F.lit(_MONEY), F.lit(0))
    each = claims.select("draft_id", "claim_id", "start", F.explode(found).alias("m"))
    digits = F.regexp_replace(F.regexp_extract("m", _MONEY, 2), "[^0-9]", "")
    each = each.select("draft_id", "claim_id", "start", F.upper(F.regexp_extract("m", _MONEY, 1)).alias("code"), digits.alias("digits"))
    first = each.groupBy("draft_id", "digits").agg(F.min(F.struct("start", "claim_id", "code")).alias("f"))
    return each.join(first, ["draft_id", "digits"]).where(F.col("code") != F.col("f.code")).select("draft_id", "claim_id").distinct()


def counter_matches(tokens: DataFrame, records: DataFrame, most: int = 3) -> DataFrame:
    """claim, record_id: the first ``most`` records (record_id, word) that hold a token of a claim (claim, word).

    Of each word only its first ``most`` records can be among a claim's, so no word meets more.
    """
    w = Window.partitionBy("word").orderBy("record_id")
    first = records.select("record_id", "word").distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")
    hits = tokens.select("claim", "word").distinct().join(first, "word").select("claim", "record_id").distinct()
    mine = Window.partitionBy("claim").orderBy("record_id")
    return hits.withColumn("k", F.row_number().over(mine)).where(F.col("k") <= most).drop("k")


def findings(claims: DataFrame, drafts: DataFrame, citations: DataFrame, assessments: DataFrame, counter: DataFrame) -> DataFrame:
    """draft_id, claim_id, code, severity: one row a finding.

    citations: draft_id, claim_id, codes (empty where valid). assessments: draft_id, claim_id, verdict, unverified
    (quotes that the excerpt lacks), of claims with a valid citation. counter: draft_id, claim_id of matches.
    """
    of = lambda rows, code: rows.select("draft_id", "claim_id", F.lit(code).alias("code"))
    value = F.array_contains("codes", "citation_value_mismatch")
    checked = F.when(F.size("unverified") > 0, "assessment_unverified").otherwise(F.col("verdict"))
    judged = assessments.select("draft_id", "claim_id", checked.alias("code")).where(F.col("code").isin("contradicted", "partially_supported", "not_established", "assessment_unverified"))
    parts = [
        of(invalid_claims(claims, drafts), "claim_extraction_invalid"), of(citations.where(value), "numeric_mismatch"), of(citations.where(F.size(F.array_remove("codes", "citation_value_mismatch")) > 0), "invalid_citation"),
        of(claims.where(~check.total_holds(F.col("text"))), "numeric_mismatch"), of(chronology(claims), "timeline_discrepancy"), of(currency_conflicts(claims), "currency_mismatch"), judged, of(counter.select("draft_id", "claim_id").distinct(), "counter_evidence_candidate"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    level = F.element_at(F.create_map(*[F.lit(x) for kv in check.SEVERITY.items() for x in kv]), F.col("code"))
    return out.withColumn("severity", level)


def severities(claims: DataFrame, found: DataFrame) -> DataFrame:
    """draft_id, claim_id, findings, severity (the worst, none without findings) of each claim."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in check.SEVERITY_RANK.items() for x in kv]), F.col("severity"))
    top = found.groupBy("draft_id", "claim_id").agg(F.count("*").alias("findings"), F.max_by("severity", rank).alias("severity"))
    rows = claims.select("draft_id", "claim_id").distinct().join(top, ["draft_id", "claim_id"], "left")
    return rows.select("draft_id", "claim_id", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("severity", F.lit("none")).alias("severity"))


def citation_codes(citations: DataFrame, sources: DataFrame, case_id: str = "case_id") -> DataFrame:
    """citation_id, codes (sorted, empty where valid) of ``citations``: citation_id, kind, cited_id, case_id, locator, value, quote.

    sources: kind, source_id, case_id, visible, fields (map), body. Codes: unknown_kind, invalid_id, record_missing, unauthorized,
    wrong_case, locator_invalid (no such field), value_mismatch (the field has another value), quote_unsupported.
    """
    s = sources.select(F.col("kind").alias("kind"), F.col("source_id").alias("cited_id"), F.col("case_id").alias("_case"), "visible", "fields", "body", F.lit(True).alias("_there"))
    kinds = sources.select("kind").distinct().withColumn("_kind", F.lit(True))
    rows = citations.join(s, ["kind", "cited_id"], "left").join(kinds, "kind", "left")
    known, there = F.col("_kind").isNotNull(), F.col("_there").isNotNull()
    shaped = F.coalesce(F.trim("cited_id") != "", F.lit(False))
    field = F.element_at("fields", F.col("locator"))
    code = lambda test, name: F.when(test, name)
    codes = F.array_compact(F.array(
        code(~known, "unknown_kind"), code(known & ~shaped, "invalid_id"), code(known & shaped & ~there, "record_missing"), code(there & ~F.col("visible"), "unauthorized"), code(there & (F.col("_case") != F.col(case_id)), "wrong_case"),
        code(there & F.col("locator").isNotNull() & ~F.coalesce(F.map_contains_key("fields", F.coalesce("locator", F.lit(""))), F.lit(False)), "locator_invalid"), code(there & field.isNotNull() & F.col("value").isNotNull() & (field != F.col("value")), "value_mismatch"),
        code(there & F.col("quote").isNotNull() & ~F.contains("body", F.coalesce("quote", F.lit(""))), "quote_unsupported"),
    ))
    return rows.select("citation_id", F.array_sort(codes).alias("codes"))

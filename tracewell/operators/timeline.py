"""Timeline proposals from date-like fields, their annotation against each other and against the timeline.

fields: record_id, evidence_id, record_no, origin ("record" or "artifact"), field, idx (place of a value
in a list, else null), value. A draft keeps the original value; a time that is not there stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text, values

#: Longest original value and title. Fixed values.
ORIGINAL, TITLE = 200, 200
#: A day inside a statement. Fixed value.
_EMBEDDED = r"(\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{4})"


def _original(value: Column) -> Column:
    return F.substring(F.trim(value), 1, ORIGINAL)


def _draft(rows: DataFrame, title: Column, stamp: Column, meaning: Column) -> DataFrame:
    """Drafts; ``stamp``: the text that holds the time."""
    keys = ["record_id", "evidence_id", "record_no", "origin", "field", "idx"]
    return rows.select(
        *keys, F.substring(title, 1, TITLE).alias("title"), _original(F.col("value")).alias("original"), values.timestamp(stamp).alias("occurred_at"), values.granularity(stamp).alias("granularity"),
        values.zone_assumed(stamp).alias("zone_assumed"), meaning.alias("meaning"), values.timestamp(stamp).isNull().alias("missing"), F.sha2(F.trim("value"), 256).alias("value_sha256"),
    )


def field_drafts(fields: DataFrame) -> DataFrame:
    """Drafts of the date-like fields of records. A value that is no time gives a draft without one where the
    field's name is a strong hint, and none where it is a weak one; empty values give none.
    """
    rows = fields.where(text.is_time_field(F.col("field")) & (F.coalesce(F.trim("value"), F.lit("")) != ""))
    rows = rows.where(text.is_strong_time_field(F.col("field")) | values.timestamp(F.col("value")).isNotNull())
    return _draft(rows, F.concat(F.col("field"), F.lit(": "), _original(F.col("value"))), F.col("value"), text.time_meaning(F.col("field")))


def artifact_drafts(fields: DataFrame, most: int = 10) -> DataFrame:
    """Drafts of extracted artifacts: ``transaction_dates`` as they stand, and the first ``most`` statements of
    ``events``, with the first date that a statement itself names.
    """
    rows = fields.where(F.coalesce(F.trim("value"), F.lit("")) != "")
    dates = rows.where("field = 'transaction_dates'")
    w = Window.partitionBy("record_id").orderBy("idx", "value")
    said = rows.where("field = 'events'").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
    one = _draft(dates, F.concat(F.col("field"), F.lit(": "), _original(F.col("value"))), F.col("value"), F.lit("record_occurs_on"))
    return one.unionByName(_draft(said, F.trim("value"), F.regexp_extract("value", _EMBEDDED, 1), F.lit("statement_refers_to_event")))


def annotated(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds duplicate (not the first draft of its evidence, time and title), conflicting (the artifacts of its record
    name no day that the record's own fields name) and existing_event_id (the least event_id of ``existing``:
    event_id, evidence_id, occurred_at, on the same evidence and day).
    """
    timed = F.col("occurred_at").isNotNull()
    order = ["occurred_at", "record_no", "record_id", "origin", "field", "idx"]
    same = Window.partitionBy("evidence_id", "occurred_at", F.lower(F.regexp_replace(F.trim("title"), r"\s+", " "))).orderBy(*order)
    drafts = drafts.withColumn("duplicate", timed & (F.row_number().over(same) > 1))
    day = F.to_date("occurred_at")
    sides = drafts.where(timed & F.col("record_id").isNotNull()).groupBy("record_id", day.alias("day")).agg(F.bool_or(F.col("origin") == "record").alias("own"), F.bool_or(F.col("origin") == "artifact").alias("other"))
    sides = sides.groupBy("record_id").agg((F.bool_or("own") & F.bool_or("other") & ~F.bool_or(F.col("own") & F.col("other"))).alias("apart"))
    drafts = drafts.join(sides, "record_id", "left").withColumn("conflicting", timed & F.coalesce("apart", F.lit(False))).drop("apart")
    known = existing.groupBy("evidence_id", F.to_date("occurred_at").alias("_day")).agg(F.min("event_id").alias("existing_event_id"))
    return drafts.withColumn("_day", day).join(known, ["evidence_id", "_day"], "left").drop("_day")


def proposal_key(drafts: DataFrame) -> Column:
    """What makes a proposal the same one in a later run: where it comes from and its whole value (the original that is shown is clipped)."""
    parts = [F.coalesce(drafts[c].cast("string"), F.lit("")) for c in ("evidence_id", "record_id", "origin", "field", "idx", "value_sha256")]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def committed(drafts: DataFrame, approved: DataFrame, stored: DataFrame) -> DataFrame:
    """Drafts (with a time) to add to the timeline: ``approved`` by key (proposal_key), and not ``stored`` yet (proposal_key)."""
    rows = drafts.withColumn("proposal_key", proposal_key(drafts)).where("occurred_at is not null").dropDuplicates(["proposal_key"])
    return rows.join(approved.select("proposal_key"), "proposal_key", "left_semi").join(stored.select("proposal_key"), "proposal_key", "left_anti")

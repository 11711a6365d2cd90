"""Custody of evidence: what its events document, leave open or contradict.

evidence: evidence_id, sha256 (recorded, may be null), object_hash (of the stored bytes, null where they
are not there), audited (whether an audit entry names it). events: event_id, evidence_id (null where
the reference is gone), event_type, occurred_at, recorded_at, sha256 (recorded on the event), and the
parties collector, transferor, recipient. Each rule is a filter or one grouping by evidence, so rules
run side by side; its rows are evidence_id and event_ids (sorted).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity of each rule. Fixed values.
SEVERITY = {
    "hash_mismatch": "critical", "recorded_hash_mismatch": "critical", "source_missing": "warning", "hash_missing": "info", "missing_required_field": "warning", "unacknowledged_transfer": "warning",
    "duplicate_event": "warning", "chronology_future": "warning", "chronology_recorded_before_occurred": "warning", "chronology_received_before_transfer": "warning", "orphaned_event": "warning", "no_documented_custody": "info",
}
#: Parties that an event of a type must name. Fixed values.
REQUIRED = {"collected": ("collector",), "transferred": ("transferor", "recipient"), "received": ("recipient",)}


def _hash(c: str) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _of_evidence(rows: DataFrame) -> DataFrame:
    return rows.select("evidence_id", F.array().cast("array<string>").alias("event_ids"))


def _of_events(rows: DataFrame) -> DataFrame:
    return rows.select("evidence_id", F.array("event_id").alias("event_ids"))


def missing_parties(event_type: Column) -> Column:
    """Names of the required parties that an event lacks."""
    absent = [F.when((event_type == kind) & (F.coalesce(F.trim(p), F.lit("")) == ""), p) for kind, parties in REQUIRED.items() for p in parties]
    return F.array_compact(F.array(*absent))


def _hash_missing(evidence, events, checked_at, skew):
    return _of_evidence(evidence.where(_hash("sha256").isNull()))


def _hash_mismatch(evidence, events, checked_at, skew):
    return _of_evidence(evidence.where(_hash("object_hash") != _hash("sha256")))


def _recorded_hash_mismatch(evidence, events, checked_at, skew):
    stored = evidence.select("evidence_id", _hash("object_hash").alias("stored"))
    return _of_events(events.join(stored, "evidence_id").where(_hash("sha256") != F.col("stored")))


def _source_missing(evidence, events, checked_at, skew):
    return _of_evidence(evidence.where("object_hash is null"))


def _no_documented_custody(evidence, events, checked_at, skew):
    return _of_evidence(evidence.where("not audited").join(events.select("evidence_id"), "evidence_id", "left_anti"))


def _missing_required_field(evidence, events, checked_at, skew):
    return _of_events(events.where("evidence_id is not null").where(F.size(missing_parties(F.col("event_type"))) > 0))


def _duplicate_event(evidence, events, checked_at, skew):
    same = events.where("evidence_id is not null").groupBy("evidence_id", "event_type", "occurred_at").agg(F.sort_array(F.collect_list("event_id")).alias("event_ids"))
    return same.where(F.size("event_ids") > 1).select("evidence_id", "event_ids")


def _chronology_future(evidence, events, checked_at, skew):
    return _of_events(events.where("evidence_id is not null").where(F.col("occurred_at") > checked_at + skew))


def _chronology_recorded_before_occurred(evidence, events, checked_at, skew):
    return _of_events(events.where("evidence_id is not null").where(F.col("recorded_at") + skew < F.col("occurred_at")))


def _with_ends(events: DataFrame) -> DataFrame:
    """Events with the first transfer and the last receipt of their evidence."""
    ends = events.groupBy("evidence_id").agg(*[f(F.when(F.col("event_type") == kind, F.col("occurred_at"))).alias(name) for f, kind, name in ((F.min, "transferred", "first_transfer"), (F.max, "received", "last_receipt"))])
    return events.join(ends, "evidence_id")


def _chronology_received_before_transfer(evidence, events, checked_at, skew):
    return _of_events(_with_ends(events).where("event_type = 'received' and occurred_at < first_transfer"))


def _unacknowledged_transfer(evidence, events, checked_at, skew):
    return _of_events(_with_ends(events).where("event_type = 'transferred' and (last_receipt is null or last_receipt < occurred_at)"))


def _orphaned_event(evidence, events, checked_at, skew):
    """A row for each event, so that no list of them grows with the case."""
    return _of_events(events.where("evidence_id is null"))


RULES: dict[str, Callable[..., DataFrame]] = {
    "hash_missing": _hash_missing, "hash_mismatch": _hash_mismatch, "recorded_hash_mismatch": _recorded_hash_mismatch, "source_missing": _source_missing, "no_documented_custody": _no_documented_custody,
    "missing_required_field": _missing_required_field, "duplicate_event": _duplicate_event, "chronology_future": _chronology_future, "chronology_recorded_before_occurred": _chronology_recorded_before_occurred,
    "chronology_received_before_transfer": _chronology_received_before_transfer, "unacknowledged_transfer": _unacknowledged_transfer, "orphaned_event": _orphaned_event,
}


def issues(evidence: DataFrame, events: DataFrame, checked_at: Column, skew: Column, rules: list[str] | None = None) -> DataFrame:
    """rule, severity, evidence_id, event_ids of all ``rules``. checked_at: the time of the check; skew: the interval by which clocks may differ."""
    out = None
    for name in rules or RULES:
        found = RULES[name](evidence, events, checked_at, skew).select(F.lit(name).alias("rule"), F.lit(SEVERITY[name]).alias("severity"), "evidence_id", "event_ids")
        out = found if out is None else out.unionByName(found)
    return out

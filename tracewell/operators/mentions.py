"""Mentions of entities in the fields and free texts of records, with their places.

Five recognisers run over a text at once, in Arrow batches (Spark's own regular expression functions give no
places): phone, vehicle, grouped document number, labelled account, labelled document. What they find is
normalised by column expressions, so a value that is not valid is no mention. No step needs a shuffle but the two
that compare mentions of a record: ``settled`` and ``first_mentions``.

Defined results: a null text has no mentions; places count code points, the end is exclusive, and are null for
mentions from fields; of a labelled value the place is that of label and value together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tracewell.functions import text
from tracewell.sources import intake

#: Recognisers: name, entity type, pattern, group of the value. Fixed values, in the order in which they are tried.
_END = r"(?=\s+[A-Za-z]{2,}\b|\s*$|\.\s|\Z)"
RECOGNISERS = (
    ("phone", "phone", r"\+?\d[\d\s().-]{6,}\d", 0),
    ("vehicle", "vehicle", r"(?<![A-Za-z0-9])[A-Z]{2}[\d]{1,2}[A-Z]{1,2}[\d]{1,4}(?![A-Za-z0-9])", 0),
    ("grouped_document", "document", r"\b(?:\d{4}[ -]\d{4}[ -]\d{4}|\d{4}\s\d{4}\s\d{4})\b", 0),
    ("labelled_account", "account", r"(?i)\b(?:account\s*(?:no\.?|number)?|a/c)\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9 .-]{4,28}?)" + _END, 1),
    ("labelled_document", "document", r"(?i)\b(?:passport|pan no\.?|pancard|document no\.?|id(?:entification)? number|dl no\.?)\s*[:#]?\s*([A-Z0-9][A-Z0-9 .-]{4,28}?)" + _END, 1),
)
#: What keeps its place where mentions overlap: a lower number. Labels say most, a phone's pattern least.
PRECEDENCE = {"labelled_account": 0, "labelled_document": 0, "grouped_document": 1, "vehicle": 2, "phone": 3}
#: Separators of several values in one field. Fixed value.
PACKED = r"[\s,;|]+"
#: Texts that a Python worker gets at once.
_ROWS = 500
_COMPILED = [(name, kind, re.compile(p), g) for name, kind, p, g in RECOGNISERS]
_GROUPED = re.compile(RECOGNISERS[2][2])


def _no_phone(raw: str) -> bool:
    """Twelve digits or more without a plus sign that stand unbroken or in fours: accounts or documents."""
    return sum(map(str.isdigit, raw)) >= 12 and not raw.lstrip().startswith("+") and (raw.isdigit() or _GROUPED.fullmatch(raw) is not None)


def found_in(body: str) -> Iterator[tuple[str, str, str, int, int]]:
    """recogniser, entity type, raw value, start, end of what the patterns find in a text."""
    for name, kind, pattern, group in _COMPILED:
        for m in pattern.finditer(body):
            if name != "phone" or not _no_phone(m[0]):
                yield name, kind, m[group], m.start(), m.end()


def recognised(texts: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """keys, recogniser, entity_type, raw, canonical, start, stop: the valid mentions in the column ``body``."""
    rows = texts.select(*[texts[k].alias(f"k{i}") for i, k in enumerate(keys)], texts[body].cast("string").alias("body"))
    fields = [StructField(c, StringType()) for c in ("recogniser", "entity_type", "raw")] + [StructField(c, IntegerType()) for c in ("start", "stop")]
    schema = StructType([*rows.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                hits = [(i, *hit) for i, t in enumerate(part["body"].to_pylist()) if t for hit in found_in(t)]
                own = part.take(pa.array([h[0] for h in hits], pa.int64()))
                new = [pa.array([h[k] for h in hits], pa.string() if k < 4 else pa.int32()) for k in range(1, 6)]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *new], names=[f.name for f in schema.fields])

    out = rows.mapInArrow(run, schema).withColumn("canonical", text.normalized(F.col("entity_type"), F.col("raw"))).where("canonical is not null")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "recogniser", "entity_type", "raw", "canonical", "start", "stop")


def settled(found: DataFrame, keys: list[str]) -> DataFrame:
    """Those of ``found`` (as ``recognised`` gives them) that no mention of lower PRECEDENCE number overlaps.

    One sort of the mentions of a text by place: a mention is overlapped if the furthest end of the better ones that
    begin before it, or with it, lies beyond its start, or one of them begins before its end.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]), F.col("recogniser"))
    rows, bad = found.withColumn("_rank", rank), F.lit(False)
    upto = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy(*keys).orderBy("start").rangeBetween(1, Window.unboundedFollowing)
    for r in sorted(set(PRECEDENCE.values()))[1:]:
        better = F.col("_rank") < r
        ends, starts = F.max(F.when(better, F.col("stop"))).over(upto), F.min(F.when(better, F.col("start"))).over(onward)
        hit = F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("stop"), F.lit(False))
        bad = bad | ((F.col("_rank") == r) & hit)
    return rows.withColumn("_bad", bad).where("not _bad").drop("_rank", "_bad")


def field_mentions(records: DataFrame, raw: Column, keys: list[str]) -> DataFrame:
    """keys, header, entity_type, raw, canonical: fields of the map ``raw`` whose header names an entity type.

    A value that is not valid as a whole may hold several: its parts at PACKED are tried one by one.
    """
    # each step is the outer form of explode, so that what it makes is not made again by the filters after it
    each = records.select(*keys, F.explode_outer(F.map_entries(raw)).alias("_e"))
    named = F.array(F.struct(F.col("_e.key").alias("header"), intake.header_type(F.col("_e.key")).alias("entity_type"), F.trim("_e.value").alias("raw")))
    each = each.select(*keys, F.explode_outer(named).alias("_e")).select(*keys, "_e.*").where("entity_type is not null and raw <> ''")
    one = lambda value, canonical: F.struct(value.alias("raw"), canonical.alias("canonical"))
    kind = F.col("entity_type")
    whole = text.once(text.normalized(kind, F.col("raw")), lambda c: F.when(c.isNotNull(), F.array(one(F.col("raw"), c))).otherwise(F.transform(F.split("raw", PACKED), lambda p: one(p, text.normalized(kind, p)))))
    each = each.select(*keys, "header", "entity_type", F.explode_outer(whole).alias("_e")).select(*keys, "header", "entity_type", "_e.*")
    return each.where("canonical is not null")


def first_mentions(fields: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entity_type, canonical, source, raw, start, stop, blocking_key: one row for each value that a record mentions, from
    a field where one has it, else from the text (the first recogniser and place).
    """
    order = F.create_map(*[x for i, (name, *_) in enumerate(RECOGNISERS) for x in (F.lit(name), F.lit(i))])
    none = F.lit(None).cast("int")
    one = fields.select(*keys, "entity_type", "canonical", F.struct(F.lit(-1).alias("o"), none.alias("start"), none.alias("stop"), "raw").alias("x"))
    two = rules.select(*keys, "entity_type", "canonical", F.struct(F.element_at(order, F.col("recogniser")).alias("o"), "start", "stop", "raw").alias("x"))
    best = one.unionByName(two).groupBy(*keys, "entity_type", "canonical").agg(F.min("x").alias("x"))
    return best.select(*keys, "entity_type", "canonical", F.when(F.col("x.o") < 0, "field").otherwise("rule").alias("source"), "x.raw", "x.start", "x.stop", text.blocking_key(F.col("entity_type"), F.col("canonical")).alias("blocking_key"))


def record_mentions(records: DataFrame, raw: Column, keys: list[str]) -> DataFrame:
    """``first_mentions`` of records: of their fields, and of the text of all fields that name no entity type."""
    bodies = records.select(*keys, intake.record_text(raw).alias("_body"))
    return first_mentions(field_mentions(records, raw, keys), recognised(bodies, "_body", keys), keys)

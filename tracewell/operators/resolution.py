"""Resolution of mentions and entities: candidate pairs, identifier signals, aliases, co-occurrence, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators.matching import AUTO, PAIRS, REVIEW, indel_ratio

#: Entity types whose values identify. Fixed values.
IDENTIFIERS = ("phone", "account", "vehicle", "document")


def blocked_pairs(entities: DataFrame, most: int) -> DataFrame:
    """entity_type, block, a, b: of the pairs of each block, in the order of ids, the first ``most``.

    The i-th of n members starts at pair (i-1)(n-1) - (i-1)(i-2)/2, so only the few members that still have pairs
    within the bound are joined, each with a bounded run of those after it; a block is never squared.
    """
    e = entities.select("entity_id", "entity_type", text.blocking_key(F.col("entity_type"), F.col("canonical_value")).alias("block"))
    key = ["entity_type", "block"]
    rows = e.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("entity_id")).cast("long"))
    n = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    before = (F.col("i") - 1) * (F.col("n") - 1) - (F.col("i") - 1) * (F.col("i") - 2) / 2
    left = rows.join(n, key).withColumn("before", before.cast("long")).where(F.col("before") < most)
    left = left.withColumn("last", F.least(F.col("n"), F.col("i") + most - F.col("before"))).where("i < last")
    left = left.select(*key, F.col("entity_id").alias("a"), F.explode(F.sequence(F.col("i") + 1, F.col("last"))).alias("i"))
    return left.join(rows.select(*key, "i", F.col("entity_id").alias("b")), [*key, "i"]).select(*key, "a", "b")


def exact_alias_pairs(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """a, b, value: entities of a type that share a normalised canonical value or alias, each linked to the first one.

    aliases: entity_id, alias. Groups are stars, not squares; they connect what all pairs would.
    """
    own = entities.select("entity_id", "entity_type", F.col("canonical_value").alias("raw"))
    named = aliases.join(entities.select("entity_id", "entity_type"), "entity_id").select("entity_id", "entity_type", F.col("alias").alias("raw"))
    values = own.unionByName(named).select("entity_id", "entity_type", text.normalized(F.col("entity_type"), F.col("raw")).alias("value")).where("value is not null").distinct()
    first = values.groupBy("entity_type", "value").agg(F.min("entity_id").alias("a"))
    return values.join(first, ["entity_type", "value"]).where("entity_id <> a").groupBy("a", F.col("entity_id").alias("b")).agg(F.min("value").alias("value"))


def identifier_signals(signals: DataFrame, identifiers: DataFrame) -> DataFrame:
    """entity_id, identifier: signals (entity_id, signal) that normalise, as the first of IDENTIFIERS that does, to a known identifier
    (entity_type, canonical_value).
    """
    each = signals.select("entity_id", F.posexplode(F.array(*[text.normalized(F.lit(t), F.col("signal")) for t in IDENTIFIERS])).alias("k", "value"), "signal").where("value is not null")
    known = identifiers.where(F.col("entity_type").isin(*IDENTIFIERS)).select(F.col("canonical_value").alias("value")).distinct()
    found = each.join(known, "value", "left_semi")
    return found.groupBy("entity_id", "signal").agg(F.min_by("value", "k").alias("identifier")).select("entity_id", "identifier").distinct()


def pair_proposals(entities: DataFrame, aliases: DataFrame, signals: DataFrame, most: int = 200, review: float = REVIEW, auto: float = AUTO) -> DataFrame:
    """a, b, method, score, band of entities that may be one.

    exact_alias for a shared value (score 100); else the names' likeness, from ``review`` on: exact_identifier where
    both have a known identifier in common, name_similarity unless their identifiers are disjoint.
    """
    exact = exact_alias_pairs(entities, aliases).select("a", "b", F.lit("exact_alias").alias("method"), F.lit(100.0).alias("score"))
    e = entities.select("entity_id", "canonical_value")
    pairs = blocked_pairs(entities, most).select("a", "b").join(exact.select("a", "b"), ["a", "b"], "left_anti")
    pairs = pairs.join(e.toDF("a", "va"), "a").join(e.toDF("b", "vb"), "b")
    bound = 200 * F.least(F.length("va"), F.length("vb")) / (F.length("va") + F.length("vb"))
    pairs = pairs.where((bound >= review) & (F.col("va") != F.col("vb"))).withColumn("score", F.round(indel_ratio(F.col("va"), F.col("vb")), 2)).where(F.col("score") >= review)
    known = identifier_signals(signals, entities).groupBy("entity_id").agg(F.collect_set("identifier").alias("ids"))
    none = F.array().cast("array<string>")
    for x in "ab":
        pairs = pairs.join(known.toDF(x, f"i{x}"), x, "left").withColumn(f"i{x}", F.coalesce(f"i{x}", none))
    common = F.arrays_overlap("ia", "ib")
    apart = (F.size("ia") > 0) & (F.size("ib") > 0) & ~common
    near = pairs.where(~apart).select("a", "b", F.when(common, "exact_identifier").otherwise("name_similarity").alias("method"), "score")
    return exact.unionByName(near).withColumn("band", F.when(F.col("score") >= auto, "strong").otherwise("ambiguous"))


def resolved(mentions: DataFrame, entities: DataFrame, most: int = 25, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """mention_id, entity_id, decision, score: auto or review with the best entity of the block, else new.

    mentions: mention_id, entity_type, canonical_value, context (array of words). entities: entity_id, entity_type,
    canonical_value, status, context. An equal value scores 100, others 0.85 of the names' likeness and 0.15 of
    the contexts'. Mentions with equal values meet the ``most`` first active entities of their block once.
    """
    block = text.blocking_key(F.col("entity_type"), F.col("canonical_value")).alias("block")
    key = ["entity_type", "block"]
    e = entities.where("status = 'active'").select("entity_id", "entity_type", block, F.col("canonical_value").alias("v"), F.col("context").alias("c"))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("entity_id"))).where(F.col("k") <= most).drop("k")
    same = entities.where("status = 'active'").groupBy("entity_type", "canonical_value").agg(F.min("entity_id").alias("exact"))
    m = mentions.join(same, ["entity_type", "canonical_value"], "left")
    rest = m.where("exact is null").select("mention_id", "entity_type", block, "canonical_value", "context").join(e, key)
    score = F.round(0.85 * indel_ratio(F.col("canonical_value"), F.col("v")) + 0.15 * text.jaccard(F.col("context"), F.col("c")), 2)
    best = rest.withColumn("score", score).groupBy("mention_id").agg(F.max(F.struct("score", F.col("entity_id"))).alias("x"))
    rows = m.join(best, "mention_id", "left")
    value = F.when(F.col("exact").isNotNull(), 100.0).otherwise(F.col("x.score"))
    decision = F.when(value >= auto, "auto").when(value >= review, "review").otherwise("new")
    return rows.select("mention_id", F.when(value >= review, F.coalesce("exact", F.col("x.entity_id"))).alias("entity_id"), decision.alias("decision"), value.alias("score"))


def approved_aliases(matches: DataFrame, aliases: DataFrame) -> DataFrame:
    """entity_id, alias to add for approved ``matches`` (a, va, b, vb): each gets the other's value, if it lacks it."""
    new = matches.select(F.col("a").alias("entity_id"), F.col("vb").alias("alias")).union(matches.select("b", "va")).where("alias is not null").distinct()
    return new.join(aliases.select("entity_id", "alias"), ["entity_id", "alias"], "left_anti")


def co_occurrence(mentions: DataFrame, windows: DataFrame, most: int = 15) -> DataFrame:
    """record_id, src, dst, rel_type from pairs of mentions (record_id, kind, id, start, end) within a sentence window
    (record_id, start, end) whose kinds have a rule. The earlier one is the source; pairs of one kind go from the
    lesser id to the greater. A window's pair counts once, and a record gives ``most``.
    """
    rules = {**{(a, b): r for a, b, r in PAIRS}, **{(b, a): r for a, b, r in PAIRS}, ("person", "person"): "associated_with"}
    table = F.create_map(*[x for (a, b), r in sorted(rules.items()) for x in (F.lit(f"{a}>{b}"), F.lit(r))])
    w = windows.select("record_id", F.col("start").alias("ws"), F.col("end").alias("we"))
    at = mentions.join(w, "record_id").where("start >= ws and end <= we").select("record_id", "ws", "kind", "id", "start").distinct()
    # a window's first mentions make all the pairs that a record can give
    order = Window.partitionBy("record_id", "ws").orderBy("start", "kind", "id")
    at = at.withColumn("i", F.row_number().over(order))
    a = at.select("record_id", "ws", *[F.col(c).alias(f"{c}1") for c in ("kind", "id", "i")])
    b = at.select("record_id", "ws", *[F.col(c).alias(f"{c}2") for c in ("kind", "id", "i")])
    rows = a.join(b, ["record_id", "ws"]).where("i1 < i2 and not (kind1 = kind2 and id1 = id2)").withColumn("rel_type", F.element_at(table, F.concat("kind1", F.lit(">"), "kind2"))).where("rel_type is not null")
    swap = (F.col("kind1") == F.col("kind2")) & (F.col("id1") > F.col("id2"))
    rows = rows.select("record_id", "ws", "i1", "i2", F.when(swap, F.col("id2")).otherwise(F.col("id1")).alias("src"), F.when(swap, F.col("id1")).otherwise(F.col("id2")).alias("dst"), "rel_type")
    once = rows.groupBy("record_id", "ws", "src", "dst", "rel_type").agg(F.min(F.struct("i1", "i2")).alias("o"))
    k = F.row_number().over(Window.partitionBy("record_id").orderBy("ws", "o", "src", "dst"))
    return once.withColumn("k", k).where(F.col("k") <= most).select("record_id", "src", "dst", "rel_type")


def provenance(entities: DataFrame, ends: DataFrame, evidence: DataFrame, records: DataFrame) -> DataFrame:
    """entity_id, kind, id: everything that an entity rests on: relationships (rel_id) at either end, their records, and the files of these.

    ends: rel_id, entity_id. evidence: rel_id, record_id. records: record_id, file_id.
    """
    rels = entities.select("entity_id").join(ends, "entity_id").select("entity_id", "rel_id").distinct()
    recs = rels.join(evidence, "rel_id").select("entity_id", "record_id").distinct()
    files = recs.join(records, "record_id").select("entity_id", "file_id").distinct()
    of = lambda df, kind, c: df.select("entity_id", F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
    return of(rels, "relationship", "rel_id").union(of(recs, "record", "record_id")).union(of(files, "file", "file_id"))


def reviewed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """match_id, status, signals of ``candidates`` (match_id, status, signals) after review.

    decisions: match_id, verdict (accepted or rejected), decided_at, signals. Only pending candidates change, by their
    first decision; an accepted one has the signals of both.
    """
    rank = Window.partitionBy("match_id").orderBy("decided_at", "verdict")
    first = decisions.where(F.col("verdict").isin("accepted", "rejected")).withColumn("k", F.row_number().over(rank)).where("k = 1").select("match_id", "verdict", F.col("signals").alias("more"))
    rows = candidates.join(first, "match_id", "left")
    change = (F.col("status") == "pending") & F.col("verdict").isNotNull()
    both = F.array_sort(F.array_distinct(F.concat("signals", F.coalesce("more", F.array().cast("array<string>")))))
    return rows.select("match_id", F.when(change, F.col("verdict")).otherwise(F.col("status")).alias("status"), F.when(change & (F.col("verdict") == "accepted"), both).otherwise(F.array_sort("signals")).alias("signals"))


def ingestion_summary(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """case_id, kind, name, n: entities and relationships of each case by type, and their totals (name: total)."""
    of = lambda df, kind, c: df.groupBy("case_id", F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    rows = of(entities, "entity", "entity_type").union(of(rels, "relationship", "rel_type"))
    return rows.union(rows.groupBy("case_id", "kind").agg(F.sum("n").alias("n")).select("case_id", "kind", F.lit("total").alias("name"), "n"))

"""Indicators that several cases share, and candidate links between cases.

indicators: case_id, kind, value (normalised), original, entity_id, record_id, file_id (what carries it,
may be null), reviewed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.graph import cut

#: Kinds that identify, by priority, and the base score of each classification. Fixed values.
IDENTIFIERS = ("phone", "email", "account", "vehicle", "document", "transaction", "device", "url", "domain", "file_hash")
CARRIERS = ("entity_id", "record_id", "file_id")
#: Pairs of a group's value and a carrier's that a block makes, those of them that are held at once, and values that are dealt at once
#: (each pair taken as one). Fixed values.
BLOCK, HELD, SENT = 64_000_000, 4_000_000, 1_000_000_000
#: Support beyond the cases from which on a score no longer grows.
ENOUGH = 5
BASE = {"reviewed_alias": 60, "exact_identifier": 55, "normalized_identifier": 45, "similarity_name_only": 15}


def shared(indicators: DataFrame) -> DataFrame:
    """kind, value, cases (how many hold it) of values that more than one case holds."""
    return indicators.groupBy("kind", "value").agg(F.count_distinct("case_id").alias("cases")).where("cases > 1")


def contributing(indicators: DataFrame, groups: DataFrame) -> DataFrame:
    """kind, value (of the group), case_id, other_kind, other_value, record_id, file_id: all indicators of a case that an
    entity, record or file carries which also carries the group's value there; those themselves included.

    Carriers are taken once a group, and a carrier's indicators once, before they meet.
    """
    held = indicators.join(groups.select("kind", "value"), ["kind", "value"], "left_semi")
    all_, own = None, None
    for carrier in CARRIERS:
        at = held.where(F.col(carrier).isNotNull()).select("kind", "value", "case_id", F.lit(carrier).alias("by"), F.col(carrier).cast("string").alias("carrier")).distinct()
        has = indicators.where(F.col(carrier).isNotNull()).select("case_id", F.lit(carrier).alias("by"), F.col(carrier).cast("string").alias("carrier"), F.col("kind").alias("other_kind"), F.col("value").alias("other_value"), "record_id", "file_id").distinct()
        own, all_ = (at, has) if own is None else (own.unionByName(at), all_.unionByName(has))
    found = own.join(all_, ["case_id", "by", "carrier"]).drop("by", "carrier")
    mine = held.select("case_id", "kind", "value", F.col("kind").alias("other_kind"), F.col("value").alias("other_value"), "record_id", "file_id")
    return found.unionByName(mine).distinct()


def contributing_kinds(indicators: DataFrame, wanted: Column) -> DataFrame:
    """kind, value, case_id, other_kind, n: how many values of each kind ``contributing`` has for the shared values whose kind is ``wanted``."""
    return met_kinds(indicators, wanted).where("case_id is not null")


def met_kinds(indicators: DataFrame, wanted: Column) -> DataFrame:
    """``contributing_kinds``, and with a null case_id the most cases of a group in which one value of a kind is met.

    A value is a number, and a carrier of a case one row with its values, which goes once to each block of groups that has one of them;
    a block makes the pairs of its groups one run of groups after another, so pairs are neither shuffled nor written. Blocks are dealt
    some at a time, so that about ``SENT`` values at most are on the disk at once. Records that lie in one file each bring
    nothing that their files don't, and are left out if all do.
    """
    rows = cut(indicators.select("case_id", "kind", "value", *[F.col(c).cast("string").alias(c) for c in CARRIERS]))
    numbered = lambda c, n: rows.select(c).distinct().withColumn(n, F.row_number().over(Window.orderBy(c)).cast("long") - 1)
    kinds, cases = cut(numbered("kind", "k")), cut(numbered("case_id", "c").where("case_id is not null"))
    many = kinds.count()
    if not many:
        return rows.select("kind", "value", "case_id", F.col("kind").alias("other_kind"), F.lit(0).cast("long").alias("n"))
    named = rows.select("kind", "value").distinct().join(F.broadcast(kinds), "kind").join(shared(rows).where(wanted).select("kind", "value", F.lit(True).alias("held")), ["kind", "value"], "left")
    named = cut(named.withColumn("code", F.monotonically_increasing_id() * many + F.col("k")).select("kind", "value", F.coalesce("held", F.lit(False)).alias("held"), "code"))
    coded = cut(rows.join(named, ["kind", "value"]).join(cases, "case_id").select("c", "code", "held", *CARRIERS))
    files = coded.where("record_id is not null").groupBy("c", "record_id").agg(F.min("file_id").alias("a"), F.max("file_id").alias("b"), F.count_if(F.col("file_id").isNull()).alias("n"))
    loose = cut(files.where("n > 0 or a <> b").limit(1)).count()
    own = F.array("code")
    lists = cut(coded.where("held").select("c", "code").distinct().select("c", own.alias("gs"), own.alias("vs")))
    for carrier in CARRIERS:
        if loose or carrier != "record_id":
            each = coded.where(F.col(carrier).isNotNull()).groupBy("c", carrier).agg(F.collect_set(F.when(F.col("held"), F.col("code"))).alias("gs"), F.collect_set("code").alias("vs"))
            lists = lists.unionByName(cut(each.where(F.size("gs") > 0).drop(carrier)))
    pairs = lists.agg(F.sum(F.size("gs").cast("long") * F.size("vs"))).first()[0] or 0
    blocks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // BLOCK + 1)
    turns = min(blocks, pairs // SENT + 1)

    def counted(block: pa.Table) -> pa.Table:
        code, c, k, n = _kinds_of(*_flat(block.column("gs")), *_flat(block.column("vs")), block.column("c").to_numpy(), many)
        return pa.table({"code": code, "c": c, "k": k, "n": n})

    found = None
    for turn in range(turns):
        hashed = F.filter(F.transform("gs", lambda g: F.struct(F.pmod(F.xxhash64(g), F.lit(blocks)).alias("block"), g.alias("g"))), lambda x: x["block"] % turns == turn)
        dealt = lists.withColumn("gs", hashed).withColumn("block", F.explode(F.array_distinct(F.transform("gs", lambda x: x["block"]))))
        dealt = dealt.select("block", "c", F.transform(F.filter("gs", lambda x: x["block"] == F.col("block")), lambda x: x["g"]).alias("gs"), "vs")
        part = cut(dealt.repartition(-(-blocks // turns), "block").groupBy("block").applyInArrow(counted, "code long, c long, k long, n long"))
        found = part if found is None else found.unionByName(part)
    rows = found.join(named, "code").join(F.broadcast(kinds.withColumnRenamed("kind", "other_kind")), "k").join(cases, "c", "left")
    return rows.select("kind", "value", "case_id", "other_kind", "n")


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of ``lists`` and all their items."""
    parts = lists.chunks
    return np.concatenate([np.diff(p.offsets.to_numpy()) for p in parts]), np.concatenate([p.flatten().to_numpy() for p in parts])


def _kinds_of(n_of: np.ndarray, groups: np.ndarray, v_of: np.ndarray, values: np.ndarray, case: np.ndarray, many: int) -> tuple[np.ndarray, ...]:
    """Code of a group, case, kind, number of its distinct values of that kind there, over carriers that have a case, ``n_of`` groups and ``v_of``
    values each; and with case -1 the most cases in which the group has one and the same value of that kind."""
    start = np.cumsum(v_of) - v_of
    cases, case = np.unique(case, return_inverse=True)
    codes, values = np.unique(values, return_inverse=True)
    # a value in a case is one number; of a value they follow each other
    values = values * len(cases) + np.repeat(case, v_of)
    order = np.argsort(groups, kind="stable")
    carrier = np.repeat(np.arange(len(n_of)), n_of)[order]
    names, groups = np.unique(groups[order], return_inverse=True)
    kind, size = codes % many, len(codes) * len(cases)
    first = np.searchsorted(groups, np.arange(len(names) + 1))
    made = np.concatenate([[0], np.cumsum(v_of[carrier])])
    out, g = [], 0
    while g < len(names):
        to = max(g + 1, int(np.searchsorted(made[first], made[first[g]] + HELD, side="right")) - 1)
        seen = np.empty(0, dtype=np.int64)
        a = first[g]
        while a < first[to]:  # one run, but for a group that is larger alone
            b = min(first[to], max(a + 1, int(np.searchsorted(made, made[a] + HELD, side="right")) - 1))
            n = v_of[carrier[a:b]]
            at = np.arange(made[b] - made[a]) + np.repeat(start[carrier[a:b]] - (made[a:b] - made[a]), n)
            pairs = np.unique(np.repeat(groups[a:b], n) * size + values[at])
            seen, a = pairs if not len(seen) else np.union1d(seen, pairs), b
        of, k = seen // size, kind[seen % size // len(cases)]
        each, n = np.unique((of * len(cases) + seen % len(cases)) * many + k, return_counts=True)
        out.append((names[each // many // len(cases)], cases[each // many % len(cases)], each % many, n))
        met, n = np.unique(seen // len(cases), return_counts=True)
        key = met // len(codes) * many + kind[met % len(codes)]
        order = np.argsort(key, kind="stable")
        each, at = np.unique(key[order], return_index=True)
        out.append((names[each // many], np.full(len(each), -1), each % many, np.maximum.reduceat(n[order], at)))
        g = to
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))


def _support(indicators: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """kind, value, support of ``groups``: records and files of what ``contributing`` has, at most ``most`` of each in a case; where it is
    over ``ENOUGH`` beyond the cases, which no score tells apart, some number that is so as well.

    The group's own records and files, counted by hashes into 64 numbers, are never more than there are; only groups for which
    they are too few are looked at in full.
    """
    key, mark = ["kind", "value"], lambda c: F.bit_count(F.bit_or(F.when(F.col(c).isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int")))))
    capped = lambda r, f: F.least(F.coalesce(r, F.lit(0)), F.lit(most)) + F.least(F.coalesce(f, F.lit(0)), F.lit(most))
    own = indicators.groupBy(*key, "case_id").agg(capped(mark("record_id"), mark("file_id")).cast("long").alias("s")).groupBy(*key).agg(F.sum("s").alias("support"))
    own = cut(groups.join(own, key))
    enough = F.col("support") >= F.col("cases") + ENOUGH
    found = contributing(indicators, own.where(~enough))
    each = found.groupBy(*key, "case_id").agg(capped(F.count_distinct("record_id"), F.count_distinct("file_id")).alias("s"))
    return own.where(enough).select(*key, "support").unionByName(each.groupBy(*key).agg(F.sum("s").alias("support")))


def candidates(indicators: DataFrame, most: int = 50) -> DataFrame:
    """kind, value, cases, classification, extra_kinds, conflict_kinds, score, reviewable of each shared value.

    A further kind is shared if one of its values is there in every case of the group, and in conflict if every
    case has values of it but none in common. At most ``most`` records and files of a case count as support.
    """
    indicators = cut(indicators)
    groups, key = cut(shared(indicators)), ["kind", "value"]
    others = met_kinds(indicators, F.lit(True)).where(F.col("other_kind").isin(*IDENTIFIERS) & (F.col("other_kind") != F.col("kind"))).join(groups, key)
    whole = others.groupBy(*key, "cases", "other_kind").agg(F.count("case_id").alias("n"), F.max(F.when(F.col("case_id").isNull(), F.col("n"))).alias("met")).where("n = cases")
    common = F.col("met") == F.col("cases")
    kinds = whole.groupBy(*key).agg(F.sort_array(F.collect_set(F.when(common, F.col("other_kind")))).alias("extra_kinds"), F.sort_array(F.collect_set(F.when(~common, F.col("other_kind")))).alias("conflict_kinds"))
    # the same originals in every case, by their hashes in order-free form
    sides = indicators.join(groups.select(*key), key, "left_semi").groupBy(*key, "case_id").agg(F.sort_array(F.collect_set(F.xxhash64("original"))).alias("originals"), F.bool_or("reviewed").alias("reviewed"))
    sides = sides.groupBy(*key).agg((F.count_distinct("originals") == 1).alias("same"), F.bool_or("reviewed").alias("reviewed"))
    support = _support(indicators, groups, most)
    empty = F.array().cast("array<string>")
    rows = groups.join(sides, key).join(support, key).join(kinds, key, "left").withColumns({c: F.coalesce(c, empty) for c in ("extra_kinds", "conflict_kinds")})
    named = F.col("kind").isin(*IDENTIFIERS)
    label = F.when((F.col("kind") == "reviewed_alias") | F.col("reviewed"), "reviewed_alias").when(named & F.col("same"), "exact_identifier").when(named, "normalized_identifier").when(F.size("extra_kinds") > 0, "normalized_identifier").otherwise("similarity_name_only")
    rows = rows.withColumn("classification", label)
    return rows.select(*key, "cases", "classification", "extra_kinds", "conflict_kinds", score(F.col("classification"), F.size("extra_kinds"), F.col("support"), F.col("cases")).alias("score"), (F.col("classification") != "similarity_name_only").alias("reviewable"))


def score(classification: Column, extra: Column, support: Column, cases: Column) -> Column:
    """Base of the classification, up to 20 for further kinds, up to 15 for support beyond one a case; 0 to 100."""
    base = F.lit(0)
    for name, points in BASE.items():
        base = F.when(classification == name, points).otherwise(base)
    return F.greatest(F.lit(0), F.least(F.lit(100), base + F.least(F.lit(20), 5 * extra) + F.least(F.lit(15), 3 * F.greatest(F.lit(0), support - cases)))).cast("int")

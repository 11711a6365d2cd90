"""Filters, lookups, counts and rankings over case tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escaped_like(column: str, term: str) -> Column:
    """Case-insensitive substring; wildcards in ``term`` are ordinary characters."""
    return F.contains(F.lower(column), F.lower(F.lit(term)))


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every argument that is set. A list means one of; (low, high) is inclusive."""
    tests = []
    for name, value in wanted.items():
        if isinstance(value, list):
            tests.append(F.col(name).isin(value))
        elif isinstance(value, tuple):
            tests.append(F.col(name).between(*value))
        elif value is not None:
            tests.append(F.col(name) == value)
    return df.where(reduce(Column.__and__, tests)) if tests else df


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order, with the count of all rows as ``total``."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def first_present(*columns: str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def flattened(raw: Column) -> Column:
    """Leaves of a JSON object one level deep as a map: scalars by key, those of nested objects by parent.child.

    Booleans, nulls, arrays and deeper objects are left out.
    """
    top = F.from_json(raw, "map<string,string>")
    entries = F.map_entries(top)
    scalar = F.filter(entries, lambda e: e["value"].isNotNull() & ~e["value"].rlike(r"^\s*[\[{]") & ~e["value"].isin("true", "false"))
    inner = F.flatten(F.transform(F.filter(entries, lambda e: e["value"].rlike(r"^\s*\{")), lambda e: F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))))
    inner = F.filter(inner, lambda e: e["value"].isNotNull() & ~e["value"].rlike(r"^\s*[\[{]") & ~e["value"].isin("true", "false"))
    return F.map_from_entries(F.concat(scalar, inner))


def deep_leaves(df: DataFrame, key: str, raw: str, depth: int = 5) -> DataFrame:
    """key, path, value: the scalar leaves of a JSON text, down to ``depth`` levels; list elements by their index."""
    at = df.select(key, F.lit("").alias("path"), F.trim(raw).alias("value"), F.lit(False).alias("leaf"))
    for _ in range(depth):
        dot = F.when(F.col("path") == "", F.lit("")).otherwise(F.concat("path", F.lit(".")))

        def child(k: Column, value: Column) -> Column:
            return F.struct(F.concat(dot, k).alias("path"), value.alias("value"), (~value.rlike(r"^[\[{]")).alias("leaf"))

        fields = F.transform(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: child(e["key"], e["value"]))
        items = F.transform(F.from_json("value", "array<string>"), lambda x, i: child(i.cast("string"), x))
        parts = F.when(F.col("leaf"), F.array(F.struct("path", "value", "leaf"))).when(F.col("value").startswith("{"), fields).when(F.col("value").startswith("["), items)
        # the outer form, whose rows are not tried by a filter that makes them once more
        at = at.select(key, F.explode_outer(parts).alias("part")).where("part.value is not null").select(key, "part.*")
    return at.where("leaf").drop("leaf")


def visible(cases: DataFrame, members: DataFrame, user: Column | str, admin: bool = False) -> DataFrame:
    """Cases that a user may see: all for an admin, else owned ones and those of a membership."""
    if admin:
        return cases
    mine = members.where(F.col("user_id") == user).select("case_id").distinct()
    return cases.join(mine.withColumn("_member", F.lit(True)), "case_id", "left").where((F.col("owner_id") == user) | F.col("_member")).drop("_member")


def all_sides_visible(candidates: DataFrame, sides: str, allowed: DataFrame, key: str) -> DataFrame:
    """Candidates with at least one side, all of whose sides' cases are in ``allowed`` (case_id)."""
    each = candidates.select(key, F.explode(sides).alias("case_id"))
    bad = each.join(allowed, "case_id", "left_anti").select(key).distinct()
    return candidates.where(F.size(sides) > 0).join(bad, key, "left_anti")


def appended(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` whose key it lacks; of rows of ``new`` with one key, the least stays."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c) for c in new.columns]))
    once = new.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return existing.unionByName(once.join(existing.select(*key), key, "left_anti"))


def capped(ids: Column, limit: int) -> Column:
    """The first ``limit`` of the sorted distinct ids, and whether that left any out."""
    return F.struct(F.slice(F.sort_array(ids), 1, limit).alias("ids"), (F.size(ids) > limit).alias("capped"))


def bounded(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows in order, each with ``bounded``: whether there were more."""
    rows = df.orderBy(*order).limit(limit + 1)
    n = rows.agg((F.count("*") > limit).alias("bounded"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(n))

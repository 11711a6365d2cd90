"""Amounts, dates and hashes from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import once

AMOUNT = "decimal(38,10)"
_TOKEN = r"(?i)\b(inr|usd|eur|gbp|rs\.?)\b|^[₹$€£]"
#: How every layout of a time begins: other texts are tried with this alone.
_STARTS = r"^\d{1,4}[/.-]\d"
#: Currency of a token in an amount that is no code itself. Fixed values.
_SIGNS = {"rs": "INR", "₹": "INR", "$": "USD", "€": "EUR", "£": "GBP"}


def amount(raw: Column) -> Column:
    """The exact number of a text with an optional currency token and thousands separators; null if it is none."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), _TOKEN, " "), r"[,\s]", ""))
    return once(cleaned, lambda v: F.when(v.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"), v.try_cast(AMOUNT)))


def amount_currency(raw: Column) -> Column:
    """The currency that a token in an amount names."""
    token = F.lower(F.regexp_extract(F.trim(raw), f"({_TOKEN})", 1))
    out = F.when(F.length(token) == 3, F.when(token != "rs.", F.upper(token)))
    for sign, code in _SIGNS.items():
        out = out.when(token == sign, code)
    return out


def timestamp(raw: Column) -> Column:
    """ISO with or without zone, day/month/year with time, or a date; UTC."""
    v = F.trim(raw)
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"), F.try_to_timestamp(F.regexp_replace(v, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    dmy = F.when(v.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}[ T,]+\d{1,2}:\d{2}$"), F.try_to_timestamp(F.regexp_replace(v, r"^(\d+)[/-](\d+)[/-](\d+)[ T,]+", "$1/$2/$3 "), F.lit("d/M/y H:mm")))
    return F.when(v.rlike(_STARTS), F.coalesce(iso, dmy, day(v).cast("timestamp")))


def day(raw: Column) -> Column:
    """A date in one of five layouts."""
    v = F.trim(raw)
    layouts = (("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("d/M/y", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("y/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"), ("d-M-y", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("d.M.y", r"^\d{1,2}\.\d{1,2}\.\d{4}$"))
    return F.when(v.rlike(_STARTS), F.coalesce(*[F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(layout)).cast("date")) for layout, shape in layouts]))


def granularity(raw: Column) -> Column:
    """date, datetime, or null where there is no time."""
    return F.when(day(raw).isNotNull(), "date").when(timestamp(raw).isNotNull(), "datetime")


def zone_assumed(raw: Column) -> Column:
    """True for a time without a zone, which is taken as UTC."""
    return timestamp(raw).isNotNull() & ~F.trim(raw).rlike(r"(Z|[+-]\d{2}:?\d{2})$")


def canonical_hash(pairs: Column) -> Column:
    """SHA-256 of a map, whatever the order of its keys."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("\u0000")))), "\u001f"), 256)


def values_equal(a: Column, b: Column) -> Column:
    """Equal as numbers, or as dates in any layout, or as text without regard to case and white space."""
    text = lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))
    return F.coalesce(amount(a) == amount(b), day(a) == day(b), text(a) == text(b))


def dates_agree(a: Column, b: Column) -> Column:
    """Whether two times are the same instant, or the same day where either is a date only."""
    x, y = timestamp(a), timestamp(b)
    return F.when((granularity(a) == "date") | (granularity(b) == "date"), F.to_date(x) == F.to_date(y)).otherwise(x == y)

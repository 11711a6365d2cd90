"""Normalisers and recognisers of identifiers and names, as column expressions.

A normaliser returns the canonical form, or null where the value is not valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles that a person's name is freed from. Fixed values.
HONORIFICS = ("mr", "mrs", "ms", "mx", "dr", "prof", "sri", "shri", "smt", "kum", "er", "c", "master", "miss", "mister", "warrant", "inspector", "constable", "sir")
#: Legal forms that an organisation's name is freed from, from its end. Fixed values.
ORGANIZATION_SUFFIXES = ("inc", "llc", "ltd", "limited", "corp", "corporation", "pvt", "private", "pllc", "co", "company", "gmbh", "sa", "pt")
#: Status words by class, in the order in which classes are tried. Fixed values.
STATUS_WORDS = {
    "completed": ("completed", "complete", "success", "successful", "settled", "done", "posted", "paid", "confirmed"),
    "pending": ("pending", "processing", "in_progress", "initiated", "queued", "authorized"),
    "rejected": ("rejected", "failed", "declined", "denied", "returned", "dishonoured"),
    "reversed": ("reversed", "reversal", "refund", "refunded", "chargeback", "cancelled", "canceled"),
}
#: Parts of field names that speak of time, the strong ones among them, and what they mean. Fixed values.
TIME_HINTS = ("date", "time", "timestamp", "_at", "day", "when", "period", "occurred", "incident", "posted", "logged", "recorded", "submitted", "issued", "closed", "opened", "stamp")
STRONG_TIME_HINTS = ("date", "time", "timestamp", "occurred", "incident", "stamp", "_at")
TIME_MEANING = (
    ("extraction", ("extracted", "parsed", "analysed", "analyzed")),
    ("uploaded", ("uploaded", "imported", "ingested")),
    ("document_created", ("created", "issued", "generated", "printed", "signed", "updated", "modified")),
    ("record_occurs_on", ("occurred", "incident", "txn", "transaction", "paid", "debited", "credited")),
)
PHONE, EMAIL, URL = r"\+?\d[\d\s().-]{6,}\d", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"https?://[^\s<>\"']+"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` worked out once a row however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def _alnum_upper(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, "[^A-Za-z0-9]", ""))


def _within(value: Column, least: int, most: int) -> Column:
    return once(value, lambda v: F.when(F.length(v).between(least, most), v))


def phone(raw: Column) -> Column:
    """Digits without leading zeros; ten of them get the country code 91; 7 to 15 are valid."""
    digits = F.regexp_replace(F.regexp_replace(raw, r"[^0-9]", ""), "^0+", "")
    return once(digits, lambda x: F.when(F.length(x) == 10, F.concat(F.lit("91"), x)).when(F.length(x).between(7, 15), x))


def vehicle(raw: Column) -> Column:
    """Letters and digits, upper case, 4 to 12, with at least one of each."""
    v = _alnum_upper(raw)
    return once(v, lambda x: F.when(x.rlike("[0-9]") & x.rlike("[A-Z]") & F.length(x).between(4, 12), x))


def account(raw: Column) -> Column:
    """Letters and digits, upper case, 6 to 30."""
    return _within(_alnum_upper(raw), 6, 30)


def document(raw: Column) -> Column:
    """10 to 16 digits, or else letters and digits, upper case, 6 to 30."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return once(digits, lambda x: F.when(F.length(x).between(10, 16), x).otherwise(account(raw)))


def person(raw: Column) -> Column:
    """Lower-case words without trailing punctuation and titles."""
    words = F.transform(F.split(F.lower(F.trim(raw)), r"\s+"), lambda w: F.regexp_replace(w, "[.:,]+$", ""))
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*HONORIFICS))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def plain(raw: Column) -> Column:
    """Lower case, with runs of other characters than letters and digits as single blanks: locations and events."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " ")), F.lit(""))


def organization(raw: Column) -> Column:
    """Plain words without a leading "the" and without legal forms at the end."""
    name = F.regexp_replace(plain(raw), "^the( |$)", "")
    return F.nullif(F.trim(F.regexp_replace(name, f"(^| )({'|'.join(ORGANIZATION_SUFFIXES)})( ({'|'.join(ORGANIZATION_SUFFIXES)}))*$", "")), F.lit(""))


def normalized(kind: Column, raw: Column) -> Column:
    """By entity type."""
    value = F.trim(raw)
    return F.when(kind == "person", person(value)).when(kind == "phone", phone(value)).when(kind == "vehicle", vehicle(value)).when(kind == "account", account(value)).when(kind == "document", document(value)).when(kind == "organization", organization(value)).when(kind.isin("location", "event"), plain(value))


def blocking_key(kind: Column, canonical: Column) -> Column:
    """Bucket within which candidates are compared."""
    words = F.split(canonical, " ")
    name = F.when(F.size(words) >= 2, F.concat(F.substring(F.element_at(words, -1), 1, 3), F.lit("_"), F.substring(words[0], 1, 1))).otherwise(F.substring(words[0], 1, 4))
    return F.when(kind.isin("phone", "account", "vehicle"), canonical).when(kind == "person", name).when(kind == "document", F.substring(canonical, 1, 6)).otherwise(F.substring(canonical, 1, 4))


def header(raw: Column) -> Column:
    """A field name in lower case with underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def email(raw: Column) -> Column:
    return F.when(F.trim(raw).rlike(f"^{EMAIL}$"), F.lower(F.trim(raw)))


def url(raw: Column) -> Column:
    """Lower case without one trailing slash."""
    return F.regexp_replace(F.lower(F.trim(raw)), "/$", "")


def domain(raw: Column) -> Column:
    """Host of a URL or an e-mail address, without www."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(raw), "^.*@", ""), "^[^:/]*://", ""), "[/:].*$", "")
    host = F.lower(F.regexp_replace(host, "^www[.]", ""))
    return F.when(host.rlike(r"^[a-z0-9-]+([.][a-z0-9-]+)+$"), host)


def transaction(raw: Column) -> Column:
    return F.when(F.length(_alnum_upper(raw)) >= 4, _alnum_upper(raw))


def reference(raw: Column) -> Column:
    """Upper case without white space, hyphens and dots; for comparison only."""
    return F.regexp_replace(F.upper(F.trim(raw)), r"[\s.-]", "")


def identifier(raw: Column) -> Column:
    """Lower-case letters and digits only, so that UTR-1 equals UTR/1."""
    return F.regexp_replace(F.lower(raw), "[^a-z0-9]", "")


def unkeyed_kind(raw: Column) -> Column:
    """email, url or phone where the whole value is one."""
    v = F.trim(raw)
    return F.when(v.rlike(f"^{EMAIL}$"), "email").when(v.rlike(f"^{URL}$"), "url").when((F.length(v) <= 24) & v.rlike(f"^{PHONE}$") & phone(v).isNotNull(), "phone")


def status_class(raw: Column) -> Column:
    """The class whose word the value is, or else the first class of which it contains one; unknown without any."""
    token = F.regexp_replace(F.lower(F.trim(raw)), "[ -]", "_")
    out = F.when(raw.isNull() | (F.trim(raw) == ""), "unknown")
    for name, words in STATUS_WORDS.items():
        out = out.when(token.isin(*words), name)
    for name, words in STATUS_WORDS.items():
        out = out.when(token.rlike("|".join(words)), name)
    return out.otherwise("unknown")


def has_hint(name: Column, hints: tuple[str, ...]) -> Column:
    """True if one of the hints is a run of whole tokens of an underscore-separated name."""
    return F.concat(F.lit("_"), name, F.lit("_")).rlike("_(" + "|".join(hints) + ")_")


def is_time_field(name: Column) -> Column:
    return F.lower(name).rlike("|".join(TIME_HINTS))


def is_strong_time_field(name: Column) -> Column:
    return F.lower(name).rlike("|".join(STRONG_TIME_HINTS))


def time_meaning(name: Column) -> Column:
    out = None
    for meaning, hints in TIME_MEANING:
        test = F.lower(name).rlike("|".join(hints))
        out = F.when(test, meaning) if out is None else out.when(test, meaning)
    return out.otherwise("record_occurs_on")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common among all elements, in percent."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.round(100 * F.size(F.array_intersect(a, b)) / n, 2))


def script_counts(text: Column) -> list[Column]:
    """Characters of each script: latin, devanagari, digits, spaces, other."""
    of = lambda cls: F.length(text) - F.length(F.regexp_replace(text, f"[{cls}]", ""))
    latin, dev, digits, spaces = (of(c) for c in ("A-Za-zÀ-ɏ", "ऀ-ॿ", "0-9", " \t\r\n"))
    return [latin.alias("latin"), dev.alias("devanagari"), digits.alias("digits"), spaces.alias("spaces"), (F.length(text) - latin - dev - digits - spaces).alias("other")]


def keyword_relevance(tokens: Column, text: Column) -> Column:
    """Share of the tokens that occur in the text."""
    return F.size(F.filter(tokens, lambda t: F.contains(F.lower(text), t))) / F.greatest(F.size(tokens), F.lit(1))

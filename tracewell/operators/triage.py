"""Triage of records: e-mail headers, URLs, hash manifests and log lines, and what they give reason to observe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text

#: Severity of each observation. Fixed values.
SEVERITY = {
    "url.userinfo": "high", "url.ip_host": "high", "url.punycode": "medium", "url.nonstandard_port": "low", "email.missing_message_id": "low", "email.return_path_mismatch": "medium",
    "manifest.hash_mismatch": "high", "manifest.entry_missing": "medium", "history.cross_scheme_redirect_chain_hint": "info", "log.auth_failure_burst": "high",
}
#: Headers that make a text an e-mail. Fixed values.
EMAIL_HEADERS = ("from", "to", "cc", "subject", "date", "message-id", "return-path", "received", "x-originating-ip", "received-spf", "authentication-results", "dkim-signature", "reply-to", "mime-version", "content-type")
#: A header line, and a digest in a line. Fixed values.
_LINE = r"^([A-Za-z][A-Za-z0-9-]{1,40}):\s?(.*)$"
_SHA = r"\b([0-9a-fA-F]{64})\b"


def _header_lines(body: Column, names: tuple[str, ...]) -> Column:
    """key and value of the lines "Key: value" of a text whose key is one of ``names``."""
    parts = F.transform(F.split(body, r"\r?\n"), lambda x: F.struct(F.lower(F.regexp_extract(F.trim(x), _LINE, 1)).alias("key"), F.substring(F.trim(F.regexp_extract(F.trim(x), _LINE, 2)), 1, 500).alias("value")))
    return F.filter(parts, lambda p: p["key"].isin(*names) & (p["value"] != ""))


def email_headers(body: Column) -> Column:
    """Map of known headers (lower case) to their first values; null unless there are two of them."""
    found = _header_lines(body, EMAIL_HEADERS)
    keys = F.array_distinct(F.transform(found, lambda p: p["key"]))
    first = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.filter(found, lambda p: p["key"] == k)[0]["value"])))
    return F.when(F.size(keys) >= 2, first)


def authentication(body: Column) -> list[Column]:
    """spf, dkim, dmarc: the first result of each in the authentication headers, in lower case."""
    said = F.lower(F.array_join(F.transform(_header_lines(body, ("authentication-results", "received-spf")), lambda p: p["value"]), " "))
    return [F.nullif(F.regexp_extract(said, rf"\b{m}\s*=\s*(pass|fail|none|softfail|permerror|temperror)\b", 1), F.lit("")).alias(m) for m in ("spf", "dkim", "dmarc")]


def address_domain(value: Column) -> Column:
    """Domain of an address, also of the form Name <a@b>."""
    inside = F.regexp_extract(value, "<([^>]+)>", 1)
    address = F.when(inside != "", inside).otherwise(value)
    host = F.regexp_replace(F.lower(F.trim(F.regexp_extract(address, "@([^@]*)$", 1))), r"^\.+|\.+$", "")
    return F.nullif(host, F.lit(""))


def email_observations(records: DataFrame) -> DataFrame:
    """record_id, rule, detail of records (record_id, body) that are e-mails."""
    rows = records.select("record_id", email_headers(F.col("body")).alias("h")).where("h is not null")
    none = rows.where(~F.map_contains_key("h", F.lit("message-id"))).select("record_id", F.lit("email.missing_message_id").alias("rule"), F.array_join(F.array_sort(F.map_keys("h")), ",").alias("detail"))
    back, own = address_domain(F.element_at("h", "return-path")), address_domain(F.element_at("h", "from"))
    return none.unionByName(rows.where(back != own).select("record_id", F.lit("email.return_path_mismatch").alias("rule"), F.concat(own, F.lit(">"), back).alias("detail")))


def url_observations(urls: DataFrame) -> DataFrame:
    """record_id, rule, detail of URLs (record_id, url) whose structure is unusual."""
    u = F.col("url")
    rest = F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), r":\d*$", "")
    port = F.regexp_extract(F.regexp_replace(rest, "^.*@", ""), r":(\d+)$", 1)
    tests = {"url.userinfo": F.contains(rest, F.lit("@")), "url.ip_host": host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "url.punycode": F.lower(host).rlike(r"(^|\.)xn--"), "url.nonstandard_port": (port != "") & ~port.isin("80", "443")}
    each = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    return urls.select("record_id", F.explode(each).alias("rule"), F.lower(host).alias("detail"))


def manifest_entries(rows: DataFrame) -> DataFrame:
    """record_id, sha256, filename of lines (record_id, line) that hold a SHA-256: the name is the token after it, or else before it."""
    r = rows.withColumn("sha256", F.lower(F.regexp_extract("line", _SHA, 1))).where("sha256 <> ''")
    clean = lambda t: F.regexp_replace(t, "^[,;|]+|[,;|]+$", "")
    tokens = F.transform(F.split(F.trim("line"), r"\s+"), clean)
    at = F.array_position(F.transform(tokens, F.lower), F.col("sha256")).cast("int")
    near = F.array(F.get(tokens, at), F.when(at > 1, F.get(tokens, at - 2)))
    name = F.filter(near, lambda t: t.isNotNull() & (t != "") & ~t.rlike("^[0-9a-fA-F]{64}$"))[0]
    return r.select("record_id", "sha256", F.when(at > 0, F.substring(name, 1, 256)).alias("filename"))


def manifest_verdicts(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds computed and verdict: match, mismatch, missing (no such file), object_unavailable. stored: filename, sha256 (null where the bytes are gone)."""
    have = stored.groupBy(F.lower(F.trim("filename")).alias("_name")).agg(F.min(F.lower("sha256")).alias("computed"), F.lit(True).alias("_there"))
    rows = entries.withColumn("_name", F.lower(F.trim("filename"))).join(have, "_name", "left")
    verdict = F.when(F.col("_there").isNull(), "missing").when(F.col("computed").isNull(), "object_unavailable").when(F.col("computed") == F.lower("sha256"), "match").otherwise("mismatch")
    return rows.select(*entries.columns, "computed", verdict.alias("verdict"))


def manifest_observations(verdicts: DataFrame) -> DataFrame:
    """record_id, rule, detail."""
    rule = F.when(F.col("verdict") == "mismatch", "manifest.hash_mismatch").when(F.col("verdict").isin("missing", "object_unavailable"), "manifest.entry_missing")
    return verdicts.select("record_id", rule.alias("rule"), F.coalesce("filename", F.lit("")).alias("detail")).where("rule is not null")


def history_observations(visits: DataFrame) -> DataFrame:
    """record_id (the first), rule, detail of hosts that visits (record_id, url) reach by both http and https."""
    at = visits.select("record_id", text.domain(F.col("url")).alias("host"), F.lower(F.regexp_extract("url", "^([a-zA-Z]+)://", 1)).alias("scheme")).where("host is not null")
    both = at.groupBy("host").agg(F.min("record_id").alias("record_id"), F.bool_or(F.col("scheme") == "http").alias("a"), F.bool_or(F.col("scheme") == "https").alias("b")).where("a and b")
    return both.select("record_id", F.lit("history.cross_scheme_redirect_chain_hint").alias("rule"), F.col("host").alias("detail"))


#: What a log line is read by: time, severity words with what they mean, words of logging in and of failing. Fixed values.
_STAMP = r"\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)\b"
_LEVEL = r"(?i)\b(critical|fatal|emergency|alert|error|err|fail|failed|failure|denied|warn|warning|notice|info|information|debug|trace)\b"
LEVELS = {
    "critical": "critical", "fatal": "critical", "emergency": "critical", "alert": "critical", "error": "error", "err": "error", "failure": "error", "failed": "error", "fail": "error", "denied": "error",
    "warning": "warning", "warn": "warning", "notice": "notice", "information": "info", "info": "info", "debug": "debug", "trace": "debug",
}
_AUTH = r"(?i)\b(auth|authentication|authenticate|authorized|login|logon|signin|password|passwd|credential)\w*\b"
_FAIL = r"(?i)\b(fail\w*|denied|invalid|rejected|locked)\w*\b"
#: A burst of failed logins: at least so many within so many seconds. Fixed values.
BURST, BURST_S = 5, 600


def log_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no (from 1), stamp, at (null where the stamp is no time), severity, source, auth_failure of the lines of ``rows``
    (keys, body) that have both a time and a word of severity; all lines are read.

    The source is the first of the second to fourth words that looks like a name and is not the word of severity.
    """
    lines = rows.select(*keys, F.posexplode(F.split("body", r"\r\n|[\n\r]")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    lines = lines.select(*keys, (F.col("line_no") + 1).alias("line_no"), "line", F.regexp_extract("line", _STAMP, 1).alias("stamp"), F.lower(F.regexp_extract("line", _LEVEL, 1)).alias("word")).where("stamp <> '' and word <> ''")
    words = F.transform(F.slice(F.split("line", r"\s+"), 2, 3), lambda w: F.regexp_replace(w, r"^[\[\],():;]+|[\[\],():;]+$", ""))
    names = F.filter(words, lambda w: w.rlike(r"^[A-Za-z][\w.\-]{1,40}$") & (F.lower(w) != F.col("word")))
    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("word"))
    auth = F.col("line").rlike(_AUTH) & F.col("line").rlike(_FAIL)
    return lines.select(
        *keys, "line_no", "stamp", F.try_to_timestamp("stamp").alias("at"), level.alias("severity"), F.coalesce(F.substring(F.get(names, F.lit(0)), 1, 40), F.lit("unknown")).alias("source"), auth.alias("auth_failure")
    )


def log_observations(lines: DataFrame, evidence: str, record_id: str, window: int = BURST_S, least: int = BURST) -> DataFrame:
    """record_id (of the burst's first line), rule, detail (its number of lines) of the first burst of failed logins in each ``evidence``."""
    failed = lines.where("auth_failure and at is not null").select(F.col(evidence).alias("e"), F.unix_micros("at").alias("us"), F.col(record_id).alias("record_id"))
    w = Window.partitionBy("e").orderBy("us").rangeBetween(0, window * 1_000_000)
    first = failed.withColumn("n", F.count("*").over(w)).where(F.col("n") >= least).groupBy("e").agg(F.min(F.struct("us", "record_id", "n")).alias("x"))
    return first.select("x.record_id", F.lit("log.auth_failure_burst").alias("rule"), F.col("x.n").cast("string").alias("detail"))


def observations(*found: DataFrame, most: int | None = 200) -> DataFrame:
    """record_id, rule, severity, detail of all ``found``; the report's ``most`` first ones by record and rule, or all."""
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    level = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("rule"))
    rows = rows.select("record_id", "rule", level.alias("severity"), "detail")
    return rows if most is None else rows.orderBy("record_id", "rule", "detail").limit(most)


def package(entries: DataFrame, files: DataFrame, imported: DataFrame) -> DataFrame:
    """Verdict on each package before anything is stored: package_id, entries, codes (sorted), accepted.

    entries: package_id, filename, sha256, size of the manifest. files: package_id, filename, sha256, size of what was
    sent. imported: package_id of earlier imports. Codes: replayed, manifest_incomplete, duplicate_name,
    duplicate_hash, file_missing, file_unlisted, hash_mismatch, size_mismatch.
    """
    side = lambda df, told: df.select("package_id", "filename", F.lit(told).alias("told"), F.col("sha256").alias("sha"), "size")
    told, each = F.col("told"), F.struct("sha", "size")
    rows = side(entries, True).unionByName(side(files, False)).withColumn("bad", told & ~_shape("filename", "sha", "size")).groupBy("package_id", "filename")
    shas = F.collect_list(F.when(told, F.struct("sha"))).alias("shas")
    sides = rows.agg(F.max("bad").alias("bad"), F.count_if(told).alias("n"), F.first(F.when(told, each), True).alias("want"), F.first(F.when(~told, each), True).alias("have"), shas)
    return package_sides(sides, imported)


def _shape(filename: str, sha: str, size: str) -> Column:
    return F.coalesce(F.trim(filename) != "", F.lit(False)) & F.coalesce(F.lower(sha).rlike("^[0-9a-f]{64}$"), F.lit(False)) & F.coalesce(F.col(size) >= 0, F.lit(False))


def sides_of(rows: DataFrame) -> DataFrame:
    """The rows of ``package_sides`` for names with at most one entry and one file: want_sha, want_size, have_sha, have_size, told (whether
    there is an entry), all (whether there is no file)."""
    told, side = F.col("told"), lambda x: F.struct(F.col(f"{x}_sha").alias("sha"), F.col(f"{x}_size").alias("size"))
    shas = F.when(told, F.array(F.struct(F.col("want_sha").alias("sha"))))
    bad = told & ~_shape("filename", "want_sha", "want_size")
    return rows.select("package_id", "filename", bad.alias("bad"), told.cast("int").alias("n"), F.when(told, side("want")).alias("want"), F.when(~F.col("all"), side("have")).alias("have"), shas.alias("shas"))


def package_sides(sides: DataFrame, imported: DataFrame) -> DataFrame:
    """``package`` of names whose two sides have met: package_id, filename, bad (whether an entry lacks something), n (entries), want
    and have (sha, size of an entry and of a file, or null), shas (a struct of the hash of each entry).

    Rows that are dealt by package are dealt no more: hashes are counted within their packages' parts.
    """
    want, have, named = F.col("want"), F.col("have"), F.col("filename").isNotNull()
    met = want.isNotNull() & have.isNotNull() & named
    differ = lambda x, y: F.coalesce(met & (x != y), F.lit(False))
    flags = {
        "duplicate_name": F.col("n") > 1,
        "file_missing": want.isNotNull() & ~met,
        "file_unlisted": have.isNotNull() & ~met,
        "hash_mismatch": differ(F.lower(want["sha"]), F.lower(have["sha"])),
        "manifest_incomplete": F.coalesce("bad", F.lit(False)),
        "size_mismatch": differ(want["size"], have["size"]),
    }
    rows = sides.select("package_id", F.explode_outer("shas").alias("x"), *[c.alias(n) for n, c in flags.items()])
    rows = rows.groupBy("package_id", "x.sha").agg(F.count("x").alias("n"), *[F.max(n).alias(n) for n in flags])
    rows = rows.groupBy("package_id").agg(F.sum("n").alias("entries"), F.max(F.col("n") > 1).alias("duplicate_hash"), *[F.max(n).alias(n) for n in flags]).where("entries > 0")
    rows = rows.join(imported.select("package_id").distinct().withColumn("replayed", F.lit(True)), "package_id", "left")
    known = F.col("package_id").isNotNull()
    codes = F.array_compact(F.array(*[F.when(known & F.col(n), F.lit(n)) for n in sorted([*flags, "duplicate_hash", "replayed"])]))
    return rows.select("package_id", "entries", codes.alias("codes")).withColumn("accepted", F.size("codes") == 0)


def manifest_of(files: DataFrame) -> DataFrame:
    """package_id, files, size, digest of the canonical manifest: lines "filename sha256 size" in the order of names, hashed.

    The digest is a hash over the sorted hashes of its lines, so a package of many files needs no list of them
    all in one row beyond their hashes.
    """
    line = F.concat_ws(" ", "filename", F.lower("sha256"), F.col("size").cast("string"))
    return files.groupBy("package_id").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2(line, 256))), ""), 256).alias("digest"))

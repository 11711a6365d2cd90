"""Mentions in the texts of documents and in notes that are made from orders, and in packed fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.domain import table
from tracewell.operators import mentions
from tracewell.plans.registry import oracle_of, query

#: A note for each order: which numbers it names, and how, depends on the order's key.
NOTES = r"""notes AS (SELECT 'O' || o_orderkey AS text_id, CASE o_orderkey % 8
  WHEN 0 THEN 'Call +91 98' || lpad(o_custkey::VARCHAR, 8, '0') || ' from desk' || o_orderkey % 97
  WHEN 1 THEN 'Car MH12AB' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' was seen, then XQA1B2 and KA1B2.'
  WHEN 2 THEN 'Card ' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || ' 5678 ' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' shown'
  WHEN 3 THEN 'Sent from account number: ' || lpad(o_orderkey::VARCHAR, 12, '0') || ' today'
  WHEN 4 THEN 'Passport BJ' || lpad(o_custkey::VARCHAR, 7, '0') || ' details verified'
  WHEN 5 THEN lpad(o_orderkey::VARCHAR, 12, '0') || ' only'
  WHEN 6 THEN 'A/C 22004 ' || lpad(o_orderkey::VARCHAR, 9, '1') || ' confirmed. Document no. ' || o_orderpriority
  ELSE 'order ' || o_totalprice::DECIMAL(18,2) || ' ' || o_orderpriority END AS body FROM orders),
texts AS (SELECT * FROM notes UNION ALL SELECT 'D' || doc_id, text FROM documents)"""


def _padded(c, n: int, fill: str = "0"):
    # as the SQL: a longer number is cut
    return F.lpad(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), n, fill)


def _texts(spark, d):
    k, cat = F.col("o_orderkey") % 8, F.concat
    low = lambda c: _padded(F.col(c) % 10000, 4)
    body = (
        F.when(k == 0, cat(F.lit("Call +91 98"), _padded("o_custkey", 8), F.lit(" from desk"), (F.col("o_orderkey") % 97).cast("string")))
        .when(k == 1, cat(F.lit("Car MH12AB"), low("o_orderkey"), F.lit(" was seen, then XQA1B2 and KA1B2.")))
        .when(k == 2, cat(F.lit("Card "), low("o_custkey"), F.lit(" 5678 "), low("o_orderkey"), F.lit(" shown")))
        .when(k == 3, cat(F.lit("Sent from account number: "), _padded("o_orderkey", 12), F.lit(" today")))
        .when(k == 4, cat(F.lit("Passport BJ"), _padded("o_custkey", 7), F.lit(" details verified")))
        .when(k == 5, cat(_padded("o_orderkey", 12), F.lit(" only")))
        .when(k == 6, cat(F.lit("A/C 22004 "), _padded("o_orderkey", 9, "1"), F.lit(" confirmed. Document no. "), F.col("o_orderpriority")))
        .otherwise(F.concat_ws(" ", F.lit("order"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderpriority")))
    )
    notes = table(spark, d, "orders").select(cat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("text_id"), body.alias("body"))
    return notes.unionByName(table(spark, d, "documents").select(cat(F.lit("D"), F.col("doc_id").cast("string")).alias("text_id"), F.col("text").alias("body")))


def _found(spark, d, name: str):
    return mentions.recognised(_texts(spark, d), "body", ["text_id"]).where(F.col("recogniser") == name).drop("recogniser", "entity_type")


def _placed(pattern: str, value: str, canonical: str, keep: str = "true") -> str:
    """SQL of a recogniser. Matches are found one by one; each is looked for behind the one before it."""
    return rf"""WITH RECURSIVE {NOTES},
hits AS (SELECT text_id, body, regexp_extract_all(body, '{pattern}') AS ms FROM texts WHERE regexp_matches(body, '{pattern}')),
walk(text_id, body, ms, k, m, start, stop) AS (SELECT text_id, body, ms, 0, NULL::VARCHAR, 0, 0 FROM hits
  UNION ALL SELECT text_id, body, ms, k + 1, ms[k + 1], (stop + instr(body[stop + 1:], ms[k + 1]) - 1)::INT, (stop + instr(body[stop + 1:], ms[k + 1]) - 1 + length(ms[k + 1]))::INT FROM walk WHERE k < len(ms)),
v AS (SELECT text_id, {value} AS raw, start, stop FROM walk WHERE k > 0),
c AS (SELECT *, {canonical} AS canonical FROM v WHERE {keep})
SELECT text_id, raw, canonical, start, stop FROM c WHERE canonical IS NOT NULL"""


DIGITS = "ltrim(regexp_replace(raw, '[^0-9]', '', 'g'), '0')"
PHONE = f"CASE WHEN length({DIGITS}) = 10 THEN '91' || {DIGITS} WHEN length({DIGITS}) BETWEEN 7 AND 15 THEN {DIGITS} END"
SOLID = "upper(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g'))"
ACCOUNT = f"CASE WHEN length({SOLID}) BETWEEN 6 AND 30 THEN {SOLID} END"
ALL_DIGITS = "regexp_replace(raw, '[^0-9]', '', 'g')"
DOCUMENT = f"CASE WHEN length({ALL_DIGITS}) BETWEEN 10 AND 16 THEN {ALL_DIGITS} ELSE {ACCOUNT} END"
NUMBER = r"length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 12 AND NOT raw LIKE '+%' AND regexp_full_match(raw, '[0-9]+|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}\s[0-9]{4}\s[0-9]{4}')"
#: Labels of accounts and documents, with the value as the last group of what follows them.
ACCOUNT_LABEL, DOCUMENT_LABEL = r"(?i)\b(?:account\s*(?:no\.?|number)?|a/c)\s*[:#]?\s*", r"(?i)\b(?:passport|pan no\.?|pancard|document no\.?|id(?:entification)? number|dl no\.?)\s*[:#]?\s*"


def _labelled(label: str, first: str, canonical: str) -> str:
    """SQL of a labelled recogniser: what ends a value is matched with it and cut off again."""
    end = r"(?:\s+[A-Za-z]{2,}\b|\s*$|\.\s)"
    whole = f"{label}{first}[A-Za-z0-9 .-]{{4,28}}?{end}"
    cut = rf"regexp_extract(m, '^{label}({first}[A-Za-z0-9 .-]{{4,28}}?){end}$', 1)"
    return rf"""WITH RECURSIVE {NOTES},
hits AS (SELECT text_id, body, unnest(regexp_extract_all(body, '{whole}')) AS m FROM texts WHERE regexp_matches(body, '{whole}')),
v AS (SELECT text_id, {cut} AS raw, (instr(body, m) - 1)::INT AS start, (instr(body, m) - 1 + length(regexp_extract(m, '^({label})', 1)) + length({cut}))::INT AS stop FROM hits),
c AS (SELECT *, {canonical} AS canonical FROM v)
SELECT text_id, raw, canonical, start, stop FROM c WHERE canonical IS NOT NULL"""


@query("F19_phones", _placed(r"\+?[0-9][0-9\s().-]{6,}[0-9]", "m", PHONE, f"NOT ({NUMBER})"))
def f19_phones(spark, d):
    return _found(spark, d, "phone")


@query("F19_vehicles", _placed(r"\b[A-Z]{2}[0-9]{1,2}[A-Z]{1,2}[0-9]{1,4}\b", "m", f"CASE WHEN length({SOLID}) BETWEEN 4 AND 12 THEN {SOLID} END"))
def f19_vehicles(spark, d):
    return _found(spark, d, "vehicle")


@query("F19_grouped_documents", _placed(r"\b(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}\s[0-9]{4}\s[0-9]{4})\b", "m", DOCUMENT))
def f19_documents(spark, d):
    return _found(spark, d, "grouped_document")


@query("F19_labelled_accounts", _labelled(ACCOUNT_LABEL, "[A-Za-z0-9]", ACCOUNT))
def f19_accounts(spark, d):
    return _found(spark, d, "labelled_account")


@query("F19_labelled_documents", _labelled(DOCUMENT_LABEL, "[A-Z0-9]", DOCUMENT))
def f19_labelled(spark, d):
    return _found(spark, d, "labelled_document")


_ALL = " UNION ALL ".join(f"SELECT text_id, '{name}' AS recogniser, {mentions.PRECEDENCE[name]} AS p, raw, start, stop FROM ({oracle_of(q)})" for q, name in (("F19_phones", "phone"), ("F19_vehicles", "vehicle"), ("F19_grouped_documents", "grouped_document"), ("F19_labelled_accounts", "labelled_account"), ("F19_labelled_documents", "labelled_document")))


@query("E02_settled_mentions", f"WITH found AS MATERIALIZED ({_ALL}) SELECT text_id, recogniser, raw, start, stop FROM found x WHERE NOT EXISTS (SELECT 1 FROM found y WHERE y.text_id = x.text_id AND y.p < x.p AND y.start < x.stop AND x.start < y.stop)")
def e02_settled(spark, d):
    """Phones found in parts of accounts and documents give way to these."""
    found = mentions.settled(mentions.recognised(_texts(spark, d), "body", ["text_id"]), ["text_id"])
    return found.select("text_id", "recogniser", "raw", "start", "stop")


PACKED = """f AS (SELECT c_custkey, 'person' AS entity_type, 'Suspect Name' AS header, c_name AS raw, lower(c_name) AS canonical FROM customer WHERE c_name <> ''
UNION ALL SELECT c_custkey, 'phone', 'Mobile No.', unnest(CASE c_custkey % 3 WHEN 0 THEN ['98' || lpad(c_custkey::VARCHAR, 8, '0'), '7' || lpad(c_custkey::VARCHAR, 9, '0')] WHEN 1 THEN ['98' || lpad(c_custkey::VARCHAR, 8, '0')] ELSE [] END),
  unnest(CASE c_custkey % 3 WHEN 0 THEN ['9198' || lpad(c_custkey::VARCHAR, 8, '0'), '917' || lpad(c_custkey::VARCHAR, 9, '0')] WHEN 1 THEN ['9198' || lpad(c_custkey::VARCHAR, 8, '0')] ELSE [] END) FROM customer
UNION ALL SELECT c_custkey, 'account', 'account_no', 'AC-' || lpad(c_custkey::VARCHAR, 9, '0'), 'AC' || lpad(c_custkey::VARCHAR, 9, '0') FROM customer)"""


def _fields():
    n = F.col("c_custkey")
    one, two = F.concat(F.lit("98"), _padded("c_custkey", 8)), F.concat(F.lit("7"), _padded("c_custkey", 9))
    phones = F.when(n % 3 == 0, F.concat(one, F.lit("; "), two)).when(n % 3 == 1, one).otherwise("12|34,unknown")
    pairs = {"Suspect Name": F.col("c_name"), "Mobile No.": phones, "account_no": F.concat(F.lit("AC-"), _padded("c_custkey", 9)), "remark": F.concat(F.lit("car MH01AB"), _padded(n % 10000, 4), F.lit(" and "), one), "segment": F.col("c_mktsegment")}
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


@query("E01_packed_fields", f"WITH {PACKED} SELECT c_custkey, header, entity_type, raw, canonical FROM f")
def e01_packed(spark, d):
    return mentions.field_mentions(table(spark, d, "customer"), _fields(), ["c_custkey"])


@query("E01_E02_record_mentions", rf"""WITH {PACKED},
t AS (SELECT c_custkey, 'car MH01AB' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' and 98' || lpad(c_custkey::VARCHAR, 8, '0') || ' ' || c_mktsegment AS body FROM customer),
r AS (SELECT c_custkey, 'vehicle' AS entity_type, 'MH01AB' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS canonical, 4 AS start, 14 AS stop FROM t
  UNION ALL SELECT c_custkey, 'phone', '9198' || lpad(c_custkey::VARCHAR, 8, '0'), 19, 29 FROM t)
SELECT c_custkey, entity_type, canonical, 'field' AS source, NULL::INT AS start, NULL::INT AS stop FROM f
UNION ALL SELECT c_custkey, entity_type, canonical, 'rule', start, stop FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.c_custkey = r.c_custkey AND f.entity_type = r.entity_type AND f.canonical = r.canonical)""")
def e01_e02(spark, d):
    return mentions.record_mentions(table(spark, d, "customer"), _fields(), ["c_custkey"]).select("c_custkey", "entity_type", "canonical", "source", "start", "stop")

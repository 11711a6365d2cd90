"""Queries that apply normalisers, recognisers and parsers to whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.domain import table
from tracewell.functions import text, values
from tracewell.plans.registry import query

TEL = r"'\+?[0-9][0-9\t\n\r ().-]{6,}[0-9]'"


@query("F01_F19_phones", f"SELECT doc_id, raw, CASE WHEN length(x) = 10 AND length('91' || x) BETWEEN 7 AND 15 THEN '91' || x WHEN length(x) BETWEEN 7 AND 15 AND length(x) <> 10 THEN x END AS phone FROM (SELECT doc_id, raw, ltrim(regexp_replace(raw, '[^0-9]', '', 'g'), '0') AS x FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, {TEL}))) AS raw FROM documents))")
def f01(spark, d):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\+?[0-9][0-9\t\n\r ().-]{6,}[0-9])"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("raw")).select("doc_id", "raw", text.phone(F.col("raw")).alias("phone"))


@query("F02_F03_vehicle_account", "SELECT c_custkey, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS account, CASE WHEN length(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) <= 12 THEN upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) END AS vehicle FROM customer")
def f02(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.account(F.col("c_name")).alias("account"), text.vehicle(F.col("c_name")).alias("vehicle"))


@query("F04_document", "SELECT s_suppkey, CASE WHEN length(x) BETWEEN 10 AND 16 THEN x WHEN length(y) BETWEEN 6 AND 30 THEN y END AS document FROM (SELECT s_suppkey, regexp_replace(s_name || s_suppkey, '[^0-9]', '', 'g') AS x, upper(regexp_replace(s_name || s_suppkey, '[^A-Za-z0-9]', '', 'g')) AS y FROM supplier)")
def f04(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.document(F.concat("s_name", F.col("s_suppkey").cast("string"))).alias("document"))


@query("F05_person", "SELECT c_custkey, lower(c_name) AS person FROM customer")
def f05(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.person(F.concat(F.lit("Mr. Dr "), "c_name", F.lit(","))).alias("person"))


@query("F06_F07_organization", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS organization, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS location FROM part")
def f06(spark, d):
    return table(spark, d, "part").select("p_partkey", text.organization(F.concat(F.lit("The "), "p_name", F.lit(" Pvt. Ltd."))).alias("organization"), text.plain(F.col("p_type")).alias("location"))


@query("F08_blocking_key", "SELECT p_partkey, CASE WHEN contains(n, ' ') THEN left(split_part(n, ' ', -1), 3) || '_' || left(n, 1) ELSE left(n, 4) END AS block FROM (SELECT p_partkey, lower(p_name) AS n FROM part)")
def f08(spark, d):
    return table(spark, d, "part").select("p_partkey", text.blocking_key(F.lit("person"), text.person(F.col("p_name"))).alias("block"))


@query("F09_domain", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)), '^www[.]', '') AS domain, regexp_replace(lower(trim(url)), '/$', '') AS url FROM pages")
def f09(spark, d):
    return table(spark, d, "pages").select("page_id", text.domain(F.col("url")).alias("domain"), text.url(F.col("url")).alias("url"))


@query("F10_unkeyed_kind", "SELECT page_id, 'url' AS kind, NULL::VARCHAR AS other FROM pages")
def f10(spark, d):
    return table(spark, d, "pages").select("page_id", text.unkeyed_kind(F.col("url")).alias("kind"), text.unkeyed_kind(F.concat(F.lit("page "), "url")).alias("other"))


@query("F11_F15_reference", r"SELECT o_orderkey, regexp_replace(upper(trim(o_orderpriority)), '[\s.-]', '', 'g') AS ref, regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') AS ident FROM orders")
def f11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.reference(F.col("o_orderpriority")).alias("ref"), text.identifier(F.col("o_orderpriority")).alias("ident"))


@query("F12_status", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'pending' ELSE 'unknown' END AS status FROM events")
def f12(spark, d):
    raw = F.when(F.col("event_type") == "purchase", "Fully paid").when(F.col("event_type") == "error", "DECLINED").when(F.col("event_type") == "view", "in-progress").when(F.col("event_type") == "signup", "")
    return table(spark, d, "events").select("event_id", text.status_class(raw).alias("status"))


@query("F13_hints", "SELECT p_partkey, regexp_matches('_' || replace(lower(p_type), ' ', '_') || '_', '_(brass|economy)_') AS hint FROM part")
def f13(spark, d):
    return table(spark, d, "part").select("p_partkey", text.has_hint(text.header(F.col("p_type")), ("brass", "economy")).alias("hint"))


@query("F17_context_jaccard", "SELECT c.conv_id, round(100 * len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 2) AS likeness FROM (SELECT conv_id, list(DISTINCT lower(split_part(text, ' ', 1))) FILTER (role = 'user') AS a, list(DISTINCT lower(split_part(text, ' ', 1))) FILTER (role <> 'user') AS b FROM conversations GROUP BY 1) c WHERE a IS NOT NULL AND b IS NOT NULL")
def f17(spark, d):
    word = F.lower(F.split_part("text", F.lit(" "), F.lit(1)))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") == "user", word)).alias("a"), F.collect_set(F.when(F.col("role") != "user", word)).alias("b"))
    return c.where((F.size("a") > 0) & (F.size("b") > 0)).select("conv_id", text.jaccard(F.col("a"), F.col("b")).alias("likeness"))


@query("F18_F30_values_equal", "SELECT o_orderkey, true AS same, o_totalprice::DECIMAL(18,2) = 1 AS one FROM orders")
def f18(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("p"))
    return o.select("o_orderkey", values.values_equal(F.col("p"), F.concat(F.lit("INR "), "p", F.lit("0"))).alias("same"), values.values_equal(F.col("p"), F.lit("1")).alias("one"))


@query("F20_sentences", r"SELECT doc_id, count(*) AS sentences FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', E'\\1\n', 'g'), '\n+')) AS s FROM documents) WHERE s <> '' GROUP BY 1")
def f20(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n+")).alias("s")).where("s <> ''").groupBy("doc_id").agg(F.count("*").alias("sentences"))


@query("F21_F22_amount", "SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2)::DOUBLE AS amount, 'INR' AS currency FROM lineitem")
def f21(spark, d):
    raw = F.concat(F.lit("Rs "), F.format_number("l_extendedprice", 2))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.amount(raw).cast("double").alias("amount"), values.amount_currency(F.concat(F.lit("₹"), F.format_number("l_extendedprice", 2))).alias("currency"))


@query("F25_F26_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderdate AS at, 'date' AS grain FROM orders")
def f25(spark, d):
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "d.M.yyyy"))
    return o.select("o_orderkey", raw.alias("raw")).select("o_orderkey", values.day(F.col("raw")).alias("day"), values.timestamp(F.col("raw")).cast("timestamp_ntz").alias("at"), values.granularity(F.col("raw")).alias("grain"))


@query("F25_timestamps", "SELECT event_id, date_trunc('second', ts) AS at, event_id % 2 = 0 AS assumed FROM events")
def f25b(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return table(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", values.timestamp(F.col("raw")).cast("timestamp_ntz").alias("at"), values.zone_assumed(F.col("raw")).alias("assumed"))


@query("F28_time_fields", "SELECT event_id, 'record_occurs_on' AS meaning, true AS strong FROM events")
def f28(spark, d):
    name = F.concat("event_type", F.lit("_occurred_at"))
    return table(spark, d, "events").select("event_id", text.time_meaning(name).alias("meaning"), text.is_strong_time_field(name).alias("strong"))


@query("F33_S08_hashes", "SELECT doc_id, sha256(text) AS digest, sha256('lang=' || lang || chr(31) || 'source=' || source) AS scope FROM documents")
def f33(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), values.canonical_hash(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")).alias("scope"))


@query("F34_R18_integrity", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing_expected' WHEN doc_id % 5 = 1 THEN 'mismatch' WHEN doc_id % 5 = 2 THEN 'unsupported' ELSE 'match' END AS state FROM documents")
def f34(spark, d):
    from tracewell.operators.rules import hash_status

    have, k = F.sha2("text", 256), F.col("doc_id") % 5
    want = F.when(k == 1, F.sha2(F.concat("text", F.lit("x")), 256)).when(k == 2, "abc").when(k > 2, F.upper(have))
    return table(spark, d, "documents").select("doc_id", hash_status(have, want).alias("state"))


@query("F38_F39_contains", "SELECT doc_id, contains(lower(text), 'the') AS found FROM documents")
def f38(spark, d):
    return table(spark, d, "documents").select("doc_id", F.contains(F.lower("text"), F.lit("the")).alias("found"))


@query("F40_F48_numbers", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]{2,}'))) AS numbers FROM documents")
def f40(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{2,})"), F.lit(1)))).cast("long").alias("numbers"))


@query("F45_S25_relevance", "SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'les')::INT) / 3 AS relevance FROM documents ORDER BY relevance DESC, doc_id LIMIT 4")
def f45(spark, d):
    tokens = F.array(F.lit("the"), F.lit("und"), F.lit("les"))
    return table(spark, d, "documents").select("doc_id", text.keyword_relevance(tokens, F.col("text")).alias("relevance")).orderBy(F.desc("relevance"), "doc_id").limit(4)


@query("A32_R19_scripts", "SELECT doc_id, (length(text) - length(regexp_replace(text, '[A-Za-zÀ-ɏ]', '', 'g')))::INT AS latin, 0 AS devanagari, (length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::INT AS digits, (length(text) - length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')))::INT AS spaces, length(regexp_replace(text, '[A-Za-zÀ-ɏ0-9 \\t\\r\\n]', '', 'g'))::INT AS other FROM documents")
def a32(spark, d):
    return table(spark, d, "documents").select("doc_id", *text.script_counts(F.col("text")))


@query("R11_url_structure", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, greatest(0, len(string_split(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '.')) - 2)::INT AS depth, CASE WHEN contains(url, '?') THEN len(string_split(split_part(split_part(url, '?', 2), '#', 1), '&')) ELSE 0 END::INT AS query_tokens, contains(url, '@') AS userinfo FROM pages")
def r11(spark, d):
    u = F.col("url")
    host, q = F.try_parse_url(u, F.lit("HOST")), F.try_parse_url(u, F.lit("QUERY"))
    return table(spark, d, "pages").select("page_id", F.try_parse_url(u, F.lit("PROTOCOL")).alias("scheme"), host.alias("host"), F.greatest(F.lit(0), F.size(F.split(host, "[.]")) - 2).alias("depth"), F.when(q.isNotNull(), F.size(F.split(q, "&"))).otherwise(0).alias("query_tokens"), F.try_parse_url(u, F.lit("USERINFO")).isNotNull().alias("userinfo"))


@query("R12_url_extraction", r"""SELECT page_id, len(list_distinct(list_transform(regexp_extract_all(html, 'https?://[^\s<>"'']+'), lambda x: rtrim(x, '.,;:!')))) AS urls FROM pages""")
def r12(spark, d):
    found = F.transform(F.regexp_extract_all("html", F.lit("(" + text.URL + ")"), F.lit(1)), lambda x: F.regexp_replace(x, "[.,;:!]+$", ""))
    return table(spark, d, "pages").select("page_id", F.size(F.array_distinct(found)).cast("long").alias("urls"))


@query("A25_R14_history", "SELECT h AS host, count(*) AS visits, min(page_id) AS first_page, max(page_id) AS last_page, count(DISTINCT s) = 2 AS both_schemes FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS h, regexp_extract(url, '^([a-z]+)', 1) AS s FROM pages) GROUP BY 1")
def a25(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("PROTOCOL")).alias("s"))
    return rows.groupBy("host").agg(F.count("*").alias("visits"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"), (F.count_distinct("s") == 2).alias("both_schemes"))


@query("A26_R16_log_summary", "SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'notice' ELSE 'info' END AS severity, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def a26(spark, d):
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "notice").otherwise("info")
    return table(spark, d, "events").groupBy(severity.alias("severity")).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))

"""Normalisers and parsers on hand-made values: valid, invalid, boundary, null."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text, values


def one(spark, f, raw, *types):
    return spark.createDataFrame([(raw,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "f, raw, want",
    [
        (text.phone, "+91 98765-43210", "919876543210"), (text.phone, "098765 43210", "919876543210"), (text.phone, "123456", None), (text.phone, "1234567", "1234567"), (text.phone, "0000", None), (text.phone, "1" * 16, None), (text.phone, None, None),
        (text.vehicle, "ka-01 ab 1234", "KA01AB1234"), (text.vehicle, "ABCD", None), (text.vehicle, "1234", None), (text.vehicle, "A12", None),
        (text.account, "12 34-56", "123456"), (text.account, "12345", None), (text.document, "1234 5678 9012", "123456789012"), (text.document, "ab-12345", "AB12345"), (text.document, "ab1", None),
        (text.person, "Mr. Dr Priya  Sharma,", "priya sharma"), (text.person, "Mr. Dr.", None), (text.organization, "The Acme Pvt. Ltd.", "acme"), (text.organization, "Company", None), (text.organization, "Cocoa Co", "cocoa"),
        (text.plain, " New  Delhi! ", "new delhi"), (text.plain, "!!", None), (text.header, " Account No. ", "account_no"), (text.domain, "https://www.A.example.com:80/x", "a.example.com"), (text.domain, "x@mail.example.org", "mail.example.org"), (text.domain, "localhost", None),
        (text.transaction, "txn-sih-001", "TXNSIH001"), (text.transaction, "ab", None), (text.reference, " ab-1.2 c ", "AB12C"), (text.identifier, "UTR/1", "utr1"),
        (text.unkeyed_kind, " a@b.co ", "email"), (text.unkeyed_kind, "http://x.y/z", "url"), (text.unkeyed_kind, "+91 98765 43210", "phone"), (text.unkeyed_kind, "1" * 30, None), (text.unkeyed_kind, "word", None),
        (text.status_class, "SUCCESS", "completed"), (text.status_class, "in progress", "pending"), (text.status_class, "unpaid", "completed"), (text.status_class, "payment declined", "rejected"), (text.status_class, "", "unknown"), (text.status_class, None, "unknown"), (text.status_class, "xyz", "unknown"),
        (text.time_meaning, "uploaded_at", "uploaded"), (text.time_meaning, "txn_date", "record_occurs_on"), (text.time_meaning, "created_time", "document_created"), (text.time_meaning, "x", "record_occurs_on"),
        (values.amount, "INR 4,500.50", "4500.5000000000"), (values.amount, "₹4500", "4500.0000000000"), (values.amount, "abc", None), (values.amount, "", None), (values.amount, "-12", "-12.0000000000"), (values.amount, "1.2.3", None),
        (values.amount_currency, "₹4500", "INR"), (values.amount_currency, "usd 3", "USD"), (values.amount_currency, "3", None),
        (values.granularity, "2024-02-30", None), (values.granularity, "29/02/2024", "date"), (values.granularity, "2024-01-02T03:04", "datetime"), (values.granularity, "TBD", None),
    ],
)
def test_values(spark, f, raw, want):
    got = one(spark, f, raw)
    assert (str(got) if got is not None else None) == want


def test_times(spark):
    rows = [("2024-03-01T10:00:00+05:30", "2024-03-01 04:30:00"), ("2024-03-01T10:00:00Z", "2024-03-01 10:00:00"), ("2024-03-01 10:00", "2024-03-01 10:00:00"), ("1/3/2024 10:05", "2024-03-01 10:05:00"), ("01.03.2024", "2024-03-01 00:00:00"), ("soon", None)]
    df = spark.createDataFrame(rows, "v string, want string").select("want", values.timestamp(F.col("v")).cast("string").alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_hints_are_whole_tokens(spark):
    df = spark.createDataFrame([("statement",), ("txn_state",), ("state",), ("ref_no",), ("txn_ref_no",), ("refno",)], "v string")
    assert [r[0] for r in df.select(text.has_hint(F.col("v"), ("state", "ref_no"))).collect()] == [False, True, True, True, True, False]


def test_blocks_and_sets(spark):
    df = spark.createDataFrame([("person", "priya sharma"), ("person", "priya"), ("phone", "919"), ("document", "ABCDEFGH"), ("location", "delhi")], "k string, v string")
    assert [r[0] for r in df.select(text.blocking_key(F.col("k"), F.col("v"))).collect()] == ["sha_p", "priy", "919", "ABCDEF", "delh"]
    s = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in s.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [33.33, 0.0]


def test_hash_and_equality(spark):
    df = spark.createDataFrame([({"a": "1", "b": None}, {"b": None, "a": "1"}, "1,000.0", "INR 1000", "01/02/2024", "2024-02-01", " A  b", "a B")], "x map<string,string>, y map<string,string>, p string, q string, r string, s string, t string, u string")
    r = df.select(values.canonical_hash(F.col("x")) == values.canonical_hash(F.col("y")), *[values.values_equal(F.col(a), F.col(b)) for a, b in ("pq", "rs", "tu", "pt")]).first()
    assert list(r) == [True, True, True, True, False]

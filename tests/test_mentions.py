"""Recognisers, overlaps and packed fields on the cases that matter."""

from pyspark.sql import functions as F

from tracewell.operators import mentions


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return mentions.recognised(df, "t", ["k"])


def test_recognisers(spark):
    texts = ["Suspect contacted 9876543210 from Mumbai.", "Car MH12AB1234 spotted at Mall Road", "Card 1234 5678 9012 seen", "220044001122", "Transfer made from account 220044001122 confirmed.", "Passport BJ1234567 details verified", None, "", "é +91 98765 43210; XMH12AB1234x", "a/c # AB-12 34.5 was used", "Account no: 12", "phone 12345"]
    got = {}
    for r in found(spark, texts).collect():
        got.setdefault(r["k"], []).append((r["recogniser"], r["canonical"], r["start"], r["stop"]))
        assert texts[r["k"]][r["start"] : r["stop"]].endswith(r["raw"])
    assert got == {
        0: [("phone", "919876543210", 18, 28)], 1: [("vehicle", "MH12AB1234", 4, 14)], 2: [("grouped_document", "123456789012", 5, 19)],
        4: [("labelled_account", "220044001122", 19, 39)], 5: [("labelled_document", "BJ1234567", 0, 18)], 8: [("phone", "919876543210", 2, 17)], 9: [("labelled_account", "AB12345", 0, 16)],
    }


def test_overlaps_go_to_the_better_recogniser(spark):
    rows = found(spark, ["account 2200 44001 122 was closed, call 9876543210", "passport 1234 5678 9012 and 1234 5678 9013", "Account 98765 43210"])
    assert {(r["k"], r["recogniser"]) for r in rows.collect()} >= {(0, "phone"), (1, "grouped_document"), (2, "phone")}
    kept = [(r["k"], r["recogniser"], r["canonical"]) for r in mentions.settled(rows, ["k"]).orderBy("k", "start").collect()]
    assert kept == [(0, "labelled_account", "220044001122"), (0, "phone", "919876543210"), (1, "labelled_document", "123456789012"), (1, "grouped_document", "123456789013"), (2, "labelled_account", "9876543210")]


def test_fields_and_first_mentions(spark):
    rows = [(1, {"phone": "9876543210 9123456789", "misc_notes": "nothing", "Suspect Name": "Dr. A B"}), (2, {"Mobile": "12|9876543210;1234567890123456", "note": "call 9876543210 or 9123456780, 9123456780"}), (3, {"phone": " ", "text": None}), (4, None)]
    df = spark.createDataFrame(rows, "k int, raw map<string,string>")
    got = sorted((r["k"], r["entity_type"], r["raw"], r["canonical"]) for r in mentions.field_mentions(df, F.col("raw"), ["k"]).collect())
    assert got == [(1, "person", "Dr. A B", "a b"), (1, "phone", "9123456789", "919123456789"), (1, "phone", "9876543210", "919876543210"), (2, "phone", "9876543210", "919876543210")]
    both = {(r["k"], r["canonical"]): (r["source"], r["start"], r["blocking_key"]) for r in mentions.record_mentions(df, F.col("raw"), ["k"]).collect()}
    assert both[2, "919876543210"] == ("field", None, "919876543210") and both[2, "919123456780"] == ("rule", 19, "919123456780") and len(both) == 5

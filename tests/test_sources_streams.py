"""Readers on small files, streams against batch, and the driver contract."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracewell.sources import files
from tracewell.streaming import telemetry


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"x, y"\n , \n2,\n')
    got = [(r["record_no"], r["raw"]) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert got == [(1, {"id": "1", "note": "x, y"}), (2, {"id": "2", "note": ""})]
    (tmp_path / "a.txt").write_text("one\ntwo\n\n\n\nthree\n")
    assert [(r["record_no"], r["text"].strip()) for r in files.read_text(spark, str(tmp_path / "a.txt")).collect()][0] == (1, "one\ntwo")
    for k, (body, n) in enumerate([([{"a": 1}, 5, "x"], 3), ({"rows": [{"a": 1}]}, 1), ({"a": {"b": 2}}, 1)]):
        (tmp_path / f"{k}.json").write_text(json.dumps(body))
        rows = files.read_json(spark, str(tmp_path / f"{k}.json")).orderBy("record_no").collect()
        assert len(rows) == n
        if k == 0:
            assert [json.loads(r["raw"]) for r in rows] == [{"a": 1}, {"value": 5}, {"value": "x"}]


def test_format(spark):
    df = spark.createDataFrame([("a.CSV", ""), ("x", "%PDF-1.4"), ("x", ' {"a":1}'), ("x", "a,b,c\n1,2,3"), ("x", "words"), ("x", "<html>")], "p string, h string")
    assert [r[0] for r in df.select(files.sniffed(F.col("p"), F.col("h"))).collect()] == ["csv", "pdf", "json", "csv", "txt", "html"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k % 3} 00:{k % 60:02}:00", k % 4, "error" if k % 2 else "view") for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    stream = telemetry.events(spark, str(tmp_path / "events.parquet"))
    got = {r["user_id"]: r["n"] for r in telemetry.drained(telemetry.last_seen(stream, "user_id"), "complete", spark).collect()}
    assert got == {k: 10 for k in range(4)}
    locks = telemetry.drained(telemetry.lockouts(stream.where("event_type = 'error'"), "user_id", 30, 100), "update", spark)
    assert {r["user_id"]: (r["failures"], r["lock_s"]) for r in locks.collect()} == {1: (10, 100), 3: (10, 100)}
    seen = telemetry.drained(telemetry.once(stream, "event_type", "10 days"), "append", spark)
    assert seen.count() == 2


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["case_id", "entity_id", "n", "rank"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Streams with state that ends, replayed in several batches with gaps, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.operators import triage
from tracewell.streaming import stateful, telemetry

START = datetime(2024, 1, 1)


def arrivals(spark, tmp_path, rows, cuts):
    """rows: seq, user, seconds, what. One file for each batch; in a batch rows come in any order."""
    rnd, at = random.Random(1), 0
    for k, end in enumerate([*cuts, len(rows)]):
        part = rows[at:end]
        rnd.shuffle(part)
        df = spark.createDataFrame([(i, u, START + timedelta(seconds=s), w) for i, u, s, w in part], "seq long, user string, ts timestamp, what string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"b{k}"))
        at = end
    return spark.readStream.schema("seq long, user string, ts timestamp, what string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b*"))


def made(n=120, seed=4):
    rnd, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rnd.choice((1, 5, 20, 70, 400))
        out.append((i, rnd.choice("abc"), t, "success" if rnd.random() < 0.1 else "failed"))
    return [*out, (n, "z", t + 100_000, "failed")]  # moves the watermark past all others


@pytest.fixture
def utc(spark):
    return spark


def test_locks_end(utc, tmp_path):
    rows = made()
    df = arrivals(utc, tmp_path, rows, [30, 31, 80])
    got = {r["seq"]: (r["failures"], r["until"]) for r in telemetry.drained(stateful.locks(df, "user", "seq", "what", 30, 200, "1 second"), "append", utc).collect()}
    state, want = {}, {}
    for i, u, s, w in rows[:-1]:
        if w == "success":
            state.pop(u, None)
            continue
        n, until = state.get(u, (0, 0))
        n = n + 1 if s < until else 1
        state[u] = (n, s + min(200, 30 * 2 ** min(n - 1, 10)))
        want[i] = (n, START + timedelta(seconds=state[u][1]))
    assert got == want and len({n for n, _ in want.values()}) > 3


def test_bursts_slide(utc, tmp_path):
    rows = made(seed=6)
    df = arrivals(utc, tmp_path, rows, [10, 60, 61])
    got = {r["user"]: (r["start"], r["n"]) for r in telemetry.drained(stateful.bursts(df, "user", "seq", 600, 5, "1 second"), "append", utc).collect()}
    want = {}
    for u in "abc":
        own = [s for _, x, s, _ in rows if x == u]
        hit = next(((s, n) for s in own if (n := sum(s <= t <= s + 600 for t in own)) >= 5), None)
        if hit:
            want[u] = (START + timedelta(seconds=hit[0]), hit[1])
    assert got == want and want


def test_illegal_steps_are_put_aside(utc, tmp_path):
    rnd = random.Random(2)
    cycle = stateful.LIFE_CYCLES["hypothesis"]
    rows = [(i, rnd.choice("pq"), 10 * i, rnd.choice(sorted(cycle))) for i in range(60)] + [(60, "z", 10_000, "proposed")]
    df = arrivals(utc, tmp_path, rows, [7, 40])
    got = {r["seq"]: (r["old"], r["new"], r["legal"]) for r in telemetry.drained(stateful.steps(df, "user", "seq", "what", cycle, "proposed", "1 second"), "append", utc).collect()}
    now, want = {}, {}
    for i, u, _, w in rows[:-1]:
        old = now.get(u, "proposed")
        legal = w == old or w in cycle[old]
        want[i] = (old, w, legal)
        now[u] = w if legal else old
    assert got == want and {x[2] for x in want.values()} == {True, False}
    assert all(y in c for c in stateful.LIFE_CYCLES.values() for x in c.values() for y in x)
    assert df.where(F.lit(False)).isStreaming


def test_incremental_runs_and_a_replay(spark, tmp_path):
    schema, src = "key string, ts timestamp, v int", str(tmp_path / "src")
    arrive = lambda rows: spark.createDataFrame([(k, START + timedelta(seconds=s), v) for k, s, v in rows], schema).coalesce(1).write.mode("append").parquet(src)
    review = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string").write.mode("append").parquet(str(tmp_path / "seen"))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    run = lambda m=marks: telemetry.incremental(spark.readStream.schema(schema).parquet(src), "key", str(tmp_path / "seen"), out, m)
    found = lambda: sorted((r["key"], r["v"]) for r in spark.read.parquet(out).collect())
    review(["r"])
    arrive([("a", 2, 1), ("a", 1, 2), ("r", 1, 3), ("b", 1, 4)])
    run()
    assert found() == [("a", 2), ("b", 4)]
    review(["c"])  # reviewed in the meantime
    arrive([("a", 0, 5), ("c", 1, 6), ("d", 1, 7)])
    run()
    run()
    want = [("a", 2), ("b", 4), ("d", 7)]
    assert found() == want
    run(str(tmp_path / "lost"))  # marks were lost: batch 0 comes again, with all rows
    assert sorted(k for k, _ in found()) == [k for k, _ in want]


def test_log_lines(spark):
    body = "2024-01-05T10:00:00Z sshd[12]: FAILED password for root\n\n2024-01-05 10:00 (web) info started\r\nno time error\n2024-01-05 10:00:01 quiet\n2024-13-45 10:00:00 warn: 77 -x denied"
    df = spark.createDataFrame([(1, body), (2, None)], "k int, body string")
    got = [(r["line_no"], r["severity"], r["source"], r["auth_failure"], r["at"] is None) for r in triage.log_lines(df, ["k"]).orderBy("line_no").collect()]
    assert got == [(1, "error", "password", True, False), (3, "info", "web", False, False), (6, "warning", "unknown", False, True)]
    lines = spark.createDataFrame([("e", i, START + timedelta(seconds=100 * i + (5000 if i == 0 else 0)), i != 3) for i in range(12)], "e string, r int, at timestamp, auth_failure boolean")
    assert [tuple(r) for r in triage.log_observations(lines, "e", "r").collect()] == [(1, "log.auth_failure_burst", "6")]

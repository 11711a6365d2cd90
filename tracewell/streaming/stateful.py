"""Keyed state over event streams that ends: locks, sliding bursts, life cycles.

Rows of a key wait in list state until the watermark has passed them, and are then folded into the key's value state
in the order of event time, so results don't depend on how rows arrive within the watermark's delay, nor on how batches
are cut. Event-time timers wake a key when a waiting row is due or when its state has run out; a key whose state has
run out and that has no row waiting has no state any more. Rows behind the watermark are dropped by Spark.

State is kept by Spark's RocksDB store (``with_rocksdb``), which timers and list state ask for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Steps of each life cycle: from a state to those that may follow it. Fixed values.
LIFE_CYCLES = {
    "user": {"pending": ("active", "rejected"), "active": ("suspended",), "suspended": ("active", "rejected"), "rejected": ()},
    "hypothesis": {"proposed": ("under_review", "dismissed"), "under_review": ("supported", "contradicted", "dismissed"), "supported": ("concluded", "contradicted"), "contradicted": ("under_review", "dismissed"), "dismissed": ("proposed",), "concluded": ("proposed",)},
    "job": {"pending": ("running", "failed", "canceled"), "running": ("succeeded", "partial", "failed", "canceled"), "succeeded": (), "partial": (), "failed": (), "canceled": ()},
    "finding": {"NEW": ("REVIEWED", "DISMISSED", "CONFIRMED"), "REVIEWED": ("DISMISSED", "CONFIRMED"), "DISMISSED": (), "CONFIRMED": ()},
    "case": {"open": ("in_progress", "closed"), "in_progress": ("open", "closed"), "closed": ("open", "in_progress"), "archived": ()},
}


def with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Ordered(StatefulProcessor):
    """Folds the rows (at: microseconds, seq, what) of a key in order. Subclasses say what is kept and what comes out."""

    kept = "none boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, what string")
        self.state = handle.getValueState("state", self.kept)

    def fold(self, key: tuple, state: tuple | None, rows: list[tuple], now: int) -> tuple[tuple | None, list[Row]]:
        """The new state, or None, and what comes out. now: microseconds before which all rows are there."""
        raise NotImplementedError

    def ends(self, state: tuple) -> int | None:
        """When the state wants to be looked at again, in microseconds."""
        raise NotImplementedError

    def _wake(self, at: int, now_ms: int) -> None:
        self.handle.registerTimer(max(at // 1000 + 1, now_ms + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], r["seq"], r["what"]) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(at for at, *_ in new), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if r[0] // 1000 < now_ms]
        rest = rows[len(due) :]
        state, out = self.fold(key, tuple(self.state.get()) if self.state.exists() else None, due, now_ms * 1000)
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        again = [t for t in (rest[0][0] if rest else None, self.ends(state) if state else None) if t is not None]
        if again:
            self._wake(min(again), now_ms)
        return iter(out)

    def close(self) -> None:
        pass


class Locks(Ordered):
    """Failures so far and the end of the lock, which doubles with each failure; it ends with time or with a success."""

    kept = "failures long, until long"

    def __init__(self, base: int, most: int):
        self.base, self.most = base, most

    def fold(self, key, state, rows, now):
        out = []
        for at, seq, what in rows:
            if what == "success":
                state = None
                continue
            n = (state[0] if state and at < state[1] else 0) + 1
            state = (n, at + 1_000_000 * min(self.most, self.base * 2 ** min(n - 1, 10)))
            out.append(Row(key=key[0], seq=seq, at=at, failures=n, until=state[1]))
        return (None if state and state[1] <= now else state), out

    def ends(self, state):
        return state[1]


class Bursts(Ordered):
    """The first time from which at least ``least`` rows lie within ``window`` seconds, and their number."""

    kept = "times array<long>, fired boolean"

    def __init__(self, window: int, least: int):
        self.window, self.least = window * 1_000_000, least

    def fold(self, key, state, rows, now):
        times, fired = ([*state[0]], state[1]) if state else ([], False)
        if fired:
            return (([], True), [])
        times += [at for at, *_ in rows]
        k = 0
        while k < len(times) and times[k] + self.window < now:
            n = bisect_right(times, times[k] + self.window) - k
            if n >= self.least:
                return ([], True), [Row(key=key[0], at=times[k], n=n)]
            k += 1
        return ((times[k:], False) if times[k:] else None), []

    def ends(self, state):
        return state[0][0] + self.window if state[0] else None


class Steps(Ordered):
    """Each row's step from the state before it; a step that the life cycle lacks is put aside and changes nothing.

    A key begins in the state ``first``. What it is in stays as long as it is one that has further steps.
    """

    kept = "now string"

    def __init__(self, steps: dict[str, tuple[str, ...]], first: str):
        self.steps, self.first = steps, first

    def fold(self, key, state, rows, now):
        at_, out = state[0] if state else self.first, []
        for at, seq, what in rows:
            legal = what == at_ or what in self.steps.get(at_, ())
            out.append(Row(key=key[0], seq=seq, at=at, old=at_, new=what, legal=legal))
            at_ = what if legal else at_
        return (at_,), out

    def ends(self, state):
        return None


def _folded(df: DataFrame, key: str, seq: str, what: str, late: str, processor: Ordered, out: str) -> DataFrame:
    rows = df.withWatermark("ts", late).select(F.col(key).alias("key"), F.unix_micros("ts").alias("at"), F.col(seq).cast("long").alias("seq"), F.col(what).alias("what"), "ts")
    return rows.groupBy("key").transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def _time(c: str):
    return F.timestamp_micros(F.col(c))


def locks(df: DataFrame, key: str, seq: str, what: str, base: int, most: int, late: str) -> DataFrame:
    """key, seq, ts, failures, until: of each failure of ``df`` (ts, ...; ``what``: success, or else a failure) how many are in a row and
    the end of the lock, ``base`` seconds doubled for each up to ``most``. A counter begins anew when its lock has ended.
    """
    with_rocksdb(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    got = _folded(df, key, seq, what, late, Locks(base, most), f"key {kind}, seq long, at long, failures long, until long")
    return got.select(F.col("key").alias(key), "seq", _time("at").alias("ts"), "failures", _time("until").alias("until"))


def bursts(df: DataFrame, key: str, seq: str, window: int, least: int, late: str) -> DataFrame:
    """key, start, n: of each key the first event (ts) from which at least ``least`` lie within ``window`` seconds, once all of these are there."""
    with_rocksdb(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    got = _folded(df.withColumn("_what", F.lit("")), key, seq, "_what", late, Bursts(window, least), f"key {kind}, at long, n long")
    return got.select(F.col("key").alias(key), _time("at").alias("start"), "n")


def steps(df: DataFrame, key: str, seq: str, what: str, cycle: dict[str, tuple[str, ...]], first: str, late: str) -> DataFrame:
    """key, seq, ts, old, new, legal: the steps of each key through a life cycle; steps that are not legal change nothing."""
    with_rocksdb(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    got = _folded(df, key, seq, what, late, Steps(cycle, first), f"key {kind}, seq long, at long, old string, new string, legal boolean")
    return got.select(F.col("key").alias(key), "seq", _time("at").alias("ts"), "old", "new", "legal")

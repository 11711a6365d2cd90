"""Mixture-controlled packing of token streams into windows.

Each source is a queue of documents (ascending doc_id), cut into quanta of QUANTUM ids. Deficit
round-robin serves the queues in rounds of one window: a round adds to each queue's counter its share
of WINDOW ids, and the queue gives quanta as long as its counter covers them; what is left of the
counter is carried into the next round. The counter after r rounds and i quanta is
``r * share - i * QUANTUM``, so the round of each quantum, and with it its place among all quanta, is
a sum over queues: tasks compute the places of their own documents, nothing is simulated in
sequence, and deficits carry across windows and partitions.

Up to TABLE queues their totals are sent to the tasks. Beyond that, Spark counts the quanta of each
(round, queue) and sums them in order; the places are the same. A document gives at most a row for each
of its quanta there, however many rounds lie between them. Weights are rounded to RESOLUTION parts of the
mixture, at least one each: with more sources than that all of the smallest get equal shares.

The stream of all quanta, and after it the rests of the queues (under one quantum each), is cut into
windows; what the last, partial window holds is cut into sequences whose sizes are powers of two, so
no sequence has padding. Quanta of a document that follow each other in the stream are one piece.

Defined results: a null text is the empty one, and a document is never empty since ``end_id`` ends
it; a null source is a queue of its own; repeated rows are documents of their own; an empty table
packs to nothing; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import in_arrow, running_start, staged
from tracewell.llm.tokens import encoder, width_of

WINDOW, QUANTUM = 1024, 128
#: Queues whose totals are sent to the tasks.
TABLE = 4096
#: Pieces, of at most WINDOW ids, that a task sends at once.
PIECES = 4000
#: Level at which the ids of a document are compressed for the shuffle and the folder.
LEVEL = 6
#: Weights are rounded to this total, so that products stay well below 2**63.
RESOLUTION = 1 << 20


class Schedule:
    """Places of quanta. totals: ids of each queue; weights: target shares, by default the totals."""

    def __init__(self, totals: list[int], weights: list[int] | None = None, window: int = WINDOW, quantum: int = QUANTUM):
        self.quantum, self.per = quantum, window // quantum
        self.full = np.array([t // quantum for t in totals], np.int64)
        self.weight = np.array(scaled(weights or totals), np.int64)
        self.round = int(self.weight.sum())
        self.slots = int(self.full.sum())
        self.rest_at = np.cumsum([0, *(t % quantum for t in totals)])[:-1] + self.slots * quantum if totals else np.zeros(0, np.int64)

    def place(self, queue: int, i: np.ndarray) -> np.ndarray:
        """How many quanta are served before quanta ``i`` of a queue."""
        w = int(self.weight[queue])
        # the round whose credit first covers i + 1 quanta
        rounds, which = np.unique(-(-(i + 1) * self.round // (self.per * w)), return_inverse=True)
        before = np.zeros(len(rounds), np.int64)
        for s, (ws, n) in enumerate(zip(self.weight.tolist(), self.full.tolist())):
            if s != queue:  # in a round, queues come up in their order
                before += np.minimum(n, self.per * ws * (rounds - (s > queue)) // self.round)
        return before[which] + i

    def runs(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Stretches of documents of ``n`` ids at positions ``at`` of their queues, as arrays: document
        (its place in the arguments), start in it, length, position in the stream.
        """
        q, first = self.quantum, at // self.quantum
        many = (at + n - 1) // q - first + 1
        doc = np.repeat(np.arange(len(n)), many)
        i = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        begin, end = np.maximum(i * q, at[doc]), np.minimum((i + 1) * q, (at + n)[doc])
        full = i < self.full[queue][doc]
        to = self.rest_at[queue[doc]] + begin - i * q
        for k in np.unique(queue):
            own = full & (queue[doc] == k)
            to[own] = self.place(int(k), i[own]) * q + begin[own] - i[own] * q
        return doc, begin - at[doc], end - begin, to


def scaled(weights: list[int]) -> list[int]:
    """Weights of the same proportions with a total of about RESOLUTION, each at least 1."""
    total = max(1, sum(weights))
    return [max(1, w * RESOLUTION // total) for w in weights]


def windows(doc: np.ndarray, start: np.ndarray, length: np.ndarray, to: np.ndarray, total: int, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Stretches at positions ``to`` of a stream of ``total`` ids, by document and start, cut into pieces: document,
    start, length, sequence, offset. Stretches that follow each other are one.
    """
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (to[1:] != to[:-1] + length[:-1])
    head = np.flatnonzero(new)
    doc, start, length, to = doc[head], start[head], np.add.reduceat(length, head) if len(head) else length, to[head]
    first = to // window
    many = (to + length - 1) // window - first + 1
    own = np.repeat(np.arange(len(doc)), many)
    k = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    a, b = np.maximum(to[own], k * window), np.minimum((to + length)[own], (k + 1) * window)
    last = k == total // window  # the partial window
    out = [doc[own], start[own] + a - to[own], b - a, k, a - k * window]
    more, ends, rest = [], [], total % window
    while rest:  # ends of its sequences
        ends.append((ends[-1] if ends else 0) + (1 << rest.bit_length() - 1))
        rest -= 1 << rest.bit_length() - 1
    for d, s, n, w, at in zip(*(x[last].tolist() for x in out)):
        while n:
            j = int(np.searchsorted(ends, at, "right"))
            m = min(n, ends[j] - at)
            more.append((d, s, m, w + j, at - (ends[j - 1] if j else 0)))
            s, n, at = s + m, n - m, at + m
    return tuple(np.concatenate([x[~last], np.array(y, np.int64)]) for x, y in zip(out, zip(*more) if more else [[]] * 5))


def _encoded(path: str, end_id: int):
    enc = encoder(path)
    width, codec = width_of(enc, end_id), pa.Codec("zstd", compression_level=LEVEL)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, starts = enc.encode_all(batch["text"], end_id)
        n, data = len(starts) - 1, memoryview(ids.astype(f"<u{width}")).cast("B")
        for at in range(0, n, 1000):  # Spark reads the batches row by row: small ones
            to, s = min(n, at + 1000), starts[at : at + 1001]
            own = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(((s - s[0]) * width).astype(np.int32)), pa.py_buffer(data[int(s[0]) * width : int(s[-1]) * width])])
            small = [codec.compress(x.as_buffer(), asbytes=True) for x in own]
            yield {c: batch[c].slice(at, to - at) for c in ("rid", "doc_id", "source")} | {"n": np.diff(s), "width": [width] * (to - at), "ids": small}

    return run


def _pieces(schedule: Schedule | None, order: dict, total: int, with_ids: bool):
    """Pieces of documents whose stretches are given, or follow from a schedule and their places in the queues."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        n, width = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "width"))
        if schedule:
            queue = np.array([order[q] for q in batch["queue"].to_pylist()], np.int64)
            runs = schedule.runs(queue, batch["at"].to_numpy(zero_copy_only=False), n)
        else:
            got = batch["runs"]
            x = pa.RecordBatch.from_struct_array(got.flatten())
            doc = np.repeat(np.arange(len(n)), np.diff(np.asarray(got.offsets)))
            runs = (doc, *(x[c].to_numpy(zero_copy_only=False) for c in ("start", "length", "to")))
        doc, start, length, sequence, offset = windows(*runs, total)
        raw = (pa.decompress(x, decompressed_size=m * w, codec="zstd", asbytes=True) for x, m, w in zip(batch["ids"].to_pylist(), n.tolist(), width.tolist()))
        data = [memoryview(np.frombuffer(x, f"<u{w}").astype("<u4")).cast("B") for x, w in zip(raw, width.tolist())]
        for k in range(0, len(doc), PIECES):
            d, s, m = (x[k : k + PIECES] for x in (doc, start, length))
            own = [data[i][4 * a : 4 * (a + b)] for i, a, b in zip(d.tolist(), s.tolist(), m.tolist())]
            out = {"doc_id": batch["doc_id"].take(pa.array(d)), "start": s, "length": m, "ids_crc32": list(map(zlib.crc32, own)), "doc_tokens": n[d], "sequence_id": sequence[k : k + PIECES], "offset": offset[k : k + PIECES]}
            yield out | ({"source": batch["source"].take(pa.array(d)), "ids": list(map(bytes, own))} if with_ids else {})

    return run


def _whole(a: Column, b: Column) -> Column:
    """Integer division, exact."""
    return F.call_function("div", a, b)


def _ranked_runs(slim: DataFrame, totals: DataFrame) -> DataFrame:
    """rid and runs (array of start, length, to) of ``slim`` (rid, queue, at, n): the places of Schedule, by
    counts of quanta of each (round, queue). totals: queue, q (its number), n, weight.
    """
    each, slots = totals.agg(F.sum("weight"), F.sum(F.floor(F.col("n") / QUANTUM))).first()
    per, q = WINDOW // QUANTUM, QUANTUM
    totals = totals.withColumns({"full": F.expr(f"n div {q}"), "rest": F.col("n") % q})
    totals = staged(running_start(staged(totals, "queues"), ["q"], "rest", "rest_at"), "queues").select("queue", "q", "full", "weight", "rest_at")
    rows = slim.join(totals, "queue").withColumn("end", F.col("at") + F.col("n"))

    def served(r: Column) -> Column:
        return F.least(F.col("full"), _whole(r * per * F.col("weight"), F.lit(each)))

    def turn(i: Column) -> Column:
        w = F.col("weight") * per
        return _whole((i + 1) * F.lit(each) + w - 1, w)

    first, last = F.expr(f"at div {q}"), F.least(F.expr(f"(end - 1) div {q}"), F.col("full") - 1)
    # a row for each round in which quanta of the document are served, not for each round between them
    turns = rows.where(first <= last).withColumn("turn", F.explode(F.array_distinct(F.transform(F.sequence(first, last), turn))))
    turns = turns.withColumns({"lo": served(F.col("turn") - 1), "hi": served(F.col("turn"))}).where("hi > lo")
    counts = staged(turns.select("turn", "q", (F.col("hi") - F.col("lo")).alias("many")).distinct(), "turns")
    base = running_start(counts, ["turn", "q"], "many", "base").select("turn", "q", "base")
    begin, end = F.greatest(F.col("lo") * q, F.col("at")), F.least(F.col("hi") * q, F.col("end"))
    turns = turns.join(base, ["turn", "q"]).select("rid", (begin - F.col("at")).alias("start"), (end - begin).alias("length"), (F.col("base") * q + begin - F.col("lo") * q).alias("to")).where("length > 0")
    begin = F.greatest(F.col("full") * q, F.col("at"))
    rests = rows.where(F.col("end") > F.col("full") * q).select("rid", (begin - F.col("at")).alias("start"), (F.col("end") - begin).alias("length"), (F.lit(slots or 0) * q + F.col("rest_at") + begin - F.col("full") * q).cast("long").alias("to"))
    return turns.union(rests).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "length", "to"))).alias("runs"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, weights: dict[str, int] | None = None, with_ids: bool = True, table: int = TABLE) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text, source): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with_ids, source and ids (little-endian unsigned 32-bit integers).

    weights: a source's target share, as an integer (1 where it is not named); by default its share
    of all ids. One shuffle of the ids; at most ``table`` totals reach the driver and the tasks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    first = staged(in_arrow(rows.withColumn("rid", F.monotonically_increasing_id()), lambda: _encoded(tokenizer, end_id), "rid long, doc_id long, source string, n long, width int, ids binary", 3000), "pack")
    first = first.withColumn("queue", F.to_json(F.struct("source")))
    totals = staged(first.groupBy("queue").agg(F.sum("n").alias("n"), F.first("source").alias("source")), "queues")
    share = F.col("n")
    if weights:
        share = F.coalesce(*[F.when(F.col("source") == k, F.lit(w)) for k, w in weights.items()], F.lit(1))
    totals = totals.withColumn("share", share.cast("long"))
    queues, total, shares = totals.agg(F.count("*"), F.sum("n"), F.sum("share")).first()
    weight = F.greatest(F.lit(1), _whole(F.col("share").cast("decimal(20,0)") * F.lit(RESOLUTION).cast("decimal(8,0)"), F.lit(max(1, shares or 0)).cast("decimal(20,0)"))).cast("long")
    at = running_start(first.select("doc_id", "rid", "queue", "n"), ["doc_id", "rid"], "n", "at", ["queue"])
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", source string, ids binary" if with_ids else "")
    if queues <= table:
        listed = totals.orderBy(F.xxhash64("queue"), "queue").collect()
        schedule = Schedule([r["n"] for r in listed], [r["share"] for r in listed])
        order = {r["queue"]: i for i, r in enumerate(listed)}
        known = first.join(at.select("rid", "at"), "rid")
    else:
        schedule, order = None, {}
        numbered = totals.withColumns({"weight": weight, "h": F.xxhash64("queue"), "one": F.lit(1)})
        numbered = running_start(staged(numbered, "queues"), ["h", "queue"], "one", "q").select("queue", "q", "n", "weight")
        slim = staged(at.select("rid", "queue", "at", "n"), "pack")
        known = first.join(_ranked_runs(slim, staged(numbered, "queues")), "rid")
    return in_arrow(known, lambda: _pieces(schedule, order, total or 0, with_ids), columns, 500)


def sequences(packed: DataFrame) -> DataFrame:
    """Sequences of ``pack``: sequence_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", "n_tokens", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """All of ``documents``, packed to the mixture of their sources."""
    from tracewell.llm.tokens import vocabulary

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(tokenizer), end_id=0, with_ids=False)

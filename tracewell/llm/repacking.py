"""Packing into as few sequences as possible, each part certified by lower bounds.

Documents of over WINDOW ids are cut into pieces of WINDOW, the first of which may be shorter; no other is
cut. Pieces are dealt by hash into parts of about ITEMS. A task packs a part by best fit decreasing and holds
its count of bins against dual-feasible functions of the sizes: such a function never gives the items of one bin
more than 1 in total, so its sum over a part is a lower bound of bins. The families are

  * threshold k: sizes over WINDOW - k count 1, those below k nothing, the others their share;
  * steps of k: a size below half counts as the whole steps of k in it, out of those in a window, and a size over
    half as all of them less those that fit beside it;
  * rounding by k: multiples of 1/(k + 1) keep their share, others are rounded down to multiples of 1/k.

The same functions over the counts of all sizes (at most WINDOW numbers) bound the whole. While the bins of
all parts are more than that, parts whose bins are above their own bound (before it is rounded up) exchange
documents: their full bins are settled, and what is in the others meets in groups of about GROUP parts, dealt anew
in each round, where it is packed as one. A meeting that needs fewer bins replaces what its parts had, else they
stay as they were, so no round makes it worse. Rounds end at the bound, when IDLE rounds in a row gain nothing,
or after ROUNDS. A meeting holds about GROUP * ITEMS slim rows, however large the corpus is; parts that grow in it are
cut again, by whole bins.

Shuffles: slim rows of pieces, once a round, of unfilled bins only. Ids do not move; where they are asked for
they are joined to their pieces once.

Defined results: a null text is the empty one; a document has at least the id that ends it; a null doc_id is
kept; repeated rows are documents of their own; pieces of equal size keep the order of their row ids, so the
result depends on the staged table alone; an empty table packs to nothing; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import in_arrow, staged
from tracewell.llm.tokens import encoder, vocabulary

WINDOW = 1024
#: Pieces of a part, and parts that meet, on average.
ITEMS, GROUP = 4096, 8
#: Rounds of exchange at most, and rounds without gain that end it.
ROUNDS, IDLE = 12, 2

_PIECE = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED = _PIECE + ", part long, bin int, offset long, room int, slack double, certified boolean"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_NAMES, _SCHEMA = ([x.split()[0] for x in _PIECE.split(", ")], pa.schema([(c, _ARROW[t]) for c, t in map(str.split, _PLACED.split(", "))]))
#: Parts of a round are numbered from its multiple of this; bins of a part are below BINS.
_ROUND, _BINS = 1 << 33, 1 << 24


def dual_feasible(window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Dual-feasible functions as integers: a row of values by size (0 to window) for each, and its denominator."""
    x = np.arange(window + 1, dtype=np.int64)
    rows, den = [x], [window]
    for k in range(1, window // 2 + 1):
        rows.append(np.where(x > window - k, window, np.where(x < k, 0, x)))
        den.append(window)
        steps = window // k
        rows.append(np.where(2 * x > window, 2 * (steps - (window - x) // k), np.where(2 * x == window, steps, 2 * (x // k))))
        den.append(2 * steps)
    for k in range(1, 101):
        exact = (k + 1) * x % window == 0
        rows.append(np.where(exact, k * x, (k + 1) * x // window * window))
        den.append(k * window)
    return np.array(rows), np.array(den, np.int64)


class Bounds:
    """Lower bounds of bins. window: the size of a bin."""

    _made: dict[int, "Bounds"] = {}

    def __init__(self, window: int):
        self.window = window
        self.values, self.den = dual_feasible(window)

    @classmethod
    def of(cls, window: int) -> "Bounds":
        if window not in cls._made:
            cls._made[window] = cls(window)
        return cls._made[window]

    def share(self, counts: np.ndarray) -> float:
        """The largest sum of a function, not rounded. counts: of items by size, 0 to window."""
        return float((self.values @ counts / self.den).max())

    def bins(self, counts: np.ndarray) -> int:
        """Bins that these items need at least."""
        return int((-(-(self.values @ counts) // self.den)).max())


def best_fit_decreasing(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what is free in each bin: the largest item first, into the fullest bin that it fits."""
    open_: list[list[int]] = [[] for _ in range(window + 1)]  # bins by what is free
    some, free = 0, []  # bit r: open_[r] has bins
    bins, offsets = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = some >> s
        if fits:
            r = (fits & -fits).bit_length() - 1 + s
            b = open_[r].pop()
            if not open_[r]:
                some ^= 1 << r
        else:
            r, b = window, len(free)
            free.append(window)
        bins[i], offsets[i], free[b] = b, window - r, r - s
        if r > s:
            open_[r - s].append(b)
            some |= 1 << (r - s)
    return bins, offsets, np.array(free, np.int32)


def _cut(path: str, end_id: int, window: int, with_ids: bool):
    """Pieces of documents, each in one task with the ids."""
    enc = encoder(path)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, starts = enc.encode_all(batch["text"], end_id)
        data, n = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.diff(starts)
        many = -(-n // window)
        doc = np.repeat(np.arange(len(n)), many)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        head = (n - (many - 1) * window)[doc]
        start, length = np.where(piece > 0, head + (piece - 1) * window, 0), np.where(piece > 0, window, head)
        at = starts[:-1][doc] + start
        for k in range(0, len(doc), 4000):
            d = slice(k, k + 4000)
            own = [data[4 * a : 4 * (a + b)] for a, b in zip(at[d].tolist(), length[d].tolist())]
            rows = pa.array(doc[d])
            out = {"rid": batch["rid"].take(rows), "doc_id": batch["doc_id"].take(rows), "piece": piece[d].astype(np.int32), "start": start[d], "length": length[d], "ids_crc32": list(map(zlib.crc32, own)), "doc_tokens": n[doc[d]]}
            yield out | ({"ids": list(map(bytes, own))} if with_ids else {})

    return run


def cut(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text), written once: rid (a number of the row), doc_id, piece, start, length,
    ids_crc32, doc_tokens and, with_ids, ids (little-endian unsigned 32-bit integers).
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(in_arrow(rows, lambda: _cut(tokenizer, end_id, window, with_ids), _PIECE + (", ids binary" if with_ids else ""), 3000), "pieces")


def _counts(sizes: np.ndarray, window: int) -> np.ndarray:
    return np.bincount(sizes, minlength=window + 1)


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[c].to_numpy().astype(np.int64) for c in names]


def _packed(rows: pa.Table, sizes: np.ndarray, first: int, items: int, window: int) -> pa.Table:
    """``rows`` packed anew, in parts of about ``items`` from number ``first`` on, cut between bins."""
    bound = Bounds.of(window)
    bins, offsets, free = best_fit_decreasing(sizes, window)
    cuts = max(1, -(-len(sizes) // items))
    sub = (bins % cuts).astype(np.int64)
    slack, sure = np.zeros(cuts), np.zeros(cuts, bool)
    for k in range(cuts):
        counts, used = _counts(sizes[sub == k], window), -(-(len(free) - k) // cuts)
        slack[k], sure[k] = used - bound.share(counts), used == bound.bins(counts)
    new = {"part": first + sub, "bin": bins // cuts, "offset": offsets, "room": free[bins], "slack": slack[sub], "certified": sure[sub]}
    return pa.table({c: rows[c] for c in _NAMES} | new, _SCHEMA)


def _by_rows(rows: pa.Table) -> pa.Table:
    """In an order that does not depend on how the rows came."""
    return rows.sort_by([("rid", "ascending"), ("piece", "ascending")])


def _alone(window: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = _by_rows(rows)
        return _packed(rows, *_numbers(rows, "length"), key[0].as_py(), 1 << 62, window)

    return run


def _meeting(first: int, per_part: int, window: int):
    """Unfilled bins of several parts packed as one, if that takes fewer. first: number of the round's first part."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = _by_rows(rows)
        part, bins, sizes = _numbers(rows, "part", "bin", "length")
        # at most 60 parts come out of a meeting
        new = _packed(rows, sizes, first + key[0].as_py() * 64, max(per_part, len(sizes) // 60), window)
        fewer = np.count_nonzero(new["offset"].to_numpy() == 0) < len(np.unique(part * _BINS + bins))
        return new if fewer else rows.select(_SCHEMA.names).cast(_SCHEMA)

    return run


def place(items: DataFrame, window: int = WINDOW, per_part: int = ITEMS, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id, offset and certified (the part's bins are as few as its bound says) to ``items`` (the
    columns of ``cut``, a stable table).
    """
    items = items.select(*_NAMES)
    sizes = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most ``window`` rows
    bound = Bounds.of(window).bins(np.array([sizes.get(k, 0) for k in range(window + 1)]))
    parts = max(1, -(-sum(sizes.values()) // per_part))
    dealt = items.withColumn("deal", F.pmod(F.xxhash64("rid", "piece"), F.lit(parts)))
    active = staged(dealt.groupBy("deal").applyInArrow(_alone(window), _PLACED), "packed")
    used, settled, idle, done = active.where("offset = 0").count(), 0, 0, []
    open_ = (F.col("room") > 0) & (F.col("slack") > 1e-9)
    for r in range(1, rounds + 1):
        if used <= bound or idle >= IDLE:
            break
        moving, rest = active.where(open_), active.where(~open_)
        done.append(rest)
        settled += rest.where("offset = 0").count()
        meetings = max(1, round(moving.count() / (per_part * group)))
        moving = moving.withColumn("deal", F.pmod(F.xxhash64("part", F.lit(r)), F.lit(meetings)))
        active = staged(moving.groupBy("deal").applyInArrow(_meeting(r * _ROUND, per_part, window), _PLACED), "packed")
        now = settled + active.where("offset = 0").count()
        idle, used = 0 if now < used else idle + 1, now
    for d in done:
        active = active.union(d)
    return active.select(*items.columns, (F.col("part") * _BINS + F.col("bin")).alias("sequence_id"), "offset", "certified")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = True, **how: int) -> DataFrame:
    """Pieces of ``docs`` with their places: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    certified and, with_ids, ids. how: as ``place``.
    """
    pieces = cut(docs, tokenizer, end_id, window, with_ids)
    placed = place(pieces, window, **how)
    if with_ids:
        placed = placed.join(pieces.select("rid", "piece", "ids"), ["rid", "piece"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "certified", *(["ids"] if with_ids else []))


def certificate(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences of ``packed``, and bound (how many its pieces need at least)."""
    spark = packed.sparkSession
    counts = np.zeros(window + 1, np.int64)
    for size, n in packed.groupBy("length").count().collect():
        counts[size] = n
    used = packed.where("offset = 0").count()
    return spark.createDataFrame([(used, Bounds.of(window).bins(counts))], "sequences long, bound long")


def op12_repacking(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """All of ``documents`` in as few sequences as it can."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(tokenizer), end_id=2, with_ids=False)

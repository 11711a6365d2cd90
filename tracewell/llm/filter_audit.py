"""Interaction audit of filters: what each removes in every order, and which documents several would remove.

Copies are found with radix tries. A task measures its documents and puts each whole text (UTF-8) into a
compressed trie whose terminals hold the least doc_id put there, with its rows; a document above it is a copy
and goes on without text. What the terminals of a task's tries hold is dealt by ranges of texts, sorted
within a range, and put into tries again, whose traversal gives the copies across tasks. A range begins at
the shortest prefix that parts two neighbours of a sample of texts drawn by hash, so prefixes are longer where
many texts begin alike; they balance the ranges, no result depends on them. A trie that holds TRIE bytes is
traversed and begun anew at the next text; since equal texts are next to each other by then, memory is bounded
however many texts share a prefix, and a text of very many copies meets once a task.

Every document is then a mask of the filters that it fails. Masks are counted per part and label, and each
count (at most 32 masks a part) gives its share to all 120 orders and 5 steps: sums over masks, not over
documents.

Shuffles: texts once (one row for each text and task), slim rows to their labels, counts.

Defined results: a null text is the empty one, of no words, which fails A and not B; a null doc_id is neither
smaller nor larger than others, so its text is no copy and makes none; repeated rows count each, and do not
make each other copies (their doc_ids are equal); a null lang is part ''; a document is good (toxic) if any row
of labels says so, and neither without a row; an empty table has no parts, so no rows; further columns are
ignored. Texts are read whole; one longer than TRIE is a trie of its own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import in_arrow

#: Filters in the order of their bits.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of texts in one trie.
TRIE = 16 << 20
#: Bytes of texts that a range holds about, while there are at most RANGES.
RANGE = 16 << 20
RANGES = 16_384
#: Texts drawn for a range, and bytes of each that are looked at for bounds.
SAMPLES, HEAD = 8, 512
#: Bytes and rows of a batch that a task gives back.
OUT_BYTES, OUT_ROWS = 4 << 20, 10_000

_UPPER, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
_ROW = "doc_id long, part string, mask int, n long, dealt int, text binary"


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # bytes part at \\x20 and \\x09 to \\x0D only
    points = len(text) if text.isascii() else len(text.decode(errors="replace"))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * points) << 2
        | (len(text.translate(None, _SIGNS)) < len(text)) << 3
    )


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of what two byte strings begin alike with."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """Compressed trie of byte strings. A node is [label, children by first byte, what its terminal holds]."""

    def __init__(self):
        self.root, self.size = [b"", {}, None], 0

    def at(self, key: bytes) -> list:
        """The node of ``key``, which is put in if it is new."""
        node, done = self.root, 0
        while done < len(key):
            child = node[1].get(key[done])
            if child is None:
                self.size += len(key) - done
                child = node[1][key[done]] = [key[done:], {}, None]
                return child
            label = child[0]
            if not key.startswith(label, done):
                n = common_prefix(label, key[done : done + len(label)])
                upper = node[1][key[done]] = [label[:n], {label[n]: child}, None]
                child[0], child = label[n:], upper
            node, done = child, done + len(child[0])
        return node

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        """Each key with what its terminal holds, in the order of keys."""
        todo = [(b"", self.root)]
        while todo:
            before, node = todo.pop()
            key = before + node[0]
            if node[2] is not None:
                yield key, node[2]
            todo.extend((key, node[1][b]) for b in sorted(node[1], reverse=True))


class Copies:
    """Rows put into a trie by their text: those above the least doc_id of their text are given out as copies at
    once, the others at the traversal.
    """

    def __init__(self, out: "Out", last: bool):
        self.trie, self.out, self.last, self.text = Trie(), out, last, None

    def put(self, text: bytes, doc_id: int, part: str, mask: int, n: int) -> None:
        if self.trie.size >= TRIE and not (self.last and text == self.text):
            self.traverse()
        self.text = text
        node = self.trie.at(text)
        held = node[2]
        if held is None or doc_id < held[0]:
            if held:
                self._copies(held)
            node[2] = [doc_id, mask, {part: n}]
        elif doc_id == held[0]:
            held[2][part] = held[2].get(part, 0) + n
        else:
            self.out.add(doc_id, part, mask | COPY, n)

    def _copies(self, held: list) -> None:
        for part, n in held[2].items():
            self.out.add(held[0], part, held[1] | COPY, n)

    def traverse(self) -> None:
        """Gives out what the terminals hold, with its text unless this is the last trie it comes to."""
        for text, (doc_id, mask, parts) in self.trie.terminals():
            for part, n in parts.items():
                self.out.add(doc_id, part, mask, n, None if self.last else text)
        self.trie = Trie()


class Out:
    """Rows on their way out of a task. bounds: where ranges of texts begin."""

    def __init__(self, bounds: list[bytes]):
        self.bounds, self.rows, self.bytes, self.done = bounds, [], 0, []

    def add(self, doc_id: int | None, part: str, mask: int, n: int, text: bytes | None = None) -> None:
        self.rows.append((doc_id, part, int(mask), n, None if text is None else bisect_right(self.bounds, text), text))
        self.bytes += len(text or b"")
        if self.bytes >= OUT_BYTES or len(self.rows) >= OUT_ROWS:
            self._close()

    def _close(self) -> None:
        if self.rows:
            self.done.append(dict(zip(("doc_id", "part", "mask", "n", "dealt", "text"), map(list, zip(*self.rows)))))
        self.rows, self.bytes = [], 0

    def batches(self, end: bool = False) -> list[dict]:
        if end:
            self._close()
        done, self.done = self.done, []
        return done


def _measured(bounds: list[bytes]):
    out = Out(bounds)
    copies = Copies(out, last=False)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for doc_id, text, part in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()), batch["part"].to_pylist()):
            text = text.as_py() or b""
            if doc_id is None:
                out.add(None, part, mask_of(text), 1)
            else:
                copies.put(text, doc_id, part, mask_of(text), 1)
        yield from out.batches()

    def rest() -> Iterator[dict]:
        copies.traverse()
        yield from out.batches(end=True)

    run.rest = rest
    return run


def _traversed():
    out = Out([])
    copies = Copies(out, last=True)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for doc_id, part, mask, n, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "part", "mask", "n")), batch["text"]):
            if text.is_valid:
                copies.put(text.as_py(), doc_id, part, mask, n)
            else:
                out.add(doc_id, part, mask, n)
        yield from out.batches()

    def rest() -> Iterator[dict]:
        copies.traverse()
        yield from out.batches(end=True)

    run.rest = rest
    return run


def range_bounds(texts: DataFrame, ranges: int, rows: int) -> list[bytes]:
    """Where at most ``ranges`` ranges of ``texts`` (text) begin, each of about equal bytes of distinct texts.

    Looks at about SAMPLES texts a range, drawn by their hash, and at HEAD bytes of each; a bound is the
    shortest prefix that is above the text before it.
    """
    every = max(1, rows // (SAMPLES * ranges))
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(F.substring(F.col("text").cast("binary"), 1, HEAD).alias("head"), F.octet_length("text").alias("size"))
    heads = sorted((bytes(r[0]), r[1]) for r in drawn.groupBy("head").agg(F.max("size")).collect() if r[0] is not None)
    share, so_far, bounds = sum(n for _, n in heads) / ranges, 0, []
    for (a, n), (b, _) in zip(heads, heads[1:]):
        so_far += n
        if so_far >= share * (len(bounds) + 1):
            bounds.append(b[: common_prefix(a, b) + 1])
    return bounds[: ranges - 1]


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: the filters that documents fail, as bits; n rows that agree in all three."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    many, size = rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    ranges = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // RANGE))
    bounds = range_bounds(rows.select("text"), ranges, many)
    first = in_arrow(rows, lambda: _measured(bounds), _ROW)
    # rows without text are done: they are dealt anywhere, and come first in their range
    dealt = F.coalesce("dealt", F.pmod(F.xxhash64("doc_id"), F.lit(ranges))).cast("int")
    sorted_ = first.repartitionById(ranges, dealt).sortWithinPartitions(F.col("text").asc_nulls_first())
    return in_arrow(sorted_, _traversed, _ROW).select("doc_id", "part", "mask", "n")


def _orders() -> Column:
    """All orders and steps: name, step, bit of the step's filter, bits of those before it."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append(f"('{order}',{k + 1},{bit},{before})")
            before |= bit
    named = "named_struct('filter_order', x.col1, 'step', x.col2, 'bit', x.col3, 'before', x.col4)"
    return F.expr(f"transform(array({','.join(steps)}), x -> {named})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of ``docs``
    (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic).
    """
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks(docs).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(said, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(*[F.sum(x).alias(c) for c, x in {"n": F.col("n"), "good": F.col("n") * F.coalesce("good", F.lit(0)), "toxic": F.col("n") * F.coalesce("toxic", F.lit(0))}.items()])
    each = counts.withColumn("o", F.explode(_orders())).select("part", "mask", "n", "good", "toxic", "o.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    # of all orders, a share of one in as many as fail has this filter first
    first = F.lit(120) / F.bit_count("mask")

    def total(when: Column, what: str | Column = "n") -> Column:
        return F.sum(F.when(when, F.col(what) if isinstance(what, str) else what).otherwise(0)).cast("long")

    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        total(fails, F.col("n") * first.cast("long")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all of ``documents``, in all 120 orders."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_id AS (SELECT t, min(doc_id) AS least FROM words GROUP BY t),
said AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(s.toxic, 0) AS toxic,
  (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 3 * length(x.t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(x.t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN least < x.doc_id THEN 'E' ELSE '' END) AS f
  FROM words x LEFT JOIN least_id l ON x.t = l.t LEFT JOIN said s ON x.doc_id = s.doc_id),
counts AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT o, s, o[s] AS letter, o[1:s - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
each AS (SELECT part, o, s, letter, n, good, toxic, f, contains(f, letter) AS fails, len(list_intersect(string_split(f, ''), string_split(before, ''))) > 0 AND before <> '' AND f <> '' AS earlier FROM counts, steps),
sums AS (SELECT part, o AS filter_order, s AS step, letter, sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END)::bigint AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END)::bigint AS removed,
  sum(CASE WHEN fails AND earlier THEN n ELSE 0 END)::bigint AS redundant, sum(CASE WHEN f = letter THEN n ELSE 0 END)::bigint AS unique_fails,
  sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END)::bigint AS toxic_lost FROM each GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::bigint AS shapley FROM sums"""

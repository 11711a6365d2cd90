"""Token counts by distinct pre-token.

A pre-token here is a run of blanks with the word after it; no piece of the vocabulary crosses
such a border, so the count of a text is the sum over its pre-tokens. Each distinct pre-token is
counted once, by the sentencepiece library; per-document frequencies are joined to these counts.

The most frequent pre-tokens (at most HEAD of them, of at most LONGEST bytes each: a bound of 12 MB)
go to the tasks in advance and are summed there, so no frequent key is ever shuffled; the rest is
joined by key.

Defined results: a null text is the empty one and has no tokens; repeated rows each keep their
count; a null doc_id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import in_tasks, staged

HEAD, LONGEST = 262_144, 48
#: Distinct pre-tokens that a task adds up before it sends them on.
HELD = 200_000
#: Blanks with what follows them; both white-space marks of the library are blanks by then.
_UNITS = regex.compile(" *[^ ]+| +")


def units(text: str) -> list[str]:
    """Pre-tokens of a text, each without the first of the blanks before it, which the library puts back."""
    text = " " + text.replace("▁", " ")
    if text[-1] != " " and "  " not in text:
        return text[1:].split(" ")
    return [u[1:] for u in _UNITS.findall(text)]


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_units(path: str, found: list[str]) -> list[int]:
    """Pieces of each pre-token; the empty one is a blank by itself, one piece."""
    return [len(x) if u else 1 for u, x in zip(found, _pieces(path).encode(found, num_threads=1))]


def _frequencies():
    total: Counter = Counter()

    def sent() -> Iterator[dict]:
        yield {"unit": list(total), "n": list(total.values())}
        total.clear()

    def run(batch: dict) -> Iterator[dict]:
        for text in batch["text"]:
            if text:
                total.update(units(text))
            if len(total) > HELD:
                yield from sent()

    run.rest = sent
    return run


def _documents(head):
    known = head.value

    def run(batch: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("k", "unit", "times", "doc_id", "n_bytes", "own")}
        for doc_id, k, text in zip(batch["doc_id"], batch["k"], batch["text"]):
            own, rest = 0, {}
            for u, n in Counter(units(text)).items() if text else ():
                pieces = known.get(u)
                if pieces is None:
                    rest[u] = n
                else:
                    own += n * pieces
            none = [None] * len(rest)
            out["k"] += [k] * (1 + len(rest))
            out["unit"] += [f"\0 {k}", *rest]
            out["times"] += [0, *rest.values()]
            out["doc_id"] += [doc_id, *none]
            out["n_bytes"] += [len(text.encode()) if text else 0, *none]
            out["own"] += [own, *none]
        yield out

    return run


def token_counts(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = in_tasks(rows.select("text"), _frequencies, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))

    def counted():
        return lambda batch: iter([batch | {"pieces": count_units(model, batch["unit"])}])

    table = staged(in_tasks(found, counted, "unit string, n long, pieces int", 10_000), "units")
    short = table.where(F.octet_length("unit") <= LONGEST)
    shared = spark.sparkContext.broadcast(dict(map(tuple, short.where(F.col("n") >= _least(short)).select("unit", "pieces").collect())))
    keyed = rows.withColumn("k", F.monotonically_increasing_id())
    parts = in_tasks(keyed, lambda: _documents(shared), "k long, unit string, times int, doc_id long, n_bytes long, own long")
    # a document's own row has a pre-token that no text has and no other document's row: its number after a null character and a blank
    sums = parts.join(table.select("unit", "pieces"), "unit", "left")
    sums = sums.groupBy("k").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), (F.max("own") + F.coalesce(F.sum(F.col("times") * F.col("pieces")), F.lit(0))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _least(table: DataFrame) -> int:
    """The least frequency that at most HEAD rows of ``table`` (n) reach, from counts by powers of two in sixteen steps."""
    step = F.floor(F.log2("n") * 16).cast("int")
    found, total = table.groupBy(step.alias("step")).agg(F.count("*").alias("c"), F.min("n").alias("n")).orderBy(F.desc("step")).collect(), 0
    least = 2**62
    for r in found:
        total += r["c"]
        if total > HEAD:
            break
        least = r["n"]
    return least


def op5_token_counts(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Counts of all of ``documents``; over_limit beyond 4096 tokens."""
    from tracewell.llm.tokens import vocabulary

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(model), 4096)

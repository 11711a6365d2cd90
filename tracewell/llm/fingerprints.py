"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a line, cut further after sentence ends so that texts of one line have parts too.
Each paragraph hashes to a wide vector; a document's vector is the sum of those of its paragraphs,
lane by lane modulo a power of two. So it does not depend on their order, the vector of a document
with a paragraph inserted or deleted is this one plus or minus the paragraph's, and equal multisets
have equal vectors.

LANES lanes of 32 bits take every paragraph. STRATA x CELLS more lanes tell how alike two documents
are: a paragraph falls into one stratum (half of them into the first, a quarter into the second, ...)
and one cell of it, so documents of up to some 2**STRATA paragraphs have cells with about one
paragraph; the share of equal cells among those estimates the share of common paragraphs. Both parts
are sums, and together they are the fingerprint: the lanes in hexadecimal digits and then, each
after a point, number and value of the cells that are not zero. ``cells_of`` reads them back, so the
likeness of two documents follows from their fingerprints alone.

Everything is DataFrame functions; there is one shuffle of texts, by ranges of doc_id.

Defined results: a null text is the empty one, whose vector is zero; two empty texts have likeness
1; a null doc_id is the least; rows with equal doc_id follow by text; a single document is its own
next; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import bucket_of, order_bounds

LANES, STRATA, CELLS = 8, 22, 8
#: Documents of an ordering bucket, which carries whole texts.
ROWS_PER_BUCKET = 1000
_LOW = 0xFFFFFFFF


def paragraphs(text: Column) -> Column:
    """Array of the paragraphs of a text, empty ones left out."""
    return F.array_remove(F.split(text, r"(?<=[.!?])[ \n]+|\n+"), "")


def _lanes(unit: Column) -> list[Column]:
    """Terms of the LANES sums."""
    out = []
    for k in range(LANES // 2):
        h = F.xxhash64(unit, F.lit(k))
        out += [h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32)]
    return out


def _cells(unit: Column) -> tuple[Column, Column]:
    """Which cell a paragraph is in, and what it adds there: 1 above 40 bits, 24 bits of hash below."""
    h = F.xxhash64(unit, F.lit(-1))
    # trailing zeros of the hash: half of all have none, a quarter one, ...
    low = h.bitwiseAND(F.lit((1 << (STRATA - 1)) - 1))
    stratum = F.lit(STRATA - 1)
    for s in reversed(range(STRATA - 1)):
        stratum = F.when(low.bitwiseAND(F.lit((1 << (s + 1)) - 1)) == (1 << s), s).otherwise(stratum)
    cell = stratum * CELLS + F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(CELLS - 1))
    return cell.cast("int"), F.shiftrightunsigned(h, 40) + F.lit(1 << 40)


def vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """lanes and cells (arrays of long) by ``keys``, which must tell rows apart, from the column ``text``."""
    units = rows.select(*keys, F.explode_outer(paragraphs(F.col(text))).alias("u"))
    unit = F.coalesce("u", F.lit(""))
    cell, add = _cells(unit)
    there = F.col("u").isNotNull()
    units = units.select(*keys, *[F.when(there, x).otherwise(0).alias(f"l{k}") for k, x in enumerate(_lanes(unit))], F.when(there, cell).otherwise(-1).alias("c"), add.alias("v"))
    got = units.groupBy(*keys).agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LANES)], *[F.sum(F.when(F.col("c") == k, F.col("v")).otherwise(0)).alias(f"c{k}") for k in range(STRATA * CELLS)])
    return got.select(*keys, F.array(*[F.col(f"l{k}").bitwiseAND(F.lit(_LOW)) for k in range(LANES)]).alias("lanes"), F.array(*[F.col(f"c{k}") for k in range(STRATA * CELLS)]).alias("cells"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of a document ``a`` with the paragraphs of ``b`` inserted (sign 1) or deleted (sign -1)."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(_LOW)))


def digest(lanes: Column, cells: Column) -> Column:
    """The fingerprint as text: the lanes, and the cells that are not zero (``.number-value``)."""
    hexa = F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")
    used = F.filter(F.transform(cells, lambda x, i: F.when(x != 0, F.concat(F.lit("."), F.lower(F.hex(i)), F.lit("-"), F.lower(F.hex(x))))), lambda x: x.isNotNull())
    return F.concat(hexa, F.array_join(used, ""))


def cells_of(fingerprint: Column) -> Column:
    """The cells of a fingerprint."""
    parts = F.filter(F.split(fingerprint, r"\."), lambda x: F.instr(x, "-") > 0)
    number = lambda x: F.conv(x, 16, 10).cast("long")
    got = F.map_from_entries(F.transform(parts, lambda x: F.struct(number(F.substring_index(x, "-", 1)), number(F.substring_index(x, "-", -1)))))
    return F.transform(F.sequence(F.lit(0), F.lit(STRATA * CELLS - 1)), lambda i: F.coalesce(F.element_at(got, i.cast("long")), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal cells (0 to 1) among those with one paragraph, or else among those with any."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    used = lambda p: (p["x"] != 0) | (p["y"] != 0)
    one = F.filter(pairs, lambda p: used(p) & (F.greatest(p["x"], p["y"]) < F.lit(2 << 40)))
    some = F.filter(pairs, used)
    best = F.when(F.size(one) > 0, one).otherwise(some)
    return F.when(F.size(some) == 0, 1.0).otherwise(F.size(F.filter(best, lambda p: p["x"] == p["y"])) / F.size(best))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text), of their edited texts, and likenesses to these and to
    the next documents. Edited: the second half replaced by the beginning of the next document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = order_bounds(rows.select("doc_id"), "doc_id", ROWS_PER_BUCKET)
    rows = rows.withColumn("b", bucket_of(F.col("doc_id"), bounds))
    # the first document of each bucket (at most one a bound) also ends the bucket before it
    firsts = rows.groupBy("b").agg(F.max("doc_id").alias("doc_id")).collect()
    order = sorted(r["b"] for r in firsts)
    above = dict(zip(order, order[1:] + order[:1]))
    ends = docs.sparkSession.createDataFrame([(r["b"], r["doc_id"], above[r["b"]]) for r in firsts], "eb int, eid long, to int")
    edge = rows.join(F.broadcast(ends), (F.col("b") == F.col("eb")) & F.col("doc_id").eqNullSafe(F.col("eid"))).groupBy("to", "doc_id").agg(F.max("text").alias("text"))
    rows = rows.withColumn("edge", F.lit(False)).unionByName(edge.select(F.col("to").alias("b"), "doc_id", "text", F.lit(True).alias("edge")))
    down = Window.partitionBy("b").orderBy("edge", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    rows = rows.select("b", "edge", "doc_id", "text", F.lead("text").over(down).alias("after"), F.row_number().over(down).alias("rn"))
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("after", F.lit(1), F.floor(n / 2).cast("int")))
    rows = rows.select("b", "edge", "rn", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(~F.col("edge"), edited).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = F.filter(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("s")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("s"))), lambda x: x["s"].isNotNull())
    keys = ["b", "rn", "edge", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select(*keys, F.explode(both).alias("x")).select(*keys, "x.kind", "x.s")
    got = vectors(rows, [*keys, "kind"], "s")
    pick = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    got = got.groupBy(*keys).agg(pick("lanes", 0).alias("lanes"), pick("cells", 0).alias("cells"), pick("lanes", 1).alias("elanes"), pick("cells", 1).alias("ecells"))
    after = Window.partitionBy("b").orderBy("rn")
    got = got.withColumn("ncells", F.lead("cells").over(after)).where("not edge")
    return got.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("lanes"), F.col("cells")).alias("fingerprint"), digest(F.col("elanes"), F.col("ecells")).alias("edited_fingerprint"),
        likeness(F.col("cells"), F.col("ecells")).alias("near_edited"), likeness(F.col("cells"), F.col("ncells")).alias("near_next"), "lanes", "cells",
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all of ``documents`` and of their edited texts."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lanes", "cells")

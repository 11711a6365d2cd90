"""Benchmark decontamination over a distributed positional inverted index.

Words are maximal runs of digits, ASCII letters (lower-cased) and other non-ASCII characters. The
index holds postings (term, document, position), sorted by term within its files. A phrase is looked
up from its rarest terms: the list of the rarest, moved back by the term's offset, gives the starts
that are possible; the next rarest lists, moved likewise, are intersected with it; what is left is
compared with the document's words. For a set of phrases only the postings of such terms are
stored, and terms that no document has rule their phrases out at once.

Everything is DataFrame functions. Term tables are broadcast only below BROADCAST rows.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no
windows; a null item_id counts as the empty string; items with one id count once; repeated rows
each get the result of their text; empty tables give no hits; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import ascii_lower, staged

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows (of a term or a key) up to which a table is broadcast; beyond, joins shuffle.
BROADCAST = 200_000
#: Rarest terms of a phrase whose lists are intersected before words are compared.
ANCHORS = 3
#: What a document is known by: doc_id (0 of null), whether it is null, hash of the text.
KEY = ["d", "u", "t"]


def words(text: Column) -> Column:
    """Words of a text, in order."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.col("doc_id").cast("long").isNull().alias("u"), F.xxhash64(text).alias("t"), text.alias("text"))


def _small(df: DataFrame, rows: int = BROADCAST) -> DataFrame:
    """Marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Positional postings of ``docs`` (doc_id, text): term, d, t (the document's key), pos; of ``terms`` (term) only."""
    rows = _keyed(docs).select(*KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    rows = rows if terms is None else rows.join(_small(terms), "term", "left_semi")
    return rows.select("term", *KEY, "pos")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences in ``docs`` of those ``terms`` (term) that occur."""
    rows = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return rows.join(_small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def phrases(items: DataFrame, size: int) -> DataFrame:
    """phrase, item: windows of ``size`` words of ``items`` (item_id, text); a shorter item whole."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    return rows.select("item", "w", at.alias("at")).select(F.array_join(F.slice("w", F.col("at"), F.lit(size)), " ").alias("phrase"), "item").distinct()


def phrase_matches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """d, t, start, phrase: every occurrence in ``docs`` of each of the ``wanted`` phrases (phrase)."""
    each = wanted.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    counts = staged(term_counts(docs, each.select("term").distinct()), "terms")
    ranked = each.join(counts, "term", "left").groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("a")).where(F.col("a")[0]["n"] > 0)
    # with fewer terms than ANCHORS the first stands in again
    one = [F.coalesce(F.get("a", F.lit(k)), F.col("a")[0]) for k in range(ANCHORS)]
    ranked = staged(ranked.select("phrase", *[x[f].alias(f"{f}{k}") for k, x in enumerate(one) for f in ("off", "term")]), "anchors")
    anchors = reduce(DataFrame.union, [ranked.select(F.col(f"term{k}").alias("term")) for k in range(ANCHORS)]).distinct()
    index = staged(postings(docs, anchors).sortWithinPartitions("term"), "postings")
    found = index.join(ranked, F.col("term") == F.col("term0")).select(*KEY, (F.col("pos") - F.col("off0")).alias("start"), "phrase", *[f"{f}{k}" for k in range(1, ANCHORS) for f in ("off", "term")]).where("start >= 0")
    for k in range(1, ANCHORS):
        other = index.select(*KEY, F.col("term").alias(f"term{k}"), F.col("pos").alias("p"))
        found = found.withColumn("p", F.col("start") + F.col(f"off{k}")).join(other, [*KEY, f"term{k}", "p"], "left_semi").drop("p")
    found = staged(found.select(*KEY, "start", "phrase").distinct(), "starts")
    keys = found.select(*KEY).distinct()
    near = found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "phrase")).alias("c"))
    texts = _keyed(docs).join(_small(keys), KEY, "left_semi").dropDuplicates(KEY)
    both = texts.join(near, KEY).select(*KEY, words(F.col("text")).alias("w"), "c")
    same = F.filter("c", lambda c: F.array_join(F.slice("w", c["start"] + 1, F.size(F.split(c["phrase"], " "))), " ") == c["phrase"])
    return both.select(*KEY, F.explode(same).alias("c")).select(*KEY, "c.start", "c.phrase")


def proximity_matches(index: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """d, t, pos, other: positions of two terms at most ``within`` words apart, from ``postings``.

    Positions meet by blocks of ``within`` words, so a document with many of either is no square.
    """
    a = index.where(F.col("term") == first).select(*KEY, "pos", F.floor(F.col("pos") / within).alias("block"))
    b = index.where(F.col("term") == second).select(*KEY, F.col("pos").alias("other"), F.explode(F.array(*[F.floor(F.col("pos") / within) + k for k in (-1, 0, 1)])).alias("block"))
    return a.join(b, [*KEY, "block"]).where((F.abs(F.col("pos") - F.col("other")) <= within) & (F.col("pos") != F.col("other"))).select(*KEY, "pos", "other")


def hits(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """d, t, n_hit, items (sorted ids): documents in which a window of an item occurs."""
    wanted = staged(phrases(items, size), "phrases")
    found = staged(phrase_matches(docs, wanted), "hits")
    ends = found.groupBy(*KEY, "start").agg(F.max(F.size(F.split("phrase", " "))).alias("n"))
    spans = ends.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("s"))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    more = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))
    spans = spans.select(*KEY, F.aggregate("s", none, more)["n"].cast("long").alias("n_hit"))
    named = found.select(*KEY, "phrase").distinct().join(wanted, "phrase").groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return spans.join(named, KEY)


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated for each row of ``docs`` (doc_id, text)."""
    got = hits(docs, items, size)
    rows = _keyed(docs).select(*KEY, F.size(words(F.col("text"))).cast("long").alias("n_words")).join(got, KEY, "left")
    return rows.select(
        F.when(~F.col("u"), F.col("d")).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Rows of ``docs``, with all their columns, in which no window of an item occurs."""
    bad = _small(staged(hits(docs, items, size).select(F.when(~F.col("u"), F.col("d")).alias("_d"), F.col("t").alias("_t")), "bad"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_t")), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``, windows of ten words."""
    got = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _sql_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP3_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_sql_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_sql_words('text')} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS p, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS MATERIALIZED (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT pos.r, pos.s, pos.n, win.item_id FROM pos JOIN win ON pos.p = win.p AND pos.n = win.n),
spans AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS x FROM hit) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN spans USING (r) LEFT JOIN named USING (r)
"""

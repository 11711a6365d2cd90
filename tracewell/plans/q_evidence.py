"""Evidence files of each customer, in the format that their key gives, read by one reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.domain import table
from tracewell.plans.registry import query
from tracewell.sources import evidence

FILES = """o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
f AS (SELECT *, o_custkey % 9 AS kind, 'c' || o_custkey || CASE o_custkey % 9 WHEN 0 THEN '.csv' WHEN 1 THEN '.tsv' WHEN 2 THEN '.json' WHEN 3 THEN '.json' WHEN 4 THEN '.jsonl' WHEN 5 THEN '.txt' WHEN 6 THEN '.json' WHEN 7 THEN '.dat' ELSE '.csv' END AS file FROM o)"""


def _files(spark, d):
    """Small groups: the orders of one customer."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    kind = F.col("o_custkey") % 9
    key, quoted = lambda x: x["o_orderkey"].cast("string"), lambda x: F.concat(F.lit('"'), x["o_orderpriority"], F.lit(', "" said\n"'))
    listed = lambda sep, f, head="": F.concat(F.lit(head), F.array_join(F.transform("x", f), sep))
    one = lambda x: F.concat(F.lit('{"ref": '), key(x), F.lit(', "note": "'), x["o_orderpriority"], F.lit('"}'))
    body = (
        F.when(kind == 0, listed("\n", lambda x: F.concat(key(x), F.lit(","), quoted(x)), "ref,note\n"))
        .when(kind == 1, listed("\n \t\n", lambda x: F.concat(key(x), F.lit("\t"), x["o_orderpriority"]), "ref\tnote\n"))
        .when(kind == 2, F.concat(F.lit("["), listed(",", one), F.lit("]")))
        .when(kind == 3, F.concat(F.lit('{"rows": 7, "data": ['), listed(",", key), F.lit(", null]}")))
        .when(kind == 4, listed("\n\n", one))
        .when(kind == 5, listed("\n\n", lambda x: F.concat(F.lit("order "), key(x)), "\n"))
        .when(kind == 6, F.concat(F.lit("["), listed(",", one)))
        .when(kind == 7, listed("\n", lambda x: F.concat(key(x), F.lit(","), x["o_orderpriority"]), "ref,note\n"))
        .otherwise("ref,note\n , \n")
    )
    end = F.element_at(F.array(*[F.lit(e) for e in (".csv", ".tsv", ".json", ".json", ".jsonl", ".txt", ".json", ".dat", ".csv")]), (kind + 1).cast("int"))
    return rows.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), end).alias("path"), F.encode(body, "utf-8").alias("content"))


@query("S01_S06_mixed_files", f"""WITH {FILES}
SELECT file, CASE kind WHEN 0 THEN 'csv' WHEN 1 THEN 'tsv' WHEN 2 THEN 'json' WHEN 3 THEN 'json' WHEN 4 THEN 'jsonl' WHEN 5 THEN 'txt' ELSE 'csv' END AS format, k::INT AS record_no,
  CASE WHEN kind = 5 THEN 'order ' || o_orderkey ELSE o_orderkey::VARCHAR END AS ref, CASE kind WHEN 0 THEN o_orderpriority || ', " said' || chr(10) WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE o_orderpriority END AS note, NULL AS error FROM f WHERE kind NOT IN (6, 8)
UNION ALL SELECT DISTINCT file, CASE kind WHEN 6 THEN 'json' ELSE 'csv' END, NULL::INT, NULL, NULL, CASE kind WHEN 6 THEN 'invalid_json' ELSE 'no_rows' END FROM f WHERE kind IN (6, 8)""")
def s01(spark, d):
    rows = evidence.parsed(_files(spark, d))
    path = lambda *names: F.coalesce(*[F.get_json_object("raw", f"$.{n}") for n in names])
    return rows.select("file", "format", "record_no", path("ref", "value", "text").alias("ref"), path("note").alias("note"), "error")


@query("S01_faults", f"WITH {FILES} SELECT error, count(*) AS files FROM (SELECT DISTINCT file, CASE kind WHEN 6 THEN 'invalid_json' ELSE 'no_rows' END AS error FROM f WHERE kind IN (6, 8)) GROUP BY 1")
def s01_faults(spark, d):
    return evidence.parsed(_files(spark, d)).where("error is not null").groupBy("error").agg(F.count("*").alias("files"))

"""Readers of evidence files into numbered records, and their format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Format by file extension. Fixed values.
EXTENSIONS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "txt": "txt", "pdf": "pdf"}


def sniffed(path: Column, head: Column) -> Column:
    """Format by extension, or else by the first bytes."""
    ext = F.lower(F.regexp_extract(path, r"[.]([A-Za-z]+)$", 1))
    out = None
    for k, v in EXTENSIONS.items():
        out = F.when(ext == k, v) if out is None else out.when(ext == k, v)
    start = F.ltrim(F.substring(head, 1, 2000))
    commas = F.length(start) - F.length(F.replace(start, F.lit(",")))
    return out.when(start.startswith("%PDF-"), "pdf").when(start.startswith("<"), "html").when(start.rlike(r"^[\[{]"), "json").when((commas >= 2) & F.contains(start, F.lit("\n")), "csv").otherwise("txt")


def paragraphs(df: DataFrame, key: str, text: str, by: str = "\n\n") -> DataFrame:
    """key, record_no (from 1), text: the parts of a text that are not blank."""
    parts = F.filter(F.split(F.col(text), by), lambda p: F.trim(p) != "")
    return df.select(key, F.posexplode(parts).alias("_k", "text")).select(key, (F.col("_k") + 1).alias("record_no"), "text")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows with a header as file, record_no, raw (map); nulls become empty, rows without any value are dropped."""
    rows = spark.read.option("header", True).option("sep", sep).option("multiLine", True).csv(path).na.fill("")
    keep = F.array_join(F.array(*[F.trim(c) for c in rows.columns]), "") != ""
    raw = F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))])
    return _numbered(rows.where(keep).select(F.input_file_name().alias("file"), raw.alias("raw")))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of text files as file, record_no, text."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return paragraphs(whole, "file", "value")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a list, or of an object's records, rows or data list, or the object, as file, record_no, raw (JSON text).

    Scalars in a list become {"value": x}.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("v"))
    inner = F.coalesce(*[F.get_json_object("v", f"$.{k}") for k in ("records", "rows", "data")])
    body = F.when(F.col("v").startswith("["), F.col("v")).when(inner.startswith("["), inner)
    listed = whole.withColumn("list", body)
    many = listed.where("list is not null").select("file", F.posexplode(F.from_json("list", "array<variant>")).alias("k", "x")).select("file", (F.col("k") + 1).alias("record_no"), F.to_json("x").alias("raw"))
    many = many.withColumn("raw", F.when(F.col("raw").startswith("{"), F.col("raw")).otherwise(F.concat(F.lit('{"value":'), "raw", F.lit("}"))))
    return many.unionByName(listed.where("list is null").select("file", F.lit(1).alias("record_no"), F.col("v").alias("raw")))


def _numbered(rows: DataFrame) -> DataFrame:
    order = rows.withColumn("_id", F.monotonically_increasing_id())
    return order.withColumn("record_no", F.row_number().over(Window.partitionBy("file").orderBy("_id"))).select("file", "record_no", "raw")

"""One reader for folders of mixed evidence: format by name or else by content, records as JSON, faults as rows.

Whole files go to the tasks one by one (``binaryFile``, so any store that Spark reads will do); a file of over ``most``
bytes is a fault and not read into memory. Formats: csv and tsv (header, quoted values with line breaks), json (a list, an
object's records, rows or data list, or one object), jsonl (an object a line), txt (paragraphs). A file of a known format
without records, or that can't be read as what its name says, gives one row with an error code and no record.

Defined results: record_no counts the records of a file from 1, without those left out (blank rows, nulls in a list); scalars
in a list become {"value": x}; cells that a row lacks are empty, those beyond the header are kept under the name "";
text is UTF-16 with a byte order mark, else UTF-8, else Latin-1. Files of no bytes at all are not in Spark's listing
and have no row in ``read``; ``parsed`` gives them empty_file.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats by file name. Fixed values.
FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "txt": "txt", "pdf": "pdf"}
#: Lists of records inside an object, the first that is one counts. Fixed values.
LISTS = ("records", "rows", "data")
#: Bytes of the largest file that is read, and of the head that is looked at for its format.
MOST, HEAD = 64 << 20, 4096
#: Codes of faults.
FAULTS = ("too_large", "empty_file", "unknown_format", "unsupported_format", "no_header", "no_rows", "invalid_json", "no_records", "no_paragraphs")


class Fault(ValueError):
    """A file that gives no records; its text is a code of FAULTS."""


def format_of(name: str, data: bytes) -> str:
    """By the end of the name, or else by the first bytes."""
    ext = re.search(r"\.([A-Za-z0-9]+)$", name.lower())
    if ext and ext[1] in FORMATS:
        return FORMATS[ext[1]]
    head = text_of(data[:HEAD]).lstrip("﻿ \t\r\n")
    if head.startswith("%PDF-"):
        return "pdf"
    lines = [x for x in head.splitlines() if x.strip()]
    if not lines:
        raise Fault("empty_file")
    if head[0] in "[{":
        objects = len(lines) > 1 and all(x.lstrip().startswith("{") and x.rstrip().endswith("}") for x in lines[: -1 if len(data) > HEAD else None])
        return "jsonl" if objects else "json"
    for sep, kind in ((",", "csv"), ("\t", "tsv")):
        if len(lines) > 1 and lines[0].count(sep) == lines[1].count(sep) > 0:
            return kind
    raise Fault("unknown_format")


def text_of(data: bytes) -> str:
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _table(text: str, sep: str) -> Iterator[dict]:
    rows = csv.DictReader(io.StringIO(text, newline=""), delimiter=sep, restkey="", restval="")
    if not rows.fieldnames:
        raise Fault("no_header")
    some = False
    for row in rows:
        if any(str(v).strip() for v in row.values()):
            some = True
            yield row
    if not some:
        raise Fault("no_rows")


def _json(text: str) -> list[dict]:
    try:
        whole = json.loads(text)
    except ValueError:
        raise Fault("invalid_json") from None
    if isinstance(whole, dict):
        whole = next((whole[k] for k in LISTS if isinstance(whole.get(k), list)), [whole])
    elif not isinstance(whole, list):
        raise Fault("no_records")
    if not all(isinstance(x, dict) for x in whole):
        whole = [{"value": x} for x in whole if x is not None]
    if not whole:
        raise Fault("no_records")
    return whole


def _lines(text: str) -> Iterator[dict]:
    some = False
    for line in text.splitlines():
        if line.strip():
            some = True
            try:
                x = json.loads(line)
            except ValueError:
                raise Fault("invalid_json") from None
            yield x if isinstance(x, dict) else {"value": x}
    if not some:
        raise Fault("no_records")


def _paragraphs(text: str) -> list[dict]:
    parts = [p for p in (b.strip() for b in text.split("\n\n")) if p]
    if not parts:
        raise Fault("no_paragraphs")
    return [{"text": p} for p in parts]


def records_of(name: str, data: bytes | None) -> Iterator[tuple[str | None, int | None, str | None, str | None]]:
    """format, record_no, raw (JSON), error of a file. data: None where it was too large to be read.

    A fault in the middle of a file follows the records before it.
    """
    kind = None
    try:
        if data is None:
            raise Fault("too_large")
        kind = format_of(name, data)
        if kind == "pdf":
            raise Fault("unsupported_format")
        text = text_of(data)
        if not text.strip():
            raise Fault("empty_file")
        rows = _table(text, "," if kind == "csv" else "\t") if kind in ("csv", "tsv") else {"json": _json, "jsonl": _lines, "txt": _paragraphs}[kind](text)
        for k, row in enumerate(rows, 1):
            yield kind, k, json.dumps(row, ensure_ascii=False, separators=(",", ":")), None
    except Fault as e:
        yield kind, None, None, str(e)


def parsed(files: DataFrame) -> DataFrame:
    """file, format, record_no, raw, error of ``files`` (path, content: bytes, or null where they are too many)."""
    rows = files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "format", "record_no", "raw", "error"]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                part: list[tuple] = []
                for row in records_of(path, content.as_py()):
                    part.append((path, *row))
                    if len(part) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)

    return rows.mapInArrow(run, "file string, format string, record_no int, raw string, error string")


def read(spark: SparkSession, path: str, most: int = MOST) -> DataFrame:
    """``parsed`` files below ``path``. Contents of files over ``most`` bytes are not fetched."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = found.where(F.col("length") <= most).select("path", "content")
    large = found.where(F.col("length") > most).select("path", F.lit(None).cast("binary").alias("content"))
    return parsed(small.unionByName(large))

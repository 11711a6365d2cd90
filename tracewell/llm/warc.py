"""WARC archives: a writer with payload deduplication and a reader that salvages damaged files.

Writer: each row of pages is one WARC/1.0 record, and each record is a gzip member of its own. Among
equal payloads the one with the largest page_id is a response, the others are revisits that refer
to it. Members are rows of Spark's text writer, whose line separator is a gzip member of an empty
text, so the executors write valid archives of about ARCHIVE bytes (before compression) to any file
system that Spark can write to.

Reader: walks an archive from record to record, plain or gzip members. A record that fails a check
(version line, headers, length, closing blank lines, block digest, member checksum) is not the end:
the reader searches on for the next member (of a compressed archive) or version line (of a plain one)
from which a record reads well, goes on from there, and logs the bytes between as a gap with the
reason. A plain record whose length leads to the next version line, so that only its block is
damaged, is left as a whole: records quoted in its payload are not taken for records of the archive.
Of a damaged member that holds several records, those before the damage are kept.

Defined results: a null html is the empty payload; a null url is left out, line breaks in one are
escaped; a null page_id is the least and comes back as null; rows with equal page_id and payload are
each a response if that page_id is the largest; an empty table gives no archive; further columns are
ignored. One archive is read as a whole by one task, so archives should stay well below 1 GB.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewell.llm.common import in_arrow, scratch, staged

ARCHIVE = 8_000_000
#: Payloads with copies up to which their table is broadcast.
BROADCAST = 200_000
#: Deflate level of members.
LEVEL = 3
#: Record ids: an URN with the page's number.
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = re.compile(rb"\x1f\x8b\x08")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _member_of(record: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(page: int | None, url: str | None, sha1: str, size: int, html: str | None, top: int | None, date: str) -> bytes:
    """A response, or a revisit to page ``top`` if that is given."""
    name = lambda p: f"<{_ID}{'null' if p is None else p}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (html or "").encode()
    lines = [
        "WARC/1.0", f"WARC-Type: {'response' if top is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {date}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]), "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{_base32(bytes.fromhex(sha1))}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}", f"X-Payload-Length: {size}", *([] if top is None else [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(top)}"]), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(date: str):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = zip(*(batch[c].to_pylist() for c in ("page_id", "url", "sha1", "size", "html", "top")))
        out = [_member_of(_record(*r, date)) for r in rows]
        yield {"value": pa.array(out, pa.binary()).view(pa.string())}

    return run


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of ``pages`` (page_id, url, html) below ``path``.

    The table of payloads that come more than once (digest and largest page_id) is broadcast below
    BROADCAST rows: then payloads are written where they are read. Beyond, the payloads of
    responses are shuffled by a unique key, and revisits, which need none, as slim rows that Spark
    may split.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.select("page_id", "url", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").cast("long").alias("size"), "html")
    again = staged(rows.where(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("d"), "top", F.lit(True).alias("many")), "copies")
    first = F.col("many").isNull() | F.col("page_id").eqNullSafe(F.col("top"))
    columns = ["page_id", "url", "sha1", "size"]
    if again.limit(BROADCAST + 1).count() <= BROADCAST:
        both = rows.join(F.broadcast(again), F.col("sha1") == F.col("d"), "left")
        out = both.select(*columns, F.when(first, F.col("html")).alias("html"), F.when(~first, F.col("top")).alias("top"))
    else:
        tops = rows.join(again, (F.col("sha1") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("top")), "left_semi")
        alone = rows.join(again, F.col("sha1") == F.col("d"), "left_anti")
        slim = rows.drop("html").join(again, F.col("sha1") == F.col("d")).where(~first)
        out = alone.unionByName(tops).withColumn("top", F.lit(None).cast("long")).unionByName(slim.select(*columns, F.lit(None).cast("string").alias("html"), "top"))
    n, total = rows.agg(F.count("*"), F.sum(F.col("size") + 600)).first()
    each = max(1, int(ARCHIVE * n / total)) if n else 1
    text = in_arrow(out, lambda: _members(date), "value string", 500).write.option("encoding", "ISO-8859-1").option("lineSep", _member_of(b"").decode("latin-1"))
    text.option("maxRecordsPerFile", each).text(path)


class Damage(ValueError):
    """What is wrong with a record; ``end``: where it ends nevertheless, if that is certain."""

    def __init__(self, why: str, end: int | None = None):
        super().__init__(why)
        self.end = end


def _plain(buf: bytes, at: int) -> tuple[dict, int, int, int]:
    """Headers, block start, block end and record end of the record at ``at``; ValueError says what is wrong."""
    m = _VERSION.match(buf, at)
    if not m:
        raise Damage("no version line")
    stop = buf.find(b"\r\n\r\n", m.end())
    if stop < 0:
        raise Damage("headers do not end")
    headers = {}
    for line in buf[m.end() : stop].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damage("header without a colon")
        headers[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise Damage("no content length")
    begin, end = stop + 4, stop + 4 + int(size)
    if end > len(buf):
        raise Damage("block is cut off")
    if buf[end : end + 4] != b"\r\n\r\n":
        raise Damage("record does not end after its block")
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != base64.b32encode(hashlib.sha1(buf[begin:end]).digest()).decode():
        raise Damage("block digest differs", end + 4 if end + 4 == len(buf) or _VERSION.match(buf, end + 4) else None)
    return headers, begin, end, end + 4


def _member(buf: bytes, at: int) -> tuple[list[tuple[dict, bytes]], int, str]:
    """Records of the gzip member at ``at``, where it ends, and what is wrong with the rest of it, if anything."""
    z, parts, p, why = zlib.decompressobj(31), [], at, ""
    try:
        while not z.eof and p < len(buf):
            parts.append(z.decompress(memoryview(buf)[p : p + 16384]))
            p += 16384
        why = "" if z.eof else "gzip member is cut off"
    except zlib.error as e:
        why = f"gzip member: {e}"
    data, found, q = b"".join(parts), [], 0
    try:
        while q < len(data):
            headers, begin, end, q = _plain(data, q)
            found.append((headers, data[begin:end]))
    except ValueError as e:
        why = why or str(e)
    return found, min(p, len(buf)) - len(z.unused_data), why


def salvage(buf: bytes) -> Iterator[tuple[int, int, dict | None, bytes, str]]:
    """offset, length, headers, block, reason of what an archive holds, in order.

    A gap has no headers, but the reason why its first bytes were not read. Records of a gzip
    member have its offset and length.
    """

    def read(at: int) -> tuple[list[tuple[dict, bytes]], int, str]:
        if buf[at : at + 1] == b"\x1f":
            return _member(buf, at)
        try:
            headers, begin, end, after = _plain(buf, at)
        except Damage as e:
            return [], e.end or at, str(e)
        return [(headers, buf[begin:end])], after, ""

    # a compressed archive may hold version lines in its compressed bytes, and the other way round
    start = _MEMBER if _MEMBER.match(buf) else _VERSION if _VERSION.match(buf) else _START
    at, n, got = 0, len(buf), None
    while at < n:
        found, after, why = got or read(at)
        got = None
        if why and (after == at or buf[at : at + 1] == b"\x1f"):
            # the next place from which at least one record reads well; what is wrong with the rest is a gap of its own
            for m in start.finditer(buf, at + 1):
                got = read(m.start())
                if got[0]:
                    break
                got = None
            after = m.start() if got else n
        for headers, block in found:
            yield at, after - at, headers, block, ""
        if why:
            yield at, after - at, None, b"", why
        at = after


_READ = "archive string, offset long, length long, gap string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def _rows(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = schema.names
    for batch in batches:
        for i in range(batch.num_rows):
            out: list[tuple] = []
            size, archive = 0, batch.column(0)[i].as_py()
            for offset, length, h, block, why in salvage(batch.column(1)[i].as_py()):
                if h is None:
                    out.append((archive, offset, length, why, *[None] * 7))
                else:
                    kind, http = h.get("warc-type"), "application/http" in h.get("content-type", "")
                    payload = block[block.find(b"\r\n\r\n") + 4 :] if http and b"\r\n\r\n" in block else block
                    digest, n = h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("x-payload-length", "")
                    if kind == "response":  # of what was read, not what a header says
                        digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), str(len(payload))
                    out.append((archive, offset, length, None, h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-refers-to"), digest, int(n) if n.isdigit() else None, payload if kind != "revisit" else None))
                    size += len(block)
                if size > 16_000_000 or len(out) >= 5000:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives below ``path``; ``gap`` is the reason of a gap, null of a record."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(partial(_rows, to_arrow_schema(StructType.fromDDL(_READ))), _READ)


def _number(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:x-page:(-?[0-9]+)>$", 1)


def pages_of(records: DataFrame) -> DataFrame:
    """Pages that ``write_archives`` wrote: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    number = lambda c: F.nullif(_number(F.col(c)), F.lit("")).cast("long")
    return records.where("gap is null").select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written to archives and read back."""
    path = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return pages_of(read_archives(spark, path))


#: RFC 4648 alphabet. Fixed value.
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP4_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT r, string_agg(substr('{_B32}', CAST((CAST('0x' || substr(x, CAST(k // 8 AS INT) * 10 + 1, 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS INT)) & 31 AS INT) + 1, 1), '' ORDER BY k) AS digest
  FROM p, generate_series(0, 31) AS g(k) GROUP BY r),
t AS (SELECT p.*, digest, max(page_id) OVER (PARTITION BY digest) AS top FROM p JOIN d USING (r))
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM t
"""

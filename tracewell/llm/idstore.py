"""Content-addressed store of token ids.

A rolling hash over the id stream of a document cuts it where the content says so, so equal
passages give equal chunks wherever they stand. A chunk is stored once, under the SHA-256 of its
bytes; a document is a recipe (the digests of its chunks, in order) with a Merkle root over them.
A manifest holds the Merkle tree above the roots of all documents: level 0 has a node for each
BLOCK documents that follow each other, level k one for each BLOCK nodes of level k-1, up to one root.

File format, all below one folder, as Parquet: ``objects/kind=chunk`` (key: the digest, n_ids, width,
ids: a zstd frame of little-endian unsigned integers of 2 or 4 bytes), ``recipes/`` (doc_id, pos,
start, n_tokens, width, chunks array<binary>, root; files in ascending doc_id order) and
``manifest/`` (level, block, documents, tokens, root). ``objects/kind=draft`` has the recipes as the
tasks wrote them, before their order was known.

Reading puts every document together from its chunks, checks each chunk against its digest and each
document against its root, and the recipes against the manifest, so that a lost or doubled recipe
file is told.

Defined results: a null text is the empty one; each document ends with ``end_id``, so no recipe is
empty; repeated rows are documents of their own, ordered among themselves by the order of reading; a
null doc_id comes first; an empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import in_arrow, in_tasks, running_start, scratch, shuffles_freed, staged
from tracewell.llm.tokens import encoder, width_of

#: Ids that the rolling hash sees, bounds of a chunk's ids, and the mask whose zero is a cut.
WINDOW, LEAST, MOST, MASK = 8, 128, 4096, 0x1FF
#: Children of a node of the manifest.
BLOCK = 1024
_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 2**64) for k in range(WINDOW)], dtype=np.uint64)


def candidates(ids: np.ndarray) -> np.ndarray:
    """Positions behind which a chunk may end: where the hash of the last WINDOW ids has MASK's bits zero."""
    out = []
    for at in range(0, max(0, len(ids) - WINDOW + 1), 1 << 18):
        x = (ids[at : at + (1 << 18) + WINDOW - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        n = len(x) - WINDOW + 1
        h = x[:n] * _ODD[0]
        for k in range(1, WINDOW):
            h += x[k : n + k] * _ODD[k]
        out.append(np.flatnonzero(((h >> np.uint64(40)) & np.uint64(MASK)) == 0) + (at + WINDOW))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cuts(n: int, at: list[int]) -> list[int]:
    """Ends of the chunks of ``n`` ids with the candidates ``at``.

    No chunk is shorter than LEAST, which is over WINDOW, but a document's last one: so a candidate
    whose window began in the document before is never taken.
    """
    out, last = [], 0
    for c in [*at, n]:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST or c == n and c > last:
            out.append(c)
            last = c
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root of the binary SHA-256 tree over ``digests``; an odd last node moves up as it is."""
    level = list(digests)
    while len(level) > 1:
        paired = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = paired + level[len(level) - len(level) % 2 :]
    return level[0] if level else hashlib.sha256(b"").digest()


_OBJECTS = "kind string, key binary, rid long, doc_id long, n_tokens long, width int, chunks array<binary>, root binary, n_ids int, ids binary"


def _objects(path: str, end_id: int):
    """Of each document a draft of its recipe, and its chunks, those that this task has sent before left out."""
    enc, seen, zstd = encoder(path), set(), zstandard.ZstdCompressor(level=2)
    width = width_of(enc, end_id)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, starts = enc.encode_all(batch["text"], end_id)
        ends = candidates(ids)
        bounds, data = np.searchsorted(ends, starts, "right"), memoryview(ids.astype(f"<u{width}")).cast("B")
        docs: dict[str, list] = {k: [] for k in ("n_tokens", "chunks", "root")}
        new: dict[str, list] = {k: [] for k in ("key", "n_ids", "ids")}
        starts, ends = starts.tolist(), ends.tolist()
        for i, (a, b) in enumerate(zip(starts, starts[1:])):
            digests, last = [], 0
            for c in cuts(b - a, [x - a for x in ends[bounds[i] : bounds[i + 1]] if x < b]):
                body = data[(a + last) * width : (a + c) * width]
                digest = hashlib.sha256(body).digest()
                digests.append(digest)
                if digest not in seen:
                    for k, v in (("key", digest), ("n_ids", c - last), ("ids", zstd.compress(body))):
                        new[k].append(v)
                    if len(seen) < 200_000:
                        seen.add(digest)
                last = c
            for k, v in (("n_tokens", b - a), ("chunks", digests), ("root", merkle(digests))):
                docs[k].append(v)
        rid = batch["rid"]
        key = [x.to_bytes(8, "big", signed=True) for x in rid.to_pylist()]
        n, m = len(key), len(new["key"])
        yield docs | {"kind": ["draft"] * n, "key": key, "rid": rid, "doc_id": batch["doc_id"], "width": [width] * n, "n_ids": [None] * n, "ids": [None] * n}
        yield new | {"kind": ["chunk"] * m, "rid": [None] * m, "doc_id": [None] * m, "n_tokens": [None] * m, "width": [width] * m, "chunks": [None] * m, "root": [None] * m}

    return run


def _roots():
    def run(batch: dict) -> Iterator[dict]:
        yield {k: batch[k] for k in ("level", "block", "documents", "tokens")} | {"root": [merkle([x["root"] for x in r]) for r in batch["r"]]}

    return run


def manifest_of(recipes: DataFrame) -> DataFrame:
    """Nodes of the Merkle tree over ``recipes`` (pos, n_tokens, root): level, block, documents, tokens, root.

    A node is made of at most BLOCK rows, if no position is there twice. Levels end with a single node.
    """
    below, level, out = recipes.select("pos", F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"), "root"), 0, None
    while True:
        block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
        nodes = below.groupBy(block).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("pos", "root"))).alias("r"))
        nodes = staged(in_tasks(nodes.withColumn("level", F.lit(level)), _roots, "level int, block long, documents long, tokens long, root binary", 100), "manifest")
        out = nodes if out is None else out.union(nodes)
        if nodes.limit(2).count() < 2:
            return out
        below, level = nodes.select(F.col("block").alias("pos"), "documents", "tokens", "root"), level + 1


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the store below ``path``.

    Two shuffles: chunk bodies by digest (each task sends a chunk once, so a text that fills a third
    of the rows costs one body per task), and slim recipes by position.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", F.monotonically_increasing_id())
    with shuffles_freed(spark):
        objects = in_arrow(rows, lambda: _objects(tokenizer, end_id), _OBJECTS, 3000)
        objects.dropDuplicates(["kind", "key"]).write.partitionBy("kind").parquet(f"{path}/objects")
        drafts = _objects_of(spark, path, "draft").select("doc_id", "rid", "n_tokens", "width", "chunks", "root")
        places = running_start(drafts.select("doc_id", "rid", "n_tokens", F.lit(1).alias("one")), ["doc_id", "rid"], ["n_tokens", "one"], ["start", "pos"]).select("rid", "start", "pos")
        recipes = drafts.join(places, "rid")
        files = max(1, drafts.count() // 20_000)
        recipes = recipes.repartitionByRange(files, "pos").sortWithinPartitions("pos")
        recipes.select("doc_id", "pos", "start", "n_tokens", "width", "chunks", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")
        manifest_of(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _objects_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_OBJECTS).parquet(f"{path}/objects").where(F.col("kind") == kind).drop("kind")


def _faults(spark: SparkSession, path: str, recipes: DataFrame) -> list[tuple[int, int]]:
    """Level and block of up to ten nodes in which ``recipes`` and the stored manifest differ."""
    names = ["documents", "tokens", "root"]
    have = manifest_of(recipes).select("level", "block", F.struct(*names).alias("have"))
    want = spark.read.parquet(f"{path}/manifest").select("level", "block", F.struct(*names).alias("want"))
    both = have.join(want, ["level", "block"], "full").where(~F.col("have").eqNullSafe(F.col("want")))
    return [tuple(r) for r in both.select("level", "block").orderBy("level", "block").limit(10).collect()]


def _documents(with_ids: bool):
    """Puts the chunks of documents together again; an error tells what does not match."""
    zstd = zstandard.ZstdDecompressor()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        got = batch["got"]
        x = pa.RecordBatch.from_struct_array(got.flatten())
        seq, frames = x["seq"].to_numpy(zero_copy_only=False), x["ids"].to_pylist()
        ends, out = np.asarray(got.offsets) - got.offsets[0].as_py(), []
        for i, (doc_id, n, width, root) in enumerate(zip(*(batch[c].to_pylist() for c in ("doc_id", "n_tokens", "width", "root")))):
            own = (np.argsort(seq[ends[i] : ends[i + 1]]) + ends[i]).tolist()
            if any(frames[j] is None for j in own):
                raise ValueError(f"document {doc_id}: chunks that match its recipe are not there")
            bodies = [zstd.decompress(frames[j]) for j in own]
            if merkle([hashlib.sha256(b).digest() for b in bodies]) != root or sum(map(len, bodies)) != n * width:
                raise ValueError(f"document {doc_id}: its chunks do not match its Merkle root")
            ids = np.frombuffer(b"".join(bodies), f"<u{width}").astype("<u4")
            out.append(ids.tobytes() if with_ids else zlib.crc32(ids))
        yield {k: batch[k] for k in ("doc_id", "pos", "start", "n_tokens")} | {"ids" if with_ids else "ids_crc32": out}

    return run


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a store, put together from its files and verified: doc_id, pos, start, n_tokens and
    ids (little-endian unsigned 32-bit integers) or, without them, ids_crc32.

    A body read for many documents (a hot chunk) is on the unique side of the join, whose other side
    Spark may split. The digests of the bodies themselves must give the root of the document. Raises
    ValueError where the recipes are not those of the manifest.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    wrong = _faults(spark, path, recipes)
    if wrong:
        raise ValueError(f"recipes do not match the manifest at (level, block) {wrong}")
    wanted = recipes.select("pos", F.posexplode("chunks").alias("seq", "key"))
    got = wanted.join(_objects_of(spark, path, "chunk").select("key", "ids"), "key", "left").groupBy("pos").agg(F.collect_list(F.struct("seq", "ids")).alias("got"))
    whole = recipes.drop("chunks").join(got, "pos", "left")
    return in_arrow(whole, lambda: _documents(with_ids), f"doc_id long, pos long, start long, n_tokens long, {'ids binary' if with_ids else 'ids_crc32 long'}", 500)


def op1_id_store(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """All of ``documents`` written to a store and read back."""
    from tracewell.llm.tokens import vocabulary

    path = scratch(spark, "store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary(tokenizer), end_id=1)
    return read_store(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")

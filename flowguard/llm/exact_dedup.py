"""Exact dedup with an extendible-hash index in shared files.

Texts are equal when identical after each run of white space is made one space. The index has
buckets addressed by the leading bits of a 64-bit hash. Its directory starts with one bucket and
doubles while a bucket holds more distinct hashes than ``capacity``; only overfull buckets split,
so a bucket may serve several directory entries. At ``max_depth`` doubling ends and buckets just
grow, which bounds the directory (one byte an entry) whatever the input.

Every task first merges the copies it holds, comparing bytes, so a text with a third of all rows
sends one row per task. An owner task gets whole buckets in order of hash, chains different texts
of equal hash, compares bytes along the chain and writes its entries to the shared folder. An
index can be extended with further documents.

Nulls count as empty text. Empty texts are equal to each other. A row without doc_id takes part;
its id counts as larger than any other. Rows that repeat a doc_id and text all have the smallest
id, so ``kept`` holds for each of them; ``keep_one`` leaves one of them. An empty table gives no
rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import byte_column, partitions, rows_batch, save

KEYED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("sha", pa.binary())])
KEYED_SQL = "doc_id long, h long, sha binary"
PARTIAL = pa.schema([("bucket", pa.int64()), ("h", pa.int64()), ("body", pa.binary()),
                     ("keep_id", pa.int64()), ("n_rows", pa.int64())])
PARTIAL_SQL = "bucket long, h long, body binary, keep_id long, n_rows long"
ENTRY = pa.schema([("bucket", pa.int64()), ("h", pa.int64()), ("chain", pa.int32()),
                   ("sha", pa.binary()), ("keep_id", pa.int64()), ("n_rows", pa.int64()),
                   ("body", pa.binary())])
ENTRY_SQL = "bucket long, h long, chain int, sha binary, keep_id long, n_rows long, body binary"
WHITE = b" \t\n\x0b\x0c\r"
FLUSH = 32 << 20


def normalised(text: bytes) -> bytes:
    """Each run of white space as one space, at both ends too."""
    body = b" ".join(text.split())
    if not body:
        return b" " if text else b""
    return (b" " if text[0] in WHITE else b"") + body + (b" " if text[-1] in WHITE else b"")


def _hash(body: bytes) -> int:
    """Signed 64-bit key of a text."""
    x = xxhash.xxh64_intdigest(body, 7)
    return x - (1 << 64) if x >> 63 else x


def _smaller(a, b):
    return a if b is None or (a is not None and a <= b) else b


@dataclass
class Directory:
    """``local``: depth of the bucket behind each of the ``2**depth`` entries."""

    depth: int
    local: np.ndarray

    def bucket(self, h: int) -> int:
        entry = (h & ((1 << 64) - 1)) >> (64 - self.depth) if self.depth else 0
        free = self.depth - int(self.local[entry])
        return entry >> free << free


def directory(hashes: DataFrame, capacity: int, max_depth: int) -> Directory:
    """Double until no bucket holds more than ``capacity`` distinct hashes."""
    hashes, depth = save(hashes.select("h").distinct(), "hashes"), 0
    while True:
        entry = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
        counts = np.zeros(1 << depth, np.int64)
        for e, n in hashes.groupBy(entry.alias("e")).count().collect():  # one row an entry
            counts[e] = n
        over = counts.max() / capacity
        if over <= 1 or depth == max_depth:
            break
        depth = min(max_depth, depth + max(1, math.ceil(math.log2(over))))
    local = np.full(1 << depth, depth, np.uint8)
    level, size = counts, 1
    for d in range(depth - 1, -1, -1):  # entries share a bucket where the split was not needed
        level, size = level.reshape(-1, 2).sum(1), size * 2
        for k in np.flatnonzero(level <= capacity):
            local[k * size:(k + 1) * size] = d
    return Directory(depth, local)


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, hash and SHA-256 of each normalised text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [normalised(t) for t in byte_column(batch, "text")]
            yield rows_batch({"doc_id": batch.column("doc_id"), "h": [_hash(b) for b in bodies],
                              "sha": [hashlib.sha256(b).digest() for b in bodies]}, KEYED)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, KEYED_SQL)


def _partials(docs: DataFrame, where: Directory) -> DataFrame:
    """Copies merged within a task by comparing bytes, each with its bucket."""
    def flush(held):
        rows = [(where.bucket(h), h, body, keep, n) for h, chain in held.items()
                for body, keep, n in chain]
        for i in range(0, len(rows), 2000):
            yield rows_batch(dict(zip(PARTIAL.names, zip(*rows[i:i + 2000]))), PARTIAL)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_column(batch, "text")):
                body = normalised(text)
                chain = held.setdefault(_hash(body), [])
                for link in chain:
                    if link[0] == body:
                        link[1], link[2] = _smaller(link[1], doc), link[2] + 1
                        break
                else:
                    chain.append([body, doc, 1])
                    size += len(body) + 200
            if size > FLUSH:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, PARTIAL_SQL)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket and hash to entries; texts of one hash form a chain."""
    def entries(bucket, h, chain):
        return [(bucket, h, k, hashlib.sha256(body).digest(), keep, n, body)
                for k, (body, keep, n) in enumerate(sorted(chain))]

    out, size, at, chain = [], 0, None, []
    for batch in batches:
        for bucket, h, body, keep, n in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (bucket, h):
                if at:
                    out += entries(*at, chain)
                at, chain = (bucket, h), []
            for link in chain:
                if link[0] == body:
                    link[1], link[2] = _smaller(link[1], keep), link[2] + n
                    break
            else:
                chain.append([body, keep, n])
                size += len(body)
            if size > FLUSH // 4:
                if out:
                    yield rows_batch(dict(zip(ENTRY.names, zip(*out))), ENTRY)
                out, size = [], 0
    if at:
        out += entries(*at, chain)
    if out:
        yield rows_batch(dict(zip(ENTRY.names, zip(*out))), ENTRY)


def build_index(docs: DataFrame, capacity: int = 1024, max_depth: int = 20,
                hashes: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """The entries, written to the shared folder: one row per distinct text.

    ``index``: entries of earlier documents, to which ``docs`` are added; a directory that has
    become too small is doubled again. ``hashes``: the rows of ``keys(docs)``, if there already.
    """
    spark = docs.sparkSession
    hashes = (keys(docs) if hashes is None else hashes).select("h")
    if index is not None:
        hashes = hashes.union(index.select("h"))
    where = directory(hashes, capacity, max_depth)
    rows = _partials(docs, where)
    if index is not None:
        bucket = F.udf(where.bucket, "long")
        rows = rows.union(index.select(bucket("h"), "h", "body", "keep_id", "n_rows"))
    n = partitions(spark)
    owner = F.shiftright(F.col("bucket") * n, where.depth).cast("int")  # a range of the directory
    owned = (rows.repartitionById(n, owner).sortWithinPartitions("bucket", "h")
             .mapInArrow(_own, ENTRY_SQL))
    return save(owned, "exact-index")


def exact_dedup(docs: DataFrame, capacity: int = 1024, max_depth: int = 20) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = save(keys(docs), "exact-keys")
    index = build_index(docs, capacity, max_depth, hashes=keyed)
    groups = index.select("h", "sha", "keep_id", F.col("n_rows").alias("group_size"))
    return keyed.join(groups, ["h", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids``; a row without doc_id needs one without."""
    ids = ids.select(F.col("doc_id").alias("_wanted"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_wanted"]), "left_semi")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, of repeated rows too."""
    found = exact_dedup(docs)
    return keep_ids(docs, found.where("kept")).dropDuplicates(["doc_id", "text"])

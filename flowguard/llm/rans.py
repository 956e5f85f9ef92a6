"""Token ids in a binary format: static range asymmetric numeral system (rANS) in blocks.

One frequency table over all documents is shared by all blocks. A block holds whole documents in
order of doc_id; its ids are dealt to ``LANES`` interleaved coders that share one stream of 32-bit
words, so encoder and decoder work on all lanes at once. Blocks know nothing of each other. Each
has a CRC-32 of its ids and one of its stream, and every ``CHECK_STEPS`` steps a checkpoint (lane
states and place in the stream), from which decoding can start within a block.

Files are Parquet folders in the shared folder: ``blocks`` (one row per block, in order of
``part`` and ``block``) and ``table`` (one row per token id). Spark commits them task by task, so a
lost executor's work is done again without a trace.

A null text counts as empty and has the end id alone. Rows that repeat a doc_id stand next to each
other in an order of their own; null ids come first. Empty tables give files without blocks. Other
columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.llm.common import partitions, rows_batch, save, shared_folder, sized, text_column
from flowguard.llm.tokens import crc, with_end, word_table

SCALE_BITS = 20
SCALE = 1 << SCALE_BITS
LOW = 1 << 31
LANES = 1024
CHECK_STEPS = 64
BLOCK_CHARS = 1 << 20
END = 0
COUNTS = pa.schema([("token", pa.int64()), ("n", pa.int64())])
RAW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("width", pa.int32()),
                 ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("ids", pa.binary())])
RAW_SQL = "part int, block int, before long, width int, doc_ids array<long>, doc_lengths array<long>, ids binary"
BLOCKS = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_lengths", pa.list_(pa.int64())), ("payload", pa.binary()), ("payload_crc32", pa.int64()),
    ("ids_crc32", pa.int64()), ("checkpoints", pa.binary()), ("check_words", pa.list_(pa.int64()))])
BLOCKS_SQL = ("part int, block int, before long, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
              "payload binary, payload_crc32 long, ids_crc32 long, checkpoints binary, "
              "check_words array<long>")
DECODED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
DECODED_SQL = "doc_id long, start long, ids binary"


def frequencies(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts scaled to add up to ``SCALE``, 1 at least."""
    if len(tokens) > SCALE // 2:
        raise ValueError("too many different token ids for the scale")
    share = counts * ((SCALE - len(tokens)) / counts.sum())
    out = np.floor(share).astype(np.int64) + 1
    rest = SCALE - int(out.sum())
    out[np.argsort(out - 1 - share, kind="stable")[:rest]] += 1
    return out


@dataclass
class Coder:
    """Tables for both directions; ``tokens`` ascending, with their frequencies."""

    tokens: np.ndarray
    freq: np.ndarray

    def __post_init__(self):
        self.cum = np.cumsum(self.freq) - self.freq
        self._slots = None
        # By token id, for the encoder; ids that are not in the table have frequency 0.
        self._freq_of, self._cum_of = np.zeros((2, int(self.tokens.max(initial=0)) + 1), np.uint64)
        self._freq_of[self.tokens], self._cum_of[self.tokens] = self.freq, self.cum

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, list[int]]:
        """Stream, lane states at each checkpoint, and the checkpoints' places in the stream."""
        if ids.max(initial=0) >= len(self._freq_of) or not (freq := self._freq_of[ids]).all():
            raise ValueError("a token id is not in the frequency table")
        cum = self._cum_of[ids]
        state, bits = np.full(LANES, LOW, np.uint64), np.uint64(SCALE_BITS)
        most = np.uint64((LOW >> SCALE_BITS) << 32)
        words, states, places, written = [], [], [], 0
        for step in range((len(ids) + LANES - 1) // LANES - 1, -1, -1):
            f, c = freq[step * LANES:(step + 1) * LANES], cum[step * LANES:(step + 1) * LANES]
            x = state[:len(f)]
            full = x >= most * f
            words.append(x[full].astype("<u4"))
            written += len(words[-1])
            x = np.where(full, x >> np.uint64(32), x)
            high = x // f
            state[:len(f)] = (high << bits) + (x - high * f) + c
            if step % CHECK_STEPS == 0:
                states.append(state.copy())
                places.append(written)
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        return (stream.tobytes(), np.array(states[::-1], "<u8").reshape(-1, LANES),
                [written - p for p in places[::-1]])

    def decode(self, stream: bytes, state: np.ndarray, place: int, n: int) -> np.ndarray:
        """``n`` ids from a checkpoint on: its lane states and its place in the stream."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.tokens), dtype=np.int32), self.freq)
        words = np.frombuffer(stream, "<u4")
        state, out = state.astype(np.uint64).copy(), np.empty(n, np.uint32)
        freq, cum = self.freq.astype(np.uint64), self.cum.astype(np.uint64)
        bits, low = np.uint64(SCALE_BITS), np.uint64(SCALE - 1)
        for at in range(0, n, LANES):
            x = state[:min(LANES, n - at)]
            slot = x & low
            symbol = self._slots[slot]
            out[at:at + len(x)] = self.tokens[symbol]
            x = freq[symbol] * (x >> bits) + slot - cum[symbol]
            empty = np.flatnonzero(x < LOW)
            x[empty] = x[empty] << np.uint64(32) | words[place:place + len(empty)]
            place += len(empty)
            state[:len(x)] = x
        return out


def _tokenise(path: str):
    """Texts in order to blocks of whole documents with their ids, two bytes each where that will do."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, block = word_table(path, keep_space=True), TaskContext.get().partitionId(), 0
        width, before = 2 if table.encoder.get_vocab_size() <= 1 << 16 else 4, 0
        for batch in batches:
            texts, docs = text_column(batch, "text"), batch.column("doc_id").to_pylist()
            for at in sized(texts, len, BLOCK_CHARS):
                ids, counts = with_end(*table.encode([texts[i] for i in at]), END)
                yield rows_batch({
                    "part": [part], "block": [block], "before": [before], "width": [width],
                    "doc_ids": [[docs[i] for i in at]], "doc_lengths": [counts],
                    "ids": [ids.astype(f"<u{width}").tobytes()]}, RAW)
                block, before = block + 1, before + len(ids)
    return work


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for width, ids in zip(batch.column("width").to_pylist(), batch.column("ids")):
            found = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"), minlength=len(totals))
            if len(found) > len(totals):
                totals = np.pad(totals, (0, len(found) - len(totals)))
            totals += found
    found = np.flatnonzero(totals)
    yield rows_batch({"token": found, "n": totals[found]}, COUNTS)


def train(raw: DataFrame) -> Coder:
    """The shared table, from the ids of all documents."""
    counted = (raw.select("width", "ids").mapInArrow(_count, "token long, n long")
               .groupBy("token").agg(F.sum("n").alias("n")))
    found = sorted(counted.collect())  # one row per id of the vocabulary
    tokens = np.array([t for t, _ in found], np.int64)
    return Coder(tokens, frequencies(tokens, np.array([n for _, n in found], np.int64))
                 if found else tokens)


def _encode(coder):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                ids = np.frombuffer(row["ids"].as_buffer(), f"<u{row['width'].as_py()}").astype(np.uint32)
                stream, states, places = coder.value.encode(ids)
                yield rows_batch({
                    "part": [row["part"].as_py()], "block": [row["block"].as_py()],
                    "before": [row["before"].as_py()], "n_ids": [len(ids)], "doc_ids": [row["doc_ids"].as_py()], "doc_lengths": [row["doc_lengths"].as_py()],
                    "payload": [stream], "payload_crc32": [zlib.crc32(stream)], "ids_crc32": [crc(ids)],
                    "checkpoints": [states.tobytes()], "check_words": [places]}, BLOCKS)
    return work


def write(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode all texts in ascending order of doc_id into ``folder``."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    rows = (docs.select(F.col("doc_id").cast("long"), "text")
            .repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id"))
    raw = save(rows.mapInArrow(_tokenise(path), RAW_SQL), "raw-ids")
    coder = train(raw)
    spark.createDataFrame([(int(t), int(f)) for t, f in zip(coder.tokens, coder.freq)],
                          "token long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    (raw.mapInArrow(_encode(spark.sparkContext.broadcast(coder)), BLOCKS_SQL)
     .write.option("compression", "none").parquet(f"{folder}/blocks"))


def _decode(coder, part_starts):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if zlib.crc32(row["payload"]) != row["payload_crc32"]:
                    raise ValueError(f"stream of part {row['part']}, block {row['block']} is damaged")
                first = np.frombuffer(row["checkpoints"], "<u8", LANES)
                ids = coder.value.decode(row["payload"], first, row["check_words"][0], row["n_ids"])
                if crc(ids) != row["ids_crc32"]:
                    raise ValueError(f"ids of part {row['part']}, block {row['block']} are damaged")
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - row["doc_lengths"]
                yield rows_batch({
                    "doc_id": row["doc_ids"], "start": part_starts.value[row["part"]] + row["before"] + starts,
                    "ids": [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)]}, DECODED)
    return work


def load_coder(spark: SparkSession, folder: str) -> Coder:
    found = sorted(spark.read.parquet(f"{folder}/table").collect())
    return Coder(np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), ids (little-endian, 32 bits)."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    coder = spark.sparkContext.broadcast(load_coder(spark, folder))
    sizes = sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect())  # a row per partition written
    starts, total = {}, 0
    for part, n in sizes:
        starts[part], total = total, total + n
    return blocks.mapInArrow(_decode(coder, spark.sparkContext.broadcast(starts)), DECODED_SQL)


def encode_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-ids")
    write(docs, folder, path)
    return read(spark, folder)

"""Packing by best-fit decreasing into windows of a fixed number of tokens.

A document's ids are cut into full windows and a rest. Pieces of equal length are alike, so the
plan is made on the number of pieces of each length, a table of at most ``capacity`` rows at any
input size: lengths are taken in decreasing order, a segment tree indexed by remaining capacity
finds the tightest open window that still has room, and runs of windows in the same state are
filled together. The result is that of best-fit decreasing piece by piece. A run is filled at most
``log2(capacity)`` times, as what remains falls below half, and a length splits two runs at most,
so the plan has fewer than ``3 * capacity * log2(capacity)`` rows and is broadcast.

Pieces find their place by their number among those of their length: a task numbers its own pieces
while it writes them to the shared folder, and the counts of the tasks before are added.

A null text counts as empty and has the end id alone. Rows that repeat an id are packed each by
itself. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.common import partitions, rows_batch, save, sized, text_column
from flowguard.llm.tokens import crc, with_end, word_table

CAPACITY = 4096
END = 2
KNOWN_WORDS = 700_000  # kept by a worker process: some 120 MB, beside what earlier stages left
PIECES = pa.schema([("part", pa.int32()), ("k", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
                    ("length", pa.int32()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                    ("ids", pa.binary())])
PIECES_SQL = ("part int, k long, doc_id long, start long, length int, doc_tokens long, "
              "ids_crc32 long, ids binary")


class Rooms:
    """Segment tree over remaining capacities: which of them have open windows."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.runs[room].append((first, count))
            at = room + self.size
            while at and not self.tree[at]:
                self.tree[at] = True
                at >>= 1

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            at = room + self.size
            self.tree[at] = False
            while at > 1 and not self.tree[at ^ 1]:
                at >>= 1
                self.tree[at] = False
        return run

    def tightest(self, least: int) -> int | None:
        """Smallest remaining capacity of ``least`` or more that has an open window."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, number of its first piece, first window, pieces per window, offset)."""
    rooms, rows, windows = Rooms(capacity), [], 0
    for length in sorted(counts, reverse=True):
        number, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                each = capacity // length
                first, open_windows, room = windows, -(-left // each), capacity
                windows += open_windows
            else:
                first, open_windows = rooms.take(room)
                each = room // length
            used = min(open_windows, -(-left // each))
            placed = min(left, used * each)
            rows.append((length, number, first, each, capacity - room))
            whole, last = divmod(placed, each)
            rooms.add(room - each * length, first, whole)
            if last:
                rooms.add(room - last * length, first + whole, 1)
            rooms.add(room, first + used, open_windows - used)
            number, left = number + placed, left - placed
    return np.array(rows, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Token ids of all texts as pieces of ``capacity`` at most; ``k`` numbers a task's pieces by length."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = word_table(path, False, KNOWN_WORDS), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts, docs = text_column(batch, "text"), batch.column("doc_id").to_pylist()
            for at in sized(texts, len, 2 << 20):
                ids, counts = with_end(*table.encode([texts[i] for i in at]), END)
                rows, first = [], 0
                for i, n in zip(at, counts.tolist()):
                    for start in range(0, n, capacity):
                        piece = ids[first + start:first + min(n, start + capacity)]
                        rows.append((part, int(seen[len(piece)]), docs[i], start, len(piece), n, crc(piece),
                                     piece.astype("<u4").tobytes()))
                        seen[len(piece)] += 1
                    first += n
                yield rows_batch(dict(zip(PIECES.names, zip(*rows))), PIECES)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, PIECES_SQL)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
         with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, ids_crc32, ids, sequence_id, offset.

    Without ``with_ids`` the ids stay in the written pieces and are not read again.
    """
    cut = save(pieces(docs, path, capacity), "pieces")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    bases = sizes.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = dict(sizes.groupBy("length").agg(F.sum("n")).collect())  # one row per length
    runs = plan(totals, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast((runs, runs[:, 0] << 40 | runs[:, 1]))
    kept = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", *["ids"] * with_ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy()
            _, first_number, window, each, offset = rows[
                np.searchsorted(keys, length << 40 | number, "right") - 1].T
            skip, turn = np.divmod(number - first_number, each)
            columns = [batch.column(c) for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(window + skip), pa.array(offset + turn * length)],
                names=[*(c for c in batch.schema.names if c != "number"), "sequence_id", "offset"])

    numbered = (cut.join(bases.select("part", "length", "base"), ["part", "length"])
                .select(*kept, (F.col("base") + F.col("k")).alias("number")))
    schema = ", ".join(f"{c} {t}" for c, t in cut.select(*kept).dtypes)
    return numbered.mapInArrow(work, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, capacity: int = CAPACITY, fill: int = END) -> DataFrame:
    """The windows themselves: sequence_id, n_tokens, ids (padded unless a power of two)."""
    schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done():
            body = b"".join(held)
            n = len(body) // 4
            if n & (n - 1):
                body += np.full(capacity - n, fill, "<u4").tobytes()
            return rows_batch({"sequence_id": [at], "n_tokens": [n], "ids": [body]}, schema)

        for batch in batches:
            for window, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if window != at:
                    if held:
                        yield done()
                    at, held = window, []
                held.append(ids)
        if held:
            yield done()
    return (packed.select("sequence_id", "offset", "ids")
            .repartition(partitions(packed.sparkSession), "sequence_id")
            .sortWithinPartitions("sequence_id", "offset")
            .mapInArrow(work, "sequence_id long, n_tokens long, ids binary"))

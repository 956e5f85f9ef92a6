"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: 64 bits by majority over the XXH64 of word shingles. Distinct fingerprints are
entered in the index under masked bit patterns: its top nodes are ``most`` + 1 masks that share out the
64 bits, so two fingerprints that differ in ``most`` bits at most meet under at least one node. Below
a node they are sorted by Gray rank, which brings those with long shared patterns together, and
the patterns shared by neighbours are factored into upper nodes level by level. A search walks down
with the differences added up so far and drops a whole node as soon as they exceed the limit.

A top node with more fingerprints than ``node_rows`` is not given to one task: its free bits are
shared out over as many masks again, which loses no pair by the same argument, until it is small
enough; a node with ``f`` free bits holds ``2**f`` fingerprints at most, so this always ends.
Tasks report a spanning forest of the links below a node, never all pairs; components are found
by alternating star contractions over written edge tables.

A null text counts as empty: fingerprint zero, linked like any other. Copies share a fingerprint.
Nodes go by their fingerprint, so doc_id may be any long. A row without doc_id is grouped too, but never
names a group unless all rows of it lack the id. A text of any length is read whole, its shingles
hashed in blocks. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import byte_column, partitions, rows_batch, save
from flowguard.llm.exact_dedup import keep_ids

SEED = 42
FAN_OUT = 8
ALL_BITS = (1 << 64) - 1
FINGERPRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned fingerprint; shingles are hashed out of one joined text, blocks bound memory."""
    words = text.lower().split()  # bytes: A-Z only, and white space as 20 and 09 to 0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, SEED)], "<u8")
    else:
        hashes = np.array([digest(joined[a:b], SEED)
                           for a, b in zip(starts, ends[width - 1:])], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k:k + 65536].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and signed fingerprint of each document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in byte_column(batch, "text")], np.uint64)
            yield rows_batch({"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}, FINGERPRINT)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray code order."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in Gray order with shared patterns above them, ``FAN_OUT`` to a node."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        pattern, mask = fps[self.order], np.full(len(fps), ALL_BITS, np.uint64)
        self.levels = []  # from the fingerprints up: pattern and the bits no upper node has
        while True:
            if len(pattern) == 1:
                self.levels.append((pattern, mask))
                return
            at = np.arange(0, len(pattern), FAN_OUT)
            first = np.repeat(pattern[at], FAN_OUT)[:len(pattern)]
            shared = np.bitwise_and.reduceat(mask, at) & ~np.bitwise_or.reduceat(pattern ^ first, at)
            above = np.repeat(shared, FAN_OUT)[:len(pattern)]
            self.levels.append((pattern, mask & ~above))
            pattern, mask = pattern[at] & shared, shared

    def links(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (into the input) of all pairs that differ in ``most`` bits at most."""
        own = self.levels[0][0]
        left, right = [], []
        for q0 in range(0, len(own), 512):
            query = np.arange(q0, min(q0 + 512, len(own)))
            node, seen = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                pattern, bits = self.levels[depth]
                seen = seen + np.bitwise_count((own[query] ^ pattern[node]) & bits[node])
                last = np.minimum((node + 1) * FAN_OUT ** depth, len(own)) - 1
                good = (seen <= most) & (last > query)  # each pair from its lower place only
                query, node, seen = query[good], node[good], seen[good]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    child = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                    query, seen = np.repeat(query, FAN_OUT), np.repeat(seen, FAN_OUT)
                    good = child < below
                    query, node, seen = query[good], child[good], seen[good]
            left.append(self.order[query])
            right.append(self.order[node])
        return np.concatenate(left), np.concatenate(right)


def forest(ids: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id linked to it) for the fingerprints under one node."""
    turn = np.argsort(ids, kind="stable")
    ids, fps = ids[turn], fps[turn]
    a, b = GrayIndex(fps).links(most)
    if not len(a):
        return ids[:0], ids[:0]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _shares(mask: int, count: int) -> list[int]:
    """The mask with each of ``count`` shares of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(free) * k / count) for k in range(count + 1)]
    return [mask | sum(1 << b for b in free[s:e]) for s, e in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _under(rows: DataFrame, masks: list[int], count: int) -> DataFrame:
    """Each row once under every share of its mask's free bits."""
    choice = F.create_map(*(x for m in masks for x in (
        F.lit(_signed(m)), F.array(*(F.lit(_signed(t)) for t in _shares(m, count))))))
    return (rows.select("fp", "id", F.explode(choice[F.col("mask")]).alias("mask"))
            .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp", "id"))


def _search(most: int):
    """Rows in order of (mask, pattern) to the forests of their nodes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4

        def done(columns):
            mask, pattern, fp, ids = columns
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(mask)]])
            us, vs = [], []
            for s in np.flatnonzero(np.diff(bounds) > 1):
                part = slice(bounds[s], bounds[s + 1])
                u, v = forest(ids[part], fp[part].view(np.uint64), most)
                us.append(u)
                vs.append(v)
            if us:
                yield rows_batch({"u": np.concatenate(us), "v": np.concatenate(vs)}, EDGE)

        for batch in batches:
            columns = [np.concatenate([h, c.to_numpy(zero_copy_only=False)])
                       for h, c in zip(held, batch.columns)]
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1])) \
                if len(columns[0]) else []
            cut = last[-1] + 1 if len(last) else 0  # the last node may go on in the next batch
            held = [c[cut:] for c in columns]
            if cut:
                yield from done([c[:cut] for c in columns])
        if len(held[0]):
            yield from done(held)
    return work


def links(nodes: DataFrame, most: int = 2, node_rows: int = 2048) -> DataFrame:
    """Spanning links (u, v), u > v, between ids of distinct fingerprints (``fp``, ``id``)."""
    spark = nodes.sparkSession
    masks, found = [0], None
    rows = nodes.select(F.lit(0).cast("long").alias("mask"), "fp", "id")
    while True:
        rows = _under(rows, masks, most + 1)
        masks = sorted({t for m in masks for t in _shares(m, most + 1)})
        sizes = rows.groupBy("mask", "pattern").agg(F.count("*").alias("n"))
        large = save(sizes.where(F.col("n") > node_rows), "large-nodes")
        small, any_large = rows, not large.isEmpty()
        if any_large:
            small = rows.join(large, ["mask", "pattern"], "left_anti")
        small = (small.select("mask", "pattern", "fp", "id")
                 .repartition(partitions(spark), "mask", "pattern")
                 .sortWithinPartitions("mask", "pattern")
                 .mapInArrow(_search(most), "u long, v long"))
        found = small if found is None else found.union(small)
        if not any_large:
            return found
        rows = save(rows.join(large.drop("n"), ["mask", "pattern"]).select("mask", "fp", "id"),
                    "node-rows")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of an edge table, root the smallest id that can be reached.

    Large-star and small-star contractions in turn until the edges stay as they are.
    """
    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                              F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        edges = save(near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                     .union(least).distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def near_dedup(docs: DataFrame, width: int = 3, most: int = 2, node_rows: int = 2048) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = save(fingerprints(docs, width), "fingerprints")
    nodes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp", F.col("fp").alias("id")), most, node_rows))
    # The smallest doc_id of each component; only linked fingerprints take part in that.
    linked = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    named = linked.join(nodes, linked["id"] == nodes["fp"]).groupBy("root").agg(F.min("least").alias("of_all"))
    groups = linked.join(named, "root").select(F.col("id").alias("fp"), "of_all", F.lit(True).alias("is_linked"))
    classes = nodes.join(groups, "fp", "left").select("fp", F.when(
        F.col("is_linked"), F.col("of_all")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the smallest doc_id of each component; rows that repeat an id stay together."""
    found = near_dedup(docs, **options)
    return keep_ids(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))

"""Prefix trie of conversations by union-find over the edges between sorted neighbours.

A turn is known by 128 bits of the SHA-256 of its role and text, a conversation by the sequence of
its turns. Sequences are sorted; the edge between two neighbours has the number of turns they share
as its depth. Edges are taken in descending depth: each joins two components, every component
that is joined at a depth becomes a node there that branches, and the depths down to the next join
are its unbranched nodes. The sort is cut into runs of bounded size, each a forest of its own. Nodes
that hold neither the first nor the last sequence of a run are complete. The others, the two outer
paths, are contracted: of each run only its ends, the depth they share, and the depth shared with the
next run are left, and the same union-find over these edges names the parts that are one node, whose
counts are added up.

Sequences are sorted by blocks of ``block`` turns, so no cell grows with a conversation. Where two
conversations or more share a whole block and go on, their next blocks are sorted below that node (one
round per ``block`` turns that are shared); a conversation that goes on alone is a path, written
from its turns directly. Positions are numbered over ranges of (conversation, turn), so a conversation
that holds a third of all rows fills a third of the ranges.

Rows without conv_id belong to no conversation. Turns are taken by turn, null first; of equal turns
that with the smaller digest first, so repeated rows are turns of their own. A null role or text is
empty. Texts are digested and counted before anything is moved, so their length does not matter. An
empty table gives no rows. Other columns are not looked at. The SHA-256 of a node's ends has no
parallel form: ends that fill many runs pass one task in order, as a stream that is never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.common import partitions, rows_batch, save

KEY = 16
BLOCK = 64
RUN_ROWS, RUN_BYTES = 16_384, 1 << 25
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE, UNDER_PATH, PATH, RUN = range(4)  # kinds of rows that a run gives
FOREST = pa.schema([
    ("kind", pa.int32()), ("part", pa.int64()), ("side", pa.int64()), ("conv_id", pa.int64()),
    ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("before", pa.int64()),
    ("ends", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("sums", pa.list_(pa.int64()))])
FOREST_SQL = ("kind int, part long, side long, conv_id long, depth long, parent_conv_id long, n_convs long, "
              "n_children long, n_leaves long, saved long, before long, ends string, first binary, last binary, "
              "sums array<long>")
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def keyed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, key, words of the turns of conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * KEY)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), key, words, written to the shared folder."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key"]
    schema = pa.schema([("range", pa.int32()), ("conv_id", pa.int64()), ("pos", pa.int64()), ("key", pa.binary()),
                        ("words", pa.int64()), ("total", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places within this range; after them how many turns its first and last conversation have."""
        here, first, over, at, n = TaskContext.get().partitionId(), None, None, None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            pos = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            ahead = n if ids[0] == at else 0
            pos[:starts[1] if len(starts) > 1 else None] += ahead
            first = ids[0] if first is None else first
            if over is None and ids[-1] != first:
                over = int((ids == first).sum()) + (ahead or n)
            at, n = ids[-1], int(pos[-1]) + 1
            yield rows_batch({"range": np.full(len(ids), here, np.int32), "conv_id": ids, "pos": pos,
                              "key": batch.column("key"), "words": batch.column("words"),
                              "total": np.zeros(len(ids), bool)}, schema)
        ends = [(int(c), k) for c, k in ((first, over), (at, n)) if c is not None and k is not None]
        yield rows_batch({"range": [here] * len(ends), "conv_id": [c for c, _ in ends], "pos": [k for _, k in ends],
                          "key": [None] * len(ends), "words": [None] * len(ends), "total": [True] * len(ends)}, schema)

    rows = save(turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
                .mapInArrow(work, "range int, conv_id long, pos long, key binary, words long, total boolean"),
                "trie-turns")
    ahead = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # Two rows a range at most; only a conversation that came from the range before is moved on.
    starts = (rows.where("total").select("range", "conv_id", F.coalesce(F.sum("pos").over(ahead), F.lit(0)).alias("s"))
              .where("s > 0"))
    return (rows.where("not total").join(F.broadcast(starts), ["range", "conv_id"], "left")
            .select("conv_id", (F.col("pos") + F.coalesce("s", F.lit(0))).alias("pos"), "key", "words"))


def swap_heads(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations rebuilt on shared heads, and conv_id with its number of turns.

    The first h turns of conversation c give way to those of c - c % ``group``; h = crc32(c) % ``most``.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = (turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("heads"))
             .select(F.col("conv_id").alias("base"), "heads"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("head", head)
    convs = (convs.withColumn("base", base).join(heads, "base", "left")
             .withColumn("heads", F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), 1, most))
             .withColumn("heads", F.filter("heads", lambda x: x["pos"] < F.col("head")))
             .withColumn("kept", F.size("heads").cast("long")))
    convs = save(convs.select("conv_id", "heads", "kept", (F.col("kept") + F.greatest(
        F.col("own") - F.col("head"), F.lit(0))).alias("n")), "trie-conversations")
    own = (turns.where(F.col("pos") >= head).join(convs.select("conv_id", "kept"), "conv_id")
           .select("conv_id", (F.col("pos") - head + F.col("kept")).alias("pos"), "key", "words"))
    shared = convs.select("conv_id", F.inline("heads"))
    return own.unionByName(shared), convs.select("conv_id", "n")


def blocks_of(turns: DataFrame, block: int) -> DataFrame:
    """conv_id, j, seq (keys in order), words of each block of turns."""
    items = F.sort_array(F.collect_list(F.struct("pos", "key", "words")))
    grouped = (turns.groupBy("conv_id", F.floor(F.col("pos") / block).alias("j")).agg(items.alias("t")))
    seq = F.aggregate("t", F.lit(b""), lambda a, x: F.concat(a, x["key"]))
    return save(grouped.select("conv_id", "j", seq.alias("seq"), F.transform("t", lambda x: x["words"]).alias("words")),
                "trie-blocks")


def shared_keys(a: bytes, b: bytes) -> int:
    """Number of keys that two sequences begin with in common."""
    low, high = 0, min(len(a), len(b)) // KEY
    if a[:high * KEY] == b[:high * KEY]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * KEY:middle * KEY] == b[low * KEY:middle * KEY]:
            low = middle
        else:
            high = middle
    return low


class Run:
    """Sorted sequences and the forest over them."""

    def __init__(self, rows: list[tuple], block: int, inner: bool):
        self.rows, self.inner, self.full = rows, inner, block + inner
        self.seqs = [r[0] for r in rows]
        self.size = [len(s) // KEY for s in self.seqs]
        self.on = [len(s) % KEY == 1 for s in self.seqs]  # goes on after this block
        self.ids = [r[1] for r in rows]
        self.top = [r[2] for r in rows]
        self.sums = [np.concatenate([[0], np.cumsum(r[3], dtype=np.int64)]).tolist() if len(r[3]) else [0] for r in rows]
        self.edge = [shared_keys(a, b) for a, b in zip(self.seqs, self.seqs[1:])]

    def forest(self) -> list[list]:
        """Segments [first, last, low, high, n, least id, saved, leaves, children, next ones' children,
        parent segment]: a component at the depths ``low`` to ``high``, in order of completion."""
        n, edge = len(self.rows), self.edge
        up = list(range(n))

        def find(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i
        last, depth, count = list(range(n)), list(self.size), [1] * n
        least = list(self.ids)
        saved = [r[5] for r in self.rows]
        leaves = [r[4] + (not on and (i == n - 1 or edge[i] < size))
                  for i, (r, on, size) in enumerate(zip(self.rows, self.on, self.size))]
        kids = [0] * n
        more = [r[6] for r in self.rows]
        waiting: list[list[int]] = [[] for _ in range(n)]
        segments: list[list] = []

        def lower(i, d):
            """End the component's segment above depth ``d``."""
            if depth[i] > d:
                s = len(segments)
                segments.append([i, last[i], d + 1, depth[i], count[i], least[i], saved[i], leaves[i], kids[i], more[i], -1])
                for child in waiting[i]:
                    segments[child][-1] = s
                waiting[i], depth[i], kids[i], more[i] = [s], d, 1, 0
        for k in sorted(range(n - 1), key=lambda k: -edge[k]):
            d, a, b = edge[k], find(k), find(k + 1)
            lower(a, d)
            lower(b, d)
            up[b], last[a] = a, last[b]  # the left one stays, so a component is named by its first
            count[a] += count[b]
            least[a] = min(least[a], least[b])
            saved[a] += saved[b] + self.sums[k + 1][d]
            leaves[a] += leaves[b]
            kids[a] += kids[b]
            more[a] += more[b]
            if len(waiting[a]) < len(waiting[b]):
                waiting[a], waiting[b] = waiting[b], waiting[a]
            waiting[a] += waiting[b]
            waiting[b] = []
        lower(find(0), -1)
        return segments

    def ended(self, first: int) -> list[int]:
        """Ids of the conversations that are over where the first of them is, ascending."""
        if self.on[first]:
            return []
        e = first + 1
        while e < len(self.seqs) and self.edge[e - 1] == self.size[first] == self.size[e] and not self.on[e]:
            e += 1
        return self.ids[first:e]

    def give(self, part: int) -> dict:
        """Columns of FOREST."""
        out: dict = {c: [] for c in FOREST.names}

        def put(**values):
            for c in out:
                out[c].append(values.get(c))
        n, segments = len(self.rows), self.forest()
        side = [0 if s[0] == 0 else 1 if s[1] == n - 1 else None for s in segments]
        for s, segment in enumerate(segments):
            first, _, low, high, count, least, saved, leaves, kids, more, parent = segment
            ids = ",".join(map(str, self.ended(first))) if high == self.size[first] else ""
            for d in range(max(low, 1 if self.inner else 0), high + 1):
                before = self.sums[first][d - 1] if d else 0
                children = (kids if d == high else 1) + (more if d == high == self.full else 0)
                own = {"part": part, "conv_id": self.top[first] if self.inner and d == 1 else least, "depth": d,
                       "n_convs": count, "n_children": children, "n_leaves": leaves}
                if side[s] is not None:
                    put(kind=PATH, side=side[s], saved=saved, before=before, ends=ids if d == high else "", **own)
                    continue
                own |= {"saved": saved - (count - 1) * before,
                        "ends": hashlib.sha256(ids.encode()).hexdigest() if d == high and ids else EMPTY_SHA}
                if self.inner and d <= 2:  # the node above is the one that all of the class share
                    put(kind=NODE, parent_conv_id=self.top[first], **own)
                elif d > low:
                    put(kind=NODE, parent_conv_id=least, **own)
                elif side[parent] is None:
                    put(kind=NODE, parent_conv_id=segments[parent][5], **own)
                else:
                    put(kind=UNDER_PATH, side=side[parent], **own)
        inner = min(self.edge) if self.edge else self.size[0]
        put(kind=RUN, part=part, depth=inner, first=self.seqs[0], last=self.seqs[-1], sums=self.sums[0])
        return out


def _runs(block: int, inner: bool, run_rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def done():
            return rows_batch(Run(held, block, inner).give(number), FOREST)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist()
                             for c in ("seq", "conv_id", "top", "words", "leaves", "saved", "children"))):
                held.append(row)
                size += 2 * len(row[0])
                if len(held) >= run_rows or size >= RUN_BYTES:
                    yield done()
                    held, size, number = [], 0, number + 1
        if held:
            yield done()
    return work


class Joints:
    """Ends of all runs in order, with the depth that each shares with the next: bounded by the runs."""

    def __init__(self, runs: DataFrame):
        inner = {r["part"]: r["depth"] for r in runs.select("part", "depth").collect()}
        self.parts = parts = np.array(sorted(inner), np.int64)

        def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = np.searchsorted(parts, batch.column("part").to_numpy()) + 1
                there = place < len(parts)
                yield pa.RecordBatch.from_arrays([pa.array(parts[place[there]]), batch.column("last").filter(
                    pa.array(there))], names=["part", "last"])

        schema = pa.schema([("part", pa.int64()), ("shared", pa.int64()), ("words", pa.int64()), ("over", pa.int64())])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for part, a, b, sums in zip(*(c.to_pylist() for c in batch.columns)):
                    k = shared_keys(a, b)
                    rows.append((part, k, sums[k], int(len(a) % KEY == 0 and len(a) // KEY == k)))
                yield rows_batch(dict(zip(schema.names, zip(*rows))) if rows else {c: [] for c in schema.names}, schema)
        lasts = runs.select("part", "last").mapInArrow(after, "part long, last binary")
        met = {r["part"]: r for r in lasts.join(runs.select("part", "first", "sums"), "part")
               .select("part", "last", "first", "sums")
               .mapInArrow(meet, "part long, shared long, words long, over long").collect()}
        none = {"shared": -1, "words": 0, "over": 0}
        self.shared, self.words, self.over = (
            np.array([met.get(p, none)[c] for p in parts.tolist()], np.int64) for c in ("shared", "words", "over"))
        #: Depth of the edge to the end before: a run's last to its first, its first to the run before.
        self.edges = np.full(2 * len(parts), -1, np.int64)
        self.edges[0::2] = self.shared
        self.edges[1::2] = [inner[p] for p in parts.tolist()]

    def names(self, ends: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """First end of the component that each end is in at a depth, by union in descending depth."""
        up = np.arange(len(self.edges)).tolist()

        def find(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i
        order = np.argsort(-self.edges, kind="stable").tolist()
        edges, k, out = self.edges.tolist(), 0, np.empty(len(ends), np.int64)
        for q in np.argsort(-depths, kind="stable").tolist():
            while k < len(order) and edges[order[k]] >= depths[q] and edges[order[k]] >= 0:
                up[find(order[k])] = find(order[k] - 1)
                k += 1
            out[q] = find(int(ends[q]))
        return out


def _contract(joints: Joints):
    """Rows of the outer paths, each with the name of its node and of the node above."""
    schema = pa.schema([(c, pa.int64()) for c in ("name", "above", "place", "depth", "conv_id", "n_convs",
                                                  "n_children", "n_leaves", "saved", "before")]
                       + [("ends", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c).to_numpy() for c in ("part", "side", "depth", "conv_id", "n_convs", "n_children",
                                                           "n_leaves", "saved", "before")}
            run = np.searchsorted(joints.parts, col["part"])
            place, depth = 2 * run + col["side"], col["depth"]
            goes_on = (col["side"] == 0) & (depth <= joints.shared[run])
            yield rows_batch({
                "name": joints.names(place, depth), "above": joints.names(place, depth - 1), "place": place,
                "depth": depth, "conv_id": col["conv_id"], "n_convs": col["n_convs"],
                "n_children": col["n_children"] - (goes_on & (depth < joints.shared[run])),
                "n_leaves": col["n_leaves"] - np.where(goes_on, joints.over[run], 0),
                "saved": col["saved"] + np.where(goes_on, joints.words[run], 0), "before": col["before"],
                "ends": batch.column("ends")}, schema)
    return work


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (name, depth, place) to the SHA-256 of their ends, comma-joined."""
    schema = pa.schema([("name", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    at, state = None, None

    def done():
        return rows_batch({"name": [at[0]], "depth": [at[1]], "ends_sha256": [state.hexdigest()]}, schema)
    for batch in batches:
        for name, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("name", "depth", "ends"))):
            if at != (name, depth):
                if at:
                    yield done()
                at, state = (name, depth), hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
    if at:
        yield done()


def forest(members: DataFrame, block: int, inner: bool, run_rows: int) -> DataFrame:
    """Nodes over ``members`` (seq, conv_id, top, words, leaves, saved, children), depth from 0."""
    spark = members.sparkSession
    n = partitions(spark)
    rows = save(members.repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
                .mapInArrow(_runs(block, inner, run_rows), FOREST_SQL), "trie-forests")
    joints = Joints(rows.where(F.col("kind") == RUN))
    if not len(joints.parts):
        return _final(rows.where(F.lit(False)), F.col("saved"), F.col("ends"))
    paths = save(rows.where(F.col("kind") == PATH)
                 .select("part", "side", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "before", "ends")
                 .mapInArrow(_contract(joints), "name long, above long, place long, depth long, conv_id long, "
                             "n_convs long, n_children long, n_leaves long, saved long, before long, ends string"),
                 "trie-paths")
    ends = (paths.where("ends <> ''").select("name", "depth", "place", "ends").repartition(n, "name", "depth")
            .sortWithinPartitions("name", "depth", "place").mapInArrow(_digest, "name long, depth long, ends_sha256 string"))
    nodes = paths.groupBy("name", "depth").agg(
        F.min("above").alias("above"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("before").alias("before"))
    nodes = save(nodes, "trie-path-nodes")
    least = nodes.select(F.col("name").alias("above"), (F.col("depth") + 1).alias("depth"),
                         F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(least, ["above", "depth"], "left").join(ends, ["name", "depth"], "left")
    of_paths = _final(whole, F.col("saved") - (F.col("n_convs") - 1) * F.col("before"),
                      F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))
    # By the end and depth within a run, so that no node above is the key of more rows than a run has.
    local = paths.select("name", "place", "depth").join(nodes.select("name", "depth", "conv_id"), ["name", "depth"])
    local = local.select("place", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("least"))
    schema = pa.schema([("part", pa.int64()), ("place", pa.int64())])
    parts = joints.parts

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(parts, batch.column("part").to_numpy())
            yield rows_batch({"part": batch.column("part"), "place": 2 * at}, schema)
    by_run = rows.where(F.col("kind") == RUN).select("part").mapInArrow(places, "part long, place long")
    hung = (rows.where(F.col("kind") == UNDER_PATH).drop("parent_conv_id").join(by_run, "part")
            .withColumn("place", F.col("place") + F.col("side")).join(local, ["place", "depth"])
            .withColumnRenamed("least", "parent_conv_id"))
    own = rows.where(F.col("kind") == NODE)
    return of_paths.unionByName(_final(hung, F.col("saved"), F.col("ends"))).unionByName(
        _final(own, F.col("saved"), F.col("ends")))


def _final(rows: DataFrame, saved: Column, ends: Column) -> DataFrame:
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                       saved.alias("saved_tokens"), ends.alias("ends_sha256"))


def _below(found: DataFrame, level: int, block: int) -> DataFrame:
    """Nodes of a forest with their depths in the whole trie; the tops belong to the level above."""
    if not level:
        return found
    return found.where("depth > 1").withColumn("depth", F.col("depth") + (level * block - 1))


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, run_rows: int = RUN_ROWS) -> DataFrame:
    """Nodes of the trie of sequences: ``turns`` (conv_id, pos, key, words), ``convs`` (conv_id, n).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    blocks = blocks_of(turns, block)
    zero = {c: F.lit(0).cast("long") for c in ("leaves", "saved", "children")}
    first = blocks.where("j = 0").drop("j")
    empty = {"seq": F.coalesce("seq", F.lit(b"")), "words": F.coalesce("words", F.array().cast("array<long>"))}
    members = save(convs.join(first, "conv_id", "left").withColumns(empty)
                   .withColumn("top", F.lit(None).cast("long")), "trie-level")
    levels, lone = [], []
    while True:
        level = len(levels)
        levels.append(members)
        end = (level + 1) * block
        name = F.unhex(F.substring(F.sha2(F.col("seq"), 256), 1, 2 * KEY))
        over = members.where(F.col("n") >= end).withColumn("name", name)
        shared = over.groupBy("name").agg(F.sum((F.col("n") > end).cast("long")).alias("going"),
                                          F.min("conv_id").alias("least"))
        going = save(over.where(F.col("n") > end).select("conv_id", "n", "name").join(shared, "name"), "trie-going")
        lone.append(going.where("going = 1").select("conv_id", "n", F.col("least").alias("top")))
        going = going.where("going > 1")
        if going.isEmpty():
            break
        following = blocks.where(F.col("j") == level + 1).drop("j")
        members = save(going.join(following, "conv_id").select(
            "conv_id", "n", F.concat("name", "seq").alias("seq"),
            F.concat(F.array(F.lit(0).cast("long")), F.col("words")).alias("words"), F.col("least").alias("top")),
            "trie-level")
    out, deeper = None, None
    for level in reversed(range(len(levels))):
        end = (level + 1) * block
        alone = lone[level].select("conv_id", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
                                   F.lit(1).cast("long").alias("children"))
        beyond = alone if deeper is None else alone.unionByName(deeper)
        on = F.when(F.col("n") > end, F.lit(b"\x01")).otherwise(F.lit(b""))
        rows = (levels[level].withColumn("seq", F.concat("seq", on)).join(beyond, "conv_id", "left")
                .withColumns({c: F.coalesce(c, z) for c, z in zero.items()}))
        found = forest(rows, block, level > 0, run_rows)
        if level:
            found = save(found, "trie-nodes")
            tops = found.where("depth = 1")
            # What lies below is counted once, at the smallest of the conversations that go on there.
            firsts = levels[level].groupBy("top").agg(F.min("conv_id").alias("rep"))
            deeper = tops.join(firsts, tops["conv_id"] == firsts["top"]).select(
                F.col("rep").alias("conv_id"), F.col("n_leaves").alias("leaves"),
                F.col("saved_tokens").alias("saved"), F.col("n_children").alias("children"))
        nodes = _below(found, level, block).unionByName(_tails(blocks, lone[level], level + 1, block))
        out = nodes if out is None else out.unionByName(nodes)
    return out.select(*OUT)


def _tails(blocks: DataFrame, lone: DataFrame, level: int, block: int) -> DataFrame:
    """The path of each conversation that goes on alone after block ``level - 1``."""
    turns = (blocks.where(F.col("j") >= level).join(lone, "conv_id")
             .select("conv_id", "n", "top", "j", F.posexplode("words").alias("k", "words")))
    depth = F.col("j") * block + F.col("k") + 1
    last = depth == F.col("n")
    one = F.lit(1).cast("long")
    sha = F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY_SHA))
    return turns.select(
        "conv_id", depth.alias("depth"), F.when(depth == level * block + 1, F.col("top")).otherwise(F.col("conv_id"))
        .alias("parent_conv_id"), one.alias("n_convs"), F.when(last, F.lit(0)).otherwise(one).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), sha.alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK, run_rows: int = RUN_ROWS) -> DataFrame:
    """The trie of all conversations as they are."""
    turns = numbered(keyed(conversations))
    return trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("n")), block, run_rows)


def rebuilt_trie(conversations: DataFrame, block: int = BLOCK, run_rows: int = RUN_ROWS) -> DataFrame:
    """The trie of conversations rebuilt on shared heads."""
    turns, convs = swap_heads(numbered(keyed(conversations)))
    return trie(turns, convs, block, run_rows)

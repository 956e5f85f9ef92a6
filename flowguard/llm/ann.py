"""Approximate nearest neighbours by cosine with an adaptive scan of dimensions.

Index: unit vectors are dealt to lists by their nearest centroid and rotated by one random
orthogonal matrix. A list is cut into blocks of at most ``BLOCK`` rows, each held by one task as
column blocks of ``STEP`` rotated dimensions. Search: a query visits the lists nearest to it. Its
squared distance to all rows of a block is added up column block by column block; after each,
the pairs are tested against the query's distance to its fifth nearest so far. Under a random
rotation the share of a squared distance that lies in the first t of D dimensions is Beta(t/2,
(D-t)/2), so a pair whose partial sum is above the ``1 - ALPHA`` quantile for that distance is given
up. What survives all column blocks gets its exact cosine, in double precision, from the original
vectors. The nearest few lists are scanned first to find each query's distance, then the others.

Centroids and the number of visited lists are fitted on a bounded sample (``sample_values`` numbers,
16,384 rows at most, by a hash of the id); every row is indexed. The number of lists to visit is the
one that holds ``recall`` of the sample's true neighbours: some lists where data has clusters,
more than half of them where it is spread evenly. A query that has found fewer than ``k`` rows goes
on to all lists left.

A vector that is null, empty, all zero or holds null or non-finite entries takes no part, nor does
a row without id or one whose vector has another length than most (ties: the longer). Rows that
share an id are one candidate with its best score, and never neighbours of themselves. Ties go to
the smaller id; an empty table gives no rows; a single row finds nothing. Other columns are not
looked at. Memory: one block and a batch of queries in a task; the centroids (1,024 at most) and the
rotation are all that is sent to every task. A list that holds a third of all rows is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.common import hash_sample, partitions, rows_batch, save

STEP = 16
BLOCK = 2048
MOST_LISTS = 1024
ALPHA = 0.001
PAIRS = 1 << 18
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``vec`` of the rows that take part, of any length."""
    found = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return found.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite
                       & F.exists("vec", lambda x: x != 0))


def usual_length(vectors: DataFrame) -> tuple[int, int]:
    """Length that most vectors have, and how many have it."""
    sizes = vectors.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return (first["d"], first["n"]) if first else (0, 0)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a batch as rows, scaled by powers of two so that no square overflows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def rotation(width: int) -> np.ndarray:
    """The same random orthogonal matrix for every run."""
    q, r = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def limits(width: int) -> list[float]:
    """For each column block but the last: the share of a squared distance that the dimensions so
    far exceed with probability ``ALPHA``."""
    grid = (np.arange(1 << 14) + 0.5) / (1 << 14)
    out = []
    for t in range(STEP, width, STEP):
        log = (t / 2 - 1) * np.log(grid) + ((width - t) / 2 - 1) * np.log1p(-grid)
        mass = np.cumsum(np.exp(log - log.max()))
        out.append(float(grid[min(np.searchsorted(mass, (1 - ALPHA) * mass[-1]), len(grid) - 1)]))
    return out


def fit(sample: np.ndarray, lists: int, k: int, recall: float, rounds: int = 8) -> tuple[np.ndarray, int]:
    """Centroids of a sample of unit vectors, and how many lists hold ``recall`` of its neighbours."""
    draw = np.random.default_rng(lists)
    centroids = sample[draw.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        own = (sample @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        size = norms(total)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], centroids)
    own = (sample @ centroids.T).argmax(axis=1)
    asked = draw.choice(len(sample), min(512, len(sample)), replace=False)
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    most = min(k, len(sample) - 1)
    if most < 1:
        return centroids, lists
    best = np.argpartition(-near, most - 1, axis=1)[:, :most]
    to_list = sample[asked] @ centroids.T
    rank = (to_list[:, None, :] > np.take_along_axis(to_list, own[best], axis=1)[:, :, None]).sum(axis=2)
    return centroids, min(lists, int(np.quantile(rank, recall, method="higher")) + 1)


def _lists(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest list of each vector; equal vectors share a list, since each is judged by itself."""
    out = np.empty(len(unit), np.int32)
    for a in range(0, len(unit), 4096):
        out[a:a + 4096] = (unit[a:a + 4096] @ centroids.T).argmax(axis=1)
    return out


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best different ids of each query, nearest first."""
    order = np.lexsort((ids, -score, query))
    query, ids = query[order], ids[order]
    pair = np.lexsort((np.arange(len(ids)), ids, query))  # the first of each (query, id)
    first = np.ones(len(ids), bool)
    same = (query[pair][1:] == query[pair][:-1]) & (ids[pair][1:] == ids[pair][:-1])
    first[pair[1:][same]] = False
    order, query = order[first], query[first]
    start = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    place = np.arange(len(query)) - np.maximum.accumulate(np.where(start, np.arange(len(query)), 0))
    return order[place < k]


class Block:
    """Rows of one block of a list in column blocks."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray):
        self.ids, self.vectors, self.norms, self.turn = ids, vectors, norms(vectors), turn
        self.parts = self.columns(vectors / self.norms[:, None])
        self.limits = limits(vectors.shape[1])

    def columns(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.turn
        return [np.ascontiguousarray(turned[:, a:a + STEP]) for a in range(0, turned.shape[1], STEP)]

    def search(self, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int) -> dict:
        """Rows within ``bound`` (squared distance of unit vectors), the ``k`` best of each query."""
        size = norms(vectors)
        parts = self.columns(vectors / size[:, None])
        limit = bound * (1 + 1e-9) + 1e-12  # rounding must not lose a row that lies on the bound
        q, x = parts[0], self.parts[0]
        far = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * (q @ x.T)
        keep = ids[:, None] != self.ids
        share = self.limits[0] if self.limits else 1.0
        keep &= far <= (limit * share + 1e-12)[:, None]
        a, b = np.nonzero(keep)
        far = far[a, b]
        for j in range(1, len(parts)):
            far += ((parts[j][a] - self.parts[j][b]) ** 2).sum(axis=1)
            share = self.limits[j] if j < len(self.limits) else 1.0
            alive = far <= limit[a] * share
            a, b, far = a[alive], b[alive], far[alive]
        score = (vectors[a] * self.vectors[b]).sum(axis=1) / (size[a] * self.norms[b])
        kept = best(a, self.ids[b], score, k)
        return {"query_id": ids[a[kept]], "vec_id": self.ids[b[kept]], "score": score[kept]}


def _scan(width: int, k: int):
    """Rows in order of (list, block), in each the indexed rows before the queries."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, at, held, block = rotation(width), None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("list", "block", "kind")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            ids, bound = batch.column("id").to_numpy(), batch.column("bound").to_numpy()
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if at != (key[0, s], key[1, s]):
                    at, held, block = (key[0, s], key[1, s]), [], None
                if key[2, s] == 0:
                    held.append((ids[s:e], matrix(batch.column("vec").slice(s, e - s), width)))
                    continue
                if block is None and held:
                    block = Block(*(np.concatenate(x) for x in zip(*held)), turn)
                    held = []
                if block is None:
                    continue  # a list without rows
                step = max(1, PAIRS // len(block.ids))
                for a in range(s, e, step):
                    b = min(a + step, e)
                    yield rows_batch(block.search(
                        ids[a:b], matrix(batch.column("vec").slice(a, b - a), width), bound[a:b], k), FOUND)
    return work


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best different rows of each query."""
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


class Index:
    """All valid rows by list, in the shared folder, and what a search needs to know."""

    def __init__(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5,
                 recall: float = 0.96, sample_values: int = 1 << 20):
        vectors = valid(rows, key, vector)
        self.spark, self.k = rows.sparkSession, k
        self.width, n = usual_length(vectors)
        if not n:
            self.rows = None
            return
        width = self.width
        vectors = vectors.where(F.size("vec") == width)
        most = min(16_384, max(1024, sample_values // width))
        sample = hash_sample(vectors, "id", most, n, "ann").select("vec").limit(2 * most).toArrow()
        if not sample.num_rows:
            sample = vectors.select("vec").limit(1).toArrow()
        sample = matrix(sample.column("vec"), width)
        sample /= norms(sample)[:, None]
        lists = max(1, min(MOST_LISTS, len(sample), int(n ** 0.5)))
        self.centroids, self.visits = fit(sample, lists, k, recall)
        centroids = self.centroids

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("vec"), width)
                own = pa.array(_lists(x / norms(x)[:, None], centroids))
                yield pa.RecordBatch.from_arrays([own, *batch.columns], names=["list", "id", "vec"])

        kind = vectors.schema["vec"].dataType.simpleString()
        self.rows = save(vectors.mapInArrow(deal, f"list int, id long, vec {kind}"), "ann-lists")
        counts = {r["list"]: r["n"] for r in self.rows.groupBy("list").agg(F.count("*").alias("n")).collect()}
        self.blocks = [-(-counts.get(j, 0) // BLOCK) for j in range(lists)]

    def _order(self, queries: DataFrame) -> DataFrame:
        """``queries`` (id, vec) with ``lists``: all lists, nearest first."""
        width, centroids = self.width, self.centroids

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for s in range(0, whole.num_rows, 1024):
                    batch = whole.slice(s, 1024)
                    x = matrix(batch.column("vec"), width)
                    order = np.argsort(-(x @ centroids.T), axis=1, kind="stable").astype(np.int32)
                    cuts = pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32))
                    lists = pa.ListArray.from_arrays(cuts, pa.array(order.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), lists],
                                                     names=["id", "vec", "lists"])
        kind = queries.schema["vec"].dataType.simpleString()
        return queries.select("id", "vec").mapInArrow(work, f"id long, vec {kind}, lists array<int>")

    def _visit(self, queries: DataFrame, first: int, count: int) -> DataFrame:
        """Scan ``count`` lists from place ``first`` of each query's order (id, vec, lists, bound)."""
        blocks = F.array(*(F.lit(b) for b in self.blocks))
        to_list = queries.select("id", "vec", "bound",
                                 F.explode(F.slice("lists", first + 1, count)).alias("list"))
        of_list = F.element_at(blocks, F.col("list") + 1)
        asked = (to_list.where(of_list > 0)
                 .select("list", F.explode(F.sequence(F.lit(0), of_list - 1)).alias("block"),
                         F.lit(1).alias("kind"), "id", "bound", "vec"))
        # The block's number depends on the id alone, so a lost task gives the same blocks again.
        place = F.pmod(F.xxhash64("id"), F.greatest(of_list, F.lit(1)).cast("long")).cast("int")
        held = self.rows.select("list", place.alias("block"), F.lit(0).alias("kind"), "id",
                                F.lit(0.0).alias("bound"), "vec")
        return (held.unionByName(asked).repartition(partitions(self.spark), "list", "block")
                .sortWithinPartitions("list", "block", "kind")
                .mapInArrow(_scan(self.width, self.k), "query_id long, vec_id long, score double"))

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score of the nearest rows found for ``queries`` (id, vec)."""
        empty = self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        if self.rows is None:
            return empty
        ordered = save(self._order(queries), "ann-queries")
        lists, early = len(self.blocks), int(np.ceil(self.visits ** 0.5))
        anyhow = ordered.withColumn("bound", F.lit(4.0))  # the largest there is
        found = save(_ranked(self._visit(anyhow, 0, early), self.k), "ann-early")
        if self.visits > early:
            found = self._closer(ordered, found, early, self.visits - early)
        if lists > self.visits:
            n = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= self.k)
            short = save(ordered.join(n, ordered["id"] == n["query_id"], "left_anti"), "ann-short")
            if not short.isEmpty():
                found = self._closer(short, found, self.visits, lists - self.visits)
        return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def _closer(self, ordered: DataFrame, found: DataFrame, first: int, count: int) -> DataFrame:
        """``found`` with what more lists add within each query's distance so far."""
        kth = found.where(F.col("rank") == self.k).select("query_id", (2 - 2 * F.col("score")).alias("kth"))
        bounded = ordered.join(kth, ordered["id"] == kth["query_id"], "left").select(
            "id", "vec", "lists", F.greatest(F.coalesce("kth", F.lit(4.0)), F.lit(0.0)).alias("bound"))
        more = self._visit(bounded, first, count)
        return save(_ranked(found.select("query_id", "vec_id", "score").unionByName(more), self.k), "ann-found")


def nearest(rows: DataFrame, asked, key: str = "vec_id", vector: str = "embedding", k: int = 5,
            **options) -> DataFrame:
    """Index all of ``rows`` and search it for those whose ``id`` meets the condition ``asked``."""
    index = Index(rows, key, vector, k, **options)
    queries = valid(rows, key, vector).where(asked(F.col("id")))
    if index.rows is not None:
        queries = queries.where(F.size("vec") == index.width)
    return index.search(queries)

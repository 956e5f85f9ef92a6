"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of two neighbouring blocks of ``BLOCK`` words. Terms are the words of the
benchmark, hashed to ``TERMS`` columns; their document frequencies are counted over the blocks of
all documents, and the same pass stores the known terms of each block. A distributed randomised SVD
of the TF-IDF blocks of all documents, next to the benchmark's passages, gives a latent space: tasks
multiply their blocks with the current basis and send partial products of fixed size, which are
added up by stretches of terms. No document is sampled; partial products are rounded to whole parts of
``1 / UNIT``, so that their sum does not depend on the order. Every window of every document is then projected and compared with every
benchmark passage; items are the query set and are taken in blocks of ``ITEM_BLOCK``. Frequencies,
basis and the pass over the documents serve ``GROUP`` blocks at once, which bounds what a task holds;
a larger benchmark takes a round for every ``GROUP * ITEM_BLOCK`` items.

Windows with a cosine of ``least_cosine`` or more are candidates. Neighbouring ones are joined and
widened by the item's length. No common subsequence is longer than the words that region and item
have in common, each as often as in both; where these are too few the pair is given up, else the longest
common subsequence with the item's words is found in the sliding windows that share enough with it. A document is contaminated by an item if that covers ``least_lcs`` of
the item's words, or ``least_para`` of them and ``least_answer`` of its closing words, where a
question has its answer.

A null or empty text has no passage. Items that are null or have no word are no queries. Repeated
items and rows are judged each by itself; of items that cover a document alike all are given. A text of
any length is judged whole, and holds its words once. With an empty benchmark nothing is contaminated;
an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import partitions, rows_batch, save, text_column

BLOCK = 16
TERM_BITS = 14
TERMS = 1 << TERM_BITS
RANK = 64
ROUNDS = 2
ITEM_BLOCK = 2048
GROUP = 16
REGION_WORDS = 1 << 18
TERMS_AT_ONCE = 512
UNIT = 1 << 24
WORDS = re.compile(r"\w+")
GAPS = bytes(c if WORDS.match(chr(c)) else 32 for c in range(128)).ljust(256, b" ")
SUMS = pa.schema([("place", pa.int32()), ("body", pa.binary())])
STORED = pa.schema([("terms", pa.binary()), ("seen", pa.binary())])
JUDGED = pa.schema([("doc_id", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("best_lcs", pa.float64())])


def words_of(text: str) -> list[str]:
    """Runs of word characters in lower case, as ``WORDS`` finds them.

    Where few other characters occur they are made blanks and the text is split there.
    """
    text = text.lower()
    if text.isascii():
        return text.encode().translate(GAPS).decode().split()
    gaps = [c for c in set(text) if not (c.isalnum() or c == "_" or c == " ")]
    if len(gaps) > 24:
        return WORDS.findall(text)
    for c in gaps:
        text = text.replace(c, " ")
    return text.split()


def term_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11) >> (64 - TERM_BITS)


def bits_of(words: list[str]) -> dict[str, int]:
    """For each word the bit set of its places."""
    out: dict[str, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def lcs(bits: dict[str, int], size: int, words: list[str]) -> int:
    """Length of the longest common subsequence, all places of the item at once."""
    full = (1 << size) - 1
    row = full
    for w in words:
        hit = row & bits.get(w, 0)
        row = (row + hit | row - hit) & full
    return size - row.bit_count()


@dataclass
class Items:
    """A block of benchmark items: ids, words, passages as (item, term counts)."""

    ids: list[int]
    words: list[list[str]]

    def __post_init__(self):
        self.terms = {w: term_of(w) for ws in self.words for w in ws}
        self.bits = [bits_of(w) for w in self.words]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        # Different terms of each item and how often it has them.
        self.counts = [np.unique([self.terms[w] for w in ws], return_counts=True) for ws in self.words]
        self.owner, self.passages = [], []
        for k, ws in enumerate(self.words):
            for s in range(0, max(1, len(ws) - BLOCK), BLOCK):
                # Short items are one passage; others windows like those of the documents.
                part = ws if len(ws) <= 3 * BLOCK else ws[s:s + 2 * BLOCK]
                self.owner.append(k)
                self.passages.append(part)
                if part is ws:
                    break
        self.owner = np.array(self.owner)

    def matrix(self, idf: np.ndarray) -> np.ndarray:
        """TF-IDF passages over the terms, rows of length 1."""
        out = np.zeros((len(self.passages), TERMS), np.float32)
        for k, ws in enumerate(self.passages):
            np.add.at(out[k], [self.terms[w] for w in ws], 1)
        out *= idf
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _blocks_of(texts: list[str], terms: dict[str, int]):
    """Terms of all words of the texts (-1: none), the place of each, and blocks per text.

    Every text starts a block of places, so ``place // BLOCK`` is the block of a word.
    """
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.fromiter(map(terms.get, chain.from_iterable(words), repeat(-1)), np.int64, int(sizes.sum()))
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    within = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return words, at, np.repeat(first * BLOCK, sizes) + within, blocks


def _parts(texts: list[str], most: int = 1 << 19) -> Iterator[list[int]]:
    at, size = [], 0
    for k, t in enumerate(texts):
        at.append(k)
        size += len(t)
        if size > most:
            yield at
            at, size = [], 0
    if at:
        yield at


def _sum_blocks(rows: DataFrame, kind: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, body in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(body, kind)
                sums[place] = sums[place] + part if place in sums else part
        for place, part in sums.items():
            yield rows_batch({"place": [place], "body": [part.tobytes()]}, SUMS)
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "place").mapInArrow(work, "place int, body binary")


def _by_block(at: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Known terms of each of ``n`` blocks in order; after them ``TERMS`` for each other place."""
    out = np.full(n * BLOCK, TERMS, np.int16)
    known = at >= 0
    out[place[known]] = at[known]
    return np.sort(out.reshape(n, BLOCK), axis=1)


def _added(numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the ``rows`` that each line of ``numbers`` names; ``len(rows)`` stands for none, behind all others."""
    sums = np.zeros((len(numbers), rows.shape[1]), np.float32)
    for s in range(0, len(numbers), 4096):  # the rows gathered at once are bounded
        part, own = numbers[s:s + 4096], sums[s:s + 4096]
        sizes = (part < len(rows)).sum(axis=1)
        order = np.argsort(-sizes, kind="stable")
        part, out = part[order], np.zeros_like(own)
        counts = np.searchsorted(-sizes[order], -np.arange(numbers.shape[1]), "left")
        # Round k adds the k-th row of those lines that have one.
        for k, m in enumerate(counts.tolist()):
            out[:m] += rows[part[:m, k]]
        own[order] = out
    return sums


def idf_of(docs: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, DataFrame]:
    """Inverse document frequency of each term over the blocks of all documents, and the known terms of these."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            texts = text_column(batch, "text")
            for part in _parts(texts):
                _, at, place, blocks = _blocks_of([texts[k] for k in part], shared.value)
                n = int(blocks.sum())
                rows = _by_block(at, place, n)
                new = rows < TERMS  # a term counts once in its block
                new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
                seen[:TERMS] += np.bincount(rows[new], minlength=TERMS)
                seen[TERMS] += n
                rows = rows[rows[:, 0] < TERMS]
                if len(rows):
                    yield rows_batch({"terms": [rows.tobytes()], "seen": [None]}, STORED)
        yield rows_batch({"terms": [None], "seen": [seen.tobytes()]}, STORED)
    stored = save(docs.select("text").mapInArrow(work, "terms binary, seen binary"), "svd-blocks")
    found = _sum_blocks(stored.where("seen is not null").select(F.lit(0).alias("place"), F.col("seen").alias("body")), "i8").collect()
    seen = np.frombuffer(found[0]["body"], "i8") if found else np.zeros(TERMS + 1)
    return np.log((seen[TERMS] + 1) / (seen[:TERMS] + 1)).astype(np.float32), stored.where("terms is not null").select("terms")


def _windows(at: np.ndarray, place: np.ndarray, blocks: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Latent vectors of length 1 of all windows; a text of b blocks has max(1, b - 1)."""
    sums = _added(_by_block(at, place, int(blocks.sum())), basis)
    last = np.zeros(len(sums), bool)
    last[np.cumsum(blocks)[blocks > 0] - 1] = True
    if len(sums) > 1:
        sums[:-1] += np.where(last[:-1, None], 0, sums[1:])
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return sums  # the last block of a text stands for a window of its own


def _product(of_block: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A' A Q of the TF-IDF blocks A, scaled to length 1, and the basis Q: the terms that occur and their rows.

    ``basis`` comes times idf.
    """
    squares = np.append(idf, np.float32(0)) ** 2
    lengths = squares[of_block].sum(axis=1)
    for s in range(1, BLOCK):  # a term that comes twice weighs twice
        same = (of_block[:, s:] == of_block[:, :-s]) & (of_block[:, s:] < TERMS)
        if not same.any():
            break
        lengths += 2 * (squares[of_block[:, s:]] * same).sum(axis=1)
    y = _added(of_block, basis) / np.maximum(lengths, 1e-9)[:, None]
    # The blocks of each term, ``BLOCK`` at a time.
    flat = of_block.ravel()
    order = np.flatnonzero(flat < TERMS)
    order = order[np.argsort(flat[order], kind="stable")]
    term = flat[order]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    sizes = np.diff(np.append(starts, len(term)))
    lines = -(-sizes // BLOCK)
    first = np.cumsum(lines) - lines
    grid = np.full(int(lines.sum()) * BLOCK, len(y), np.int32)
    grid[_spread(first * BLOCK, sizes)] = order // BLOCK
    term = term[starts].astype(np.int64)
    return term, idf[term, None] * np.add.reduceat(_added(grid.reshape(-1, BLOCK), y), first)


def basis_of(stored: DataFrame, blocks: list[Items], idf: np.ndarray) -> np.ndarray:
    """Randomised SVD: orthonormal basis (terms x rank) of the main directions of all documents and passages."""
    spark = stored.sparkSession
    kept = np.unique(np.fromiter((t for items in blocks for t in items.terms.values()), np.int64))
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.standard_normal((TERMS, RANK), np.float32))[0]
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((kept, idf, idf[:, None] * basis))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, weight, now = shared.value
            place = np.zeros(TERMS, np.int64)
            place[own] = np.arange(len(own))
            product = np.zeros((len(own), RANK), np.int64)
            for batch in batches:
                for body in batch.column("terms"):
                    rows = np.frombuffer(body.as_py(), np.int16).reshape(-1, BLOCK)
                    term, part = _product(rows, weight, now)
                    product[place[term]] += np.rint(part.astype(np.float64) * UNIT).astype(np.int64)
            for s in range(0, len(own), TERMS_AT_ONCE):
                body = product[s:s + TERMS_AT_ONCE]
                if body.any():
                    yield rows_batch({"place": [s], "body": [body.tobytes()]}, SUMS)
        product = np.zeros((TERMS, RANK))
        for place, body in _sum_blocks(stored.mapInArrow(work, "place int, body binary"), "i8").collect():
            product[kept[place:place + TERMS_AT_ONCE]] = np.frombuffer(body, "i8").reshape(-1, RANK) / UNIT
        from_items = np.zeros((TERMS, RANK), np.float32)
        for items in blocks:
            own = items.matrix(idf)
            from_items += own.T @ (own @ basis)
        # The benchmark's passages weigh as much as all documents.
        scale = np.linalg.norm(product) / max(np.linalg.norm(from_items), 1e-9) if product.any() else 1
        basis = np.linalg.qr(product + scale * from_items)[0].astype(np.float32)
    return basis


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _common(at: np.ndarray, lows: np.ndarray, highs: np.ndarray, owners: np.ndarray, items: Items) -> np.ndarray:
    """Words that each stretch ``lows`` to ``highs`` of terms shares with its item, at most as often as in both.

    By term, so never below the true number.
    """
    out = np.zeros(len(lows), np.int64)
    own, row = np.unique(owners, return_inverse=True)
    place = np.full((len(own), TERMS), -1, np.int32)  # of a term among those of its item
    times = []
    for k, item in enumerate(own):
        term, count = items.counts[item]
        place[k, term] = np.arange(len(term))
        times.append(count)
    distinct = np.fromiter(map(len, times), np.int64, len(times))
    first, times = np.cumsum(distinct) - distinct, np.concatenate(times)
    sizes = highs - lows
    weights = np.cumsum(sizes + distinct[row])
    start = 0
    while start < len(lows):  # so many stretches that their words and counters fit
        before = weights[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(weights, before + REGION_WORDS, "right")))
        of = row[start:stop]
        n, bins = sizes[start:stop], distinct[of]
        term = at[_spread(lows[start:stop], n)]
        found = place.ravel()[np.repeat(of * TERMS, n) + term]
        wanted = found >= 0
        base = np.repeat(np.cumsum(bins) - bins, n)
        counts = np.bincount(base[wanted] + found[wanted], minlength=int(bins.sum()))
        shared = np.minimum(counts, times[_spread(first[of], bins)])
        out[start:stop] = np.add.reduceat(shared, np.cumsum(bins) - bins)
        start = stop
    return out


@dataclass
class Judge:
    blocks: list[Items]
    queries: list[np.ndarray]  # passages of each block in the latent space, rows of length 1
    terms: dict[str, int]  # of all blocks
    basis: np.ndarray  # terms x rank, times idf
    least_cosine: float
    least_lcs: float
    least_para: float
    least_answer: float

    def covered(self, items: Items, item: int, words: list[str], terms: np.ndarray,
                upto: np.ndarray) -> tuple[float, bool]:
        """Share of the item's words in the best window of a region, and whether that is contamination.

        ``upto``: places among the known ``terms``, from the region's first word on. Windows that cannot
        reach ``least_para`` are left out, the others taken in the order of what they share with the item at
        most until none left can be better or count.
        """
        own, bits = items.words[item], items.bits[item]
        m = len(own)
        size, step = m + m // 2 + 2, max(1, m // 4)
        starts = np.arange(0, max(1, len(words) - size + step), step)
        lows, highs = upto[starts], upto[np.minimum(starts + size, len(words))]
        starts = starts[highs - lows >= self.least_para * m]
        if not len(starts):
            return 0.0, False
        most = _common(terms, upto[starts], upto[np.minimum(starts + size, len(words))],
                       np.full(len(starts), item), items)
        answer = own[-max(3, m // 5):]
        answer_bits, best, hit = bits_of(answer), 0.0, False
        for k in np.argsort(-most, kind="stable"):
            if most[k] < self.least_para * m or (hit and most[k] <= best * m):
                break
            part = words[starts[k]:starts[k] + size]
            share = lcs(bits, m, part) / m
            best = max(best, share)
            hit = hit or share >= self.least_lcs or (share >= self.least_para and lcs(
                answer_bits, len(answer), part) >= self.least_answer * len(answer))
        return best, hit

    def __call__(self, texts: list[str]) -> list[tuple[list[int], float]]:
        """Contaminating items and best coverage of each text."""
        words, at, place, blocks = _blocks_of(texts, self.terms)
        vectors = _windows(at, place, blocks, self.basis)
        bounds = np.concatenate([[0], np.cumsum(blocks)])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        offset = np.cumsum(sizes) - sizes
        terms, upto = at[at >= 0], np.concatenate([[0], np.cumsum(at >= 0)])  # known words and their places
        found: list[dict] = [{} for _ in texts]
        best = [0.0] * len(texts)
        for items, queries in zip(self.blocks, self.queries):
            rows, cols = [], []
            for s in range(0, len(vectors), 8192):
                r, c = np.nonzero(vectors[s:s + 8192] @ queries.T >= self.least_cosine)
                rows.append(r + s)
                cols.append(items.owner[c])
            rows, cols = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
            if not len(rows):
                continue
            text = np.searchsorted(bounds, rows, "right") - 1
            order = np.lexsort((rows, cols, text))
            text, cols, near = text[order], cols[order], (rows - bounds[text])[order]
            # Windows of one text and item that touch, once widened, are looked at as one.
            reach = items.sizes[cols]
            new = np.r_[True, (text[1:] != text[:-1]) | (cols[1:] != cols[:-1])
                        | ((near[1:] - near[:-1] - 2) * BLOCK > 2 * reach[1:])]
            starts = np.flatnonzero(new)
            last = np.append(starts[1:], len(cols)) - 1
            text, cols, reach = text[starts], cols[starts], reach[starts]
            low = np.maximum(0, near[starts] * BLOCK - reach)
            high = np.minimum(sizes[text], (near[last] + 2) * BLOCK + reach)
            first, stop = upto[offset[text] + low], upto[offset[text] + high]
            enough = np.flatnonzero(stop - first >= self.least_para * reach)
            common = _common(terms, first[enough], stop[enough], cols[enough], items)
            for s in enough[common >= self.least_para * reach[enough]].tolist():
                k, item = int(text[s]), int(cols[s])
                share, hit = self.covered(items, item, words[k][low[s]:high[s]], terms,
                                          upto[offset[k] + low[s]:offset[k] + high[s] + 1])
                best[k] = max(best[k], share)
                if hit:
                    found[k].setdefault((id(items), item), items.ids[item])
        ids = [sorted(hits.values(), key=lambda i: (i is None, i)) for hits in found]
        return list(zip(ids, best))


def judges(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.5, least_lcs: float = 0.8,
           least_para: float = 0.6, least_answer: float = 0.8) -> Iterator[Judge]:
    """One for each ``GROUP`` blocks of items, fitted on all ``docs``."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    known = ((item, words) for item, text in rows.toLocalIterator() if (words := words_of(text)))
    while group := list(islice(known, GROUP * ITEM_BLOCK)):
        blocks = [Items(*map(list, zip(*group[s:s + ITEM_BLOCK]))) for s in range(0, len(group), ITEM_BLOCK)]
        terms = {w: t for items in blocks for w, t in items.terms.items()}
        idf, stored = idf_of(docs, terms)
        basis = basis_of(stored, blocks, idf)
        queries = [items.matrix(idf) @ basis for items in blocks]
        queries = [q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9) for q in queries]
        yield Judge(blocks, queries, terms, idf[:, None] * basis, least_cosine, least_lcs, least_para, least_answer)


def _judge(rows: DataFrame, judge: Judge, with_text: bool) -> DataFrame:
    """Each row by itself: what the judge finds is added to ``item_ids`` and ``best_lcs``."""
    shared = rows.sparkSession.sparkContext.broadcast(judge)
    schema = pa.schema([*JUDGED, ("text", pa.string())]) if with_text else JUDGED

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            found = [f for part in _parts(texts) for f in shared.value([texts[k] for k in part])]
            before = batch.column("item_ids").to_pylist(), batch.column("best_lcs").to_pylist()
            ids = [sorted(old + new, key=lambda i: (i is None, i)) for old, (new, _) in zip(before[0], found)]
            yield rows_batch({"doc_id": batch.column("doc_id"), "item_ids": ids, "text": batch.column("text"),
                              "best_lcs": [max(old, new) for old, (_, new) in zip(before[1], found)]}, schema)
    return rows.mapInArrow(work, "doc_id long, item_ids array<long>, best_lcs double" + ", text string" * with_text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, contaminated, item_ids, best_lcs."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.array().cast("array<long>").alias("item_ids"),
                       F.lit(0.0).alias("best_lcs"))
    found = list(judges(docs, benchmark, **options))
    for k, judge in enumerate(found):
        rows = _judge(rows, judge, with_text=k + 1 < len(found))
    return rows.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "best_lcs")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that no item contaminates; all columns as they are."""
    for judge in list(judges(docs, benchmark, **options)):
        docs = _filter(docs, judge)
    return docs


def _filter(docs: DataFrame, judge: Judge) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            good = [not f[0] for part in _parts(texts) for f in shared.value([texts[k] for k in part])]
            yield batch.filter(pa.array(good, pa.bool_()))
    return docs.mapInArrow(work, docs.schema)

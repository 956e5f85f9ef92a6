"""LM scoring by cross-entropy difference of two matched n-gram models.

A bigram model of the target rows and one of all rows are counted in the same pass, over the same
shared vocabulary, with the same order and smoothing. A document's score is the mean over its tokens
of the target model's loss less the background model's loss: the lower, the more like the target.
A document is judged by the others: its own words and pairs are taken out of both models first, so the score
tells likeness and not who was labelled.

Counts are of true words and pairs, in tables that grow with the corpus; hashes only choose who adds up
a word or a pair. Tasks cut their rows into blocks of ``BLOCK_BYTES`` of text and add up within a block,
so a hot word or pair is one number a block. Words go to their owners as text and come back with an id
and their counts; pairs of ids do the same. Each block then has the counts of all that occurs in it and
looks its losses up. The number of owners grows with the text, so what one of them holds is bounded.

A word has probability (n + 1) / (tokens + vocabulary), where the vocabulary counts as ``WORDS`` words if
it has fewer; what no word takes is left to unseen ones. After a word seen n times another that follows it
k times has (k + PRIOR * P(word)) / (n + PRIOR). Both add up to 1 at most.

Words are runs of non-blanks with A-Z lower-cased; a bigram never spans documents. A null or empty text
has no tokens, and null losses. Rows whose doc_id is null are never target rows. Without any other target
row the target model is uniform. Repeated labels count once, repeated rows are documents of their own and
stay in each other's models; equal texts in the same models have equal scores. A text longer than a block is
a block by itself. Other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import byte_column, partitions, rows_batch, save, shared_folder

WORDS = 1 << 18  # words that a vocabulary counts as, at least
PRIOR = 100.0  # weight of the unigram estimate in the bigram's, in tokens
BLOCK_BYTES, OWNER_BYTES = 8 << 20, 16 << 20  # text of a block, and text whose keys one owner adds up
ID_BITS = 32
PIECE = pa.schema([("owner", pa.int64()), ("path", pa.string()), ("keys", pa.binary()), ("n", pa.binary()),
                   ("n_target", pa.binary())])
SUMMED = pa.schema([*PIECE, ("distinct", pa.int64()), ("tokens", pa.int64()), ("target_tokens", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ce_target", pa.float64()),
                    ("ce_background", pa.float64())])
PIECE_SQL = "owner long, path string, keys binary, n binary, n_target binary"
SUMMED_SQL = f"{PIECE_SQL}, distinct long, tokens long, target_tokens long"
SCORED_SQL = "doc_id long, n_tokens long, ce_target double, ce_background double"


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte by byte as most of the upper ones are equal."""
    return squeeze(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.int64(0)))


def owner_of(keys: np.ndarray, owners: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)).astype(np.int64) % owners


def pieces_of(path: str, owner: np.ndarray, keys, n: np.ndarray, n_target: np.ndarray) -> pa.RecordBatch:
    """A block's keys, which stand in order of their owners, cut up by these."""
    found, first = np.unique(owner, return_index=True)
    parts = [slice(s, e) for s, e in zip(first, [*first[1:], len(owner)])]
    return rows_batch({"owner": found, "path": [path] * len(found), "keys": [keys(p) for p in parts],
                       "n": [pack(n[p]) for p in parts], "n_target": [pack(n_target[p]) for p in parts]}, PIECE)


def _cut(folder: str, owners: int):
    """Rows to blocks: a file of documents and local word ids for each, and pieces of its words."""
    def done(where, root, held):
        ids, flags, texts = zip(*held)
        texts = [t.lower().split() for t in texts]
        words = list(dict.fromkeys(chain.from_iterable(texts)))
        owner = np.fromiter((xxhash.xxh64_intdigest(w) % owners for w in words), np.int64, len(words))
        order = np.argsort(owner, kind="stable")
        words, owner = [words[k] for k in order], owner[order]
        place = {w: k for k, w in enumerate(words)}
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        tokens = np.fromiter(map(place.__getitem__, chain.from_iterable(texts)), np.int32, int(counts.sum()))
        target = np.array(flags, bool)
        row = pa.table({"doc_id": pa.array([ids], pa.large_list(pa.int64()))} | {
            c: pa.LargeListArray.from_arrays([0, len(v)], pa.array(v))
            for c, v in (("target", target), ("counts", counts), ("tokens", tokens))})
        name = uuid.uuid4().hex
        with where.open_output_stream(f"{root}/{name}", compression=None) as out, pa.ipc.new_stream(
                out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(row)
        n, n_target = (np.bincount(x, minlength=len(words)) for x in (tokens, tokens[np.repeat(target, counts)]))
        if not words:  # a piece without keys, so that the block's documents are not forgotten
            return rows_batch({"owner": [0], "path": [f"{folder}/{name}"], "keys": [squeeze(b"")],
                               "n": [pack(n)], "n_target": [pack(n)]}, PIECE)
        return pieces_of(f"{folder}/{name}", owner, lambda p: squeeze(b" ".join(words[p])), n, n_target)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        held, size = [], 0
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("target").to_pylist(),
                           byte_column(batch, "text")):
                held.append(row)
                size += len(row[2]) + 32
                if size >= BLOCK_BYTES:
                    yield done(where, root, held)
                    held, size = [], 0
        if held:
            yield done(where, root, held)
    return work


def block(path: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, target and number of tokens of each document, local word ids of all tokens."""
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name) as stream, pa.ipc.open_stream(stream) as reader:
        row = reader.read_all().combine_chunks()
    ids, *others = (row.column(c).chunk(0).flatten() for c in ("doc_id", "target", "counts", "tokens"))
    return ids.to_pylist(), *(c.to_numpy(zero_copy_only=False) for c in others)


def cut(docs: DataFrame, target_ids: DataFrame, owners: int) -> DataFrame:
    """Words of the blocks of ``docs`` by owner; ``target_ids`` has the doc_id of target rows."""
    wanted = target_ids.select(F.col("doc_id").alias("_wanted")).distinct().withColumn("_hit", F.lit(True))
    # Merged whatever the size of the labels: the same plan, and the same cost per row, everywhere.
    rows = (docs.select(F.col("doc_id").cast("long"), "text")
            .join(wanted.hint("merge"), F.col("doc_id") == F.col("_wanted"), "left")
            .select("doc_id", "text", F.coalesce("_hit", F.lit(False)).alias("target")))
    return save(rows.mapInArrow(_cut(shared_folder(docs.sparkSession, "lm-blocks"), owners), PIECE_SQL), "lm-cut")


def _summed(pieces: dict, at: list[np.ndarray], keys: list[bytes]) -> pa.Table:
    """The pieces with their keys' sums over all of them; ``at`` has the place of each key in the sums."""
    place = np.concatenate(at)
    distinct, totals = int(place.max()) + 1 if len(place) else 0, []
    for c in ("n", "n_target"):
        totals.append(np.zeros(distinct, np.int64))
        np.add.at(totals[-1], place, np.concatenate([unpack(x) for x in pieces[c]]))
    once = [1] + [0] * (len(at) - 1)
    return pa.table({
        "owner": pieces["owner"], "path": pieces["path"], "keys": keys,
        "n": [pack(totals[0][a]) for a in at], "n_target": [pack(totals[1][a]) for a in at],
        "distinct": [distinct * x for x in once], "tokens": [int(totals[0].sum()) * x for x in once],
        "target_tokens": [int(totals[1].sum()) * x for x in once]}, SUMMED)


def _by(rows: DataFrame, key: str):
    return rows.repartition(partitions(rows.sparkSession), key).groupBy(key)


def count_words(pieces: DataFrame, owners: int) -> DataFrame:
    """The pieces with ids in place of the words, and each word's counts in all rows and in target rows."""
    def add(table: pa.Table) -> pa.Table:
        pieces, place = table.to_pydict(), {}
        words = (expand(x).split() for x in pieces["keys"])
        at = [np.fromiter((place.setdefault(w, len(place)) for w in ws), np.int64, len(ws)) for ws in words]
        ids = np.arange(len(place)) * owners + pieces["owner"][0]
        if len(ids) and ids[-1] >> ID_BITS:
            raise OverflowError("two word ids do not fit into one key")
        return _summed(pieces, at, [pack(ids[a]) for a in at])
    return save(_by(pieces, "owner").applyInArrow(add, SUMMED_SQL), "lm-words")


def _columns(pieces: list[dict], *names: str) -> list[np.ndarray]:
    """Columns of a block's pieces, joined in order of their owners."""
    pieces = sorted(pieces, key=lambda r: r["owner"])
    return [np.concatenate([np.zeros(0, np.int64), *(unpack(r[c]) for r in pieces)]) for c in names]


def _pairs(ids: np.ndarray, counts: np.ndarray, tokens: np.ndarray, owners: int) -> tuple:
    """Places of tokens with one before them, keys of the distinct pairs by owner, and each token's among them."""
    text = np.repeat(np.arange(len(counts)), counts)
    second = np.flatnonzero(text[1:] == text[:-1]) + 1
    keys, at = np.unique(ids[tokens[second - 1]] << ID_BITS | ids[tokens[second]], return_inverse=True)
    owner = owner_of(keys, owners)
    order = np.argsort(owner, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return second, keys[order], owner[order], place[at]


def count_pairs(words: DataFrame, owners: int) -> DataFrame:
    """The same for pairs of word ids, without their keys: pieces of all blocks, in order of ``_pairs``."""
    def send(table: pa.Table) -> pa.Table:
        path = table.column("path")[0].as_py()
        _, target, counts, tokens = block(path)
        ids, = _columns(table.to_pylist(), "keys")
        second, keys, owner, at = _pairs(ids, counts, tokens, owners)
        n, n_target = (np.bincount(x, minlength=len(keys)) for x in (at, at[np.repeat(target, counts)[second]]))
        return pa.Table.from_batches([pieces_of(path, owner, lambda p: pack_sorted(keys[p]), n, n_target)])

    def add(table: pa.Table) -> pa.Table:
        pieces = table.to_pydict()
        keys = [np.cumsum(unpack(x)) for x in pieces["keys"]]
        place = np.unique(np.concatenate(keys), return_inverse=True)[1]
        at = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
        return _summed(pieces, at, [b""] * len(at))
    sent = _by(words.select(*PIECE.names), "path").applyInArrow(send, PIECE_SQL)
    return save(_by(sent, "owner").applyInArrow(add, SUMMED_SQL), "lm-pairs")


def _own(text: np.ndarray, keys: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """For each (text, key) how often it occurs; texts stand in order and are taken some at a time."""
    out, span, start = np.empty(len(text), np.int64), int(keys.max(initial=0)) + 1, 0
    while start < len(text):
        stop = int(np.searchsorted(text, text[min(len(text), start + most) - 1], "right"))
        own = (text[start:stop] - text[start]) * span + keys[start:stop]
        _, at, count = np.unique(own, return_inverse=True, return_counts=True)
        out[start:stop] = count[at]
        start = stop
    return out


def losses(words: np.ndarray, tokens: np.ndarray, pairs: np.ndarray, second: np.ndarray, at: np.ndarray,
           total: int, vocabulary: int, own: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Loss of each token: a text's first by its own frequency, others given the word before.

    ``own``: what the token's text has itself of its word, of its pair and of tokens in this model.
    """
    own_words, own_pairs, own_tokens = own
    left = words[tokens] - own_words
    single = (left + 1.0) / (total - own_tokens + vocabulary)
    out = -np.log(single)
    out[second] = -np.log((pairs[at] - own_pairs + PRIOR * single[second]) / (left[second - 1] + PRIOR))
    return out


def score(words: DataFrame, pairs: DataFrame, owners: int) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background, score of every document of the blocks."""
    sums = words.agg(F.sum("distinct"), F.sum("tokens"), F.sum("target_tokens")).first()
    distinct, total, total_target = (x or 0 for x in sums)
    vocabulary = max(WORDS, distinct)

    def work(table: pa.Table) -> pa.Table:
        pieces = table.to_pylist()
        ids, n, n_target = _columns([r for r in pieces if not r["pair"]], "keys", "n", "n_target")
        both, both_target = _columns([r for r in pieces if r["pair"]], "n", "n_target")
        docs, target, counts, tokens = block(pieces[0]["path"])
        second, _, _, at = _pairs(ids, counts, tokens, owners)
        owner, means = np.repeat(np.arange(len(counts)), counts), []
        own = _own(owner, tokens), _own(owner[second], at), counts[owner]
        there = target[owner]  # rows that are no target rows have nothing of their own in its model
        in_target = own[0] * there, own[1] * there[second], own[2] * there
        for single, pair, size, mine in ((n_target, both_target, total_target, in_target), (n, both, total, own)):
            out = losses(single, tokens, pair, second, at, size, vocabulary, mine)
            means.append(np.bincount(owner, out, len(counts)) / np.maximum(counts, 1))
        return pa.Table.from_batches([rows_batch({"doc_id": docs, "n_tokens": counts} | {
            c: pa.array(m, mask=counts == 0) for c, m in zip(("ce_target", "ce_background"), means)}, SCORED)])
    rows = (words.select(*PIECE.names, F.lit(False).alias("pair"))
            .union(pairs.select(*PIECE.names, F.lit(True).alias("pair"))))
    scored = _by(rows, "path").applyInArrow(work, SCORED_SQL)
    return scored.withColumn("score", F.col("ce_target") - F.col("ce_background"))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = partitions(docs.sparkSession) + size // OWNER_BYTES
    words = count_words(cut(docs, target_ids, owners), owners)
    return score(words, count_pairs(words, owners), owners)

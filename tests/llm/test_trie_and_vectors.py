"""The conversation trie, nearest neighbours and whitening against brute force and on odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.llm import ann, queries, trie, whiten

TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


# --- conversation trie -----------------------------------------------------

def brute_trie(rows, swap=True):
    def order(r):
        role, text = r[2] or "", r[3] or ""
        return r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if swap else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes, kids, leaves, saved = {}, {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        words = (len(members) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + words
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest())
                  for p, m in nodes.items())


def found_trie(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def conversations(seed):
    draw = random.Random(seed)
    rows = [(c * 3 - 60, k if draw.random() < .9 else None, draw.choice(["u", "a", None]),
             draw.choice(["a b", "c d  e", "", None]) if seed % 2 else "x y")
            for c in range(50) for k in range(draw.choice([1, 2, 3, 5, 9]))]
    return rows + [(None, 1, "u", "x")] + rows[:15]  # repeated rows are turns of their own


@pytest.mark.parametrize(("seed", "block", "run_rows"), [(1, 64, 16384), (1, 2, 3), (2, 3, 1), (3, 1, 5), (4, 64, 4)])
def test_trie_is_that_of_brute_force(spark, seed, block, run_rows):
    """Small blocks send shared prefixes down the levels, small runs cut nodes over many forests."""
    rows = conversations(seed)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("own") for c in ("key", "words", "pos", "seq", "part")})
    assert found_trie(trie.rebuilt_trie(df, block, run_rows)) == brute_trie(rows)


def test_trie_of_conversations_as_they_are(spark):
    rows = conversations(5)
    assert found_trie(trie.prefix_trie(spark.createDataFrame(rows, TURNS), 64, 6)) == brute_trie(rows, swap=False)


def test_trie_edges(spark):
    assert trie.rebuilt_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.rebuilt_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).count() == 0
    long = [(7, k, "u", f"word {k}" + " and more" * 20_000 * (k == 3)) for k in range(150)]
    twins = [(c, k, "u", str(k % 5)) for c in (2**62, -9) for k in range(130)]  # a prefix over two whole blocks
    alone = [(1, 0, "u", "x")]  # crc32(1) % 4 = 3: the rebuilt conversation has no turn
    rows = long + twins + alone
    assert found_trie(trie.rebuilt_trie(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)


def test_trie_numbers_a_conversation_over_many_ranges(spark):
    rows = [(5, k // 2, "u", str(k)) for k in range(900)] + [(6, 0, "u", "x")]
    got = trie.numbered(trie.keyed(spark.createDataFrame(rows, TURNS).repartition(8))).where("conv_id = 5")
    assert sorted(r.pos for r in got.collect()) == list(range(900))


# --- nearest neighbours ----------------------------------------------------

def brute_nearest(rows, step=50, k=5):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, v in rows:
        if q % step:
            continue
        score = {}
        for i, w in rows:
            if i != q:
                s = float((v * w).sum() / np.sqrt((v * v).sum() * (w * w).sum()))
                score[i] = max(s, score.get(i, -2))
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
        if q not in out or best[0][1] > out[q][0][1]:
            out[q] = best
    return out


def test_nearest_recall_and_scores(spark):
    """Held to brute force over the whole of a table; scores are exact."""
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, got = brute_nearest(rows), {}
    vectors = {i: np.array(v, float) for i, v in rows}
    for r in queries.QUERIES["op12_nearest_neighbours"](spark, folder).collect():
        got.setdefault(r.query_id, []).append(r)
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert r.score == pytest.approx(float(a @ b / np.sqrt((a @ a) * (b @ b))), abs=1e-14)
    assert sorted(got) == sorted(want)
    hit = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hit += len({r.vec_id for r in found} & {i for i, _ in want[q]})
    assert hit >= 0.93 * 5 * len(want)


def test_nearest_in_clusters_visits_few_lists(spark):
    draw = np.random.default_rng(5)
    centers = draw.standard_normal((40, 32))
    rows = [(k, (centers[k % 40] + 0.05 * draw.standard_normal(32)).tolist(), 0) for k in range(4000)]
    index = ann.Index(spark.createDataFrame(rows, VECTORS))
    assert index.visits <= len(index.blocks) // 4
    got = index.search(ann.valid(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding").where("id % 50 = 0"))
    want = brute_nearest([(r[0], np.float32(r[1])) for r in rows])
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & {i for i, _ in best}) / 5 for q, best in want.items()]) >= 0.9


def test_scan_gives_up_early_and_loses_little(spark):
    """The test abandons most pairs before their last column block."""
    draw = np.random.default_rng(1)
    rows = draw.standard_normal((2000, 64))
    block, asked = ann.Block(np.arange(2000), rows, ann.rotation(64)), draw.standard_normal((50, 64))
    unit = rows / ann.norms(rows)[:, None]
    near = np.sort(2 - 2 * (asked / ann.norms(asked)[:, None]) @ unit.T, axis=1)[:, 4]
    found = block.search(np.arange(50) + 10_000, asked, near, 5)
    assert len(found["vec_id"]) >= 0.99 * 250
    shares = ann.limits(64)
    assert [round(s, 2) for s in shares] == sorted(round(s, 2) for s in shares) and 0.4 < shares[0] < 0.6 and shares[2] < 1
    some = draw.beta(8, 24, 200_000)
    assert (some > shares[0]).mean() == pytest.approx(ann.ALPHA, abs=4e-4)


@pytest.mark.parametrize("hot", [False, True])
def test_nearest_odd_rows_ties_and_small_tables(spark, hot):
    nan, inf = float("nan"), float("inf")
    odd = [(100, None, 0), (150, [], 0), (200, [0.0, 0.0, 0.0], 0), (250, [nan, 1.0, 0.0], 0), (300, [inf, 1.0, 0.0], 0),
           (350, [None, 1.0, 2.0], 0), (None, [1.0, 1.0, 1.0], 0), (400, [1.0, 2.0], 0)]
    good = [(0, [1.0, 0.0, 0.0], 0), (50, [1e38, 1e38, 0.0], 0), (3, [2.0, 0.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0),
            (2, [1.0, 0.0, 0.0], 0), (7, [-1.0, 0.0, 0.0], 0), (8, [0.0, 1e-30, 0.0], 0), (-50, [0.5, 0.5, 0.5], 0),
            (2**62, [0.0, 0.0, 3.0], 0)]
    if hot:  # a third and more of all rows alike, over several blocks
        good += [(1000 + 2 * k + 1, [1.0, 1.0, 1.0], 0) for k in range(5000)]
    df = spark.createDataFrame(odd + good, VECTORS).withColumns({c: F.lit("own") for c in ("id", "vec", "list", "rank")})
    got = {}
    for r in ann.nearest(df, lambda i: i % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute_nearest([(i, np.float32(v)) for i, v, _ in good])
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert ann.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 0"), lambda i: i % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id < 0 or vec_id = 7"), lambda i: i % 50 == 0).select("vec_id").collect() == [(7,)]


# --- whitening -------------------------------------------------------------

@pytest.mark.parametrize(("width", "n"), [(1, 9), (2, 3), (7, 60), (24, 200)])
def test_rank_one_updates_give_the_scatter(width, n):
    draw = np.random.default_rng(width)
    rows = draw.standard_normal((n, width)) * draw.uniform(0.1, 50, width)
    rows[n // 2:, :1] = rows[0, 0]
    rows[1] = rows[0]
    whole, parts = whiten.Spectrum(width), [whiten.Spectrum(width), whiten.Spectrum(width), whiten.Spectrum(width)]
    for k, r in enumerate(rows):
        whole.add(r)
        parts[k % 2].add(r)  # the third stays empty
    for other in parts[1:]:
        parts[0].merge(other)
    apart = rows - rows.mean(axis=0)
    for got in (whole, parts[0]):
        assert got.n == n and np.allclose(got.mean, rows.mean(axis=0))
        assert np.allclose(got.vectors * got.values @ got.vectors.T, apart.T @ apart, atol=1e-10 * (apart ** 2).sum())
        assert np.allclose(got.vectors.T @ got.vectors, np.eye(width), atol=1e-12)


def test_secular_roots_interlace():
    draw = np.random.default_rng(3)
    for m in (1, 2, 5, 40):
        d, z = np.sort(draw.uniform(0, 10, m)), draw.standard_normal(m)
        d += np.arange(m) * 1e-9
        roots, apart = whiten.secular(d, z, 0.7)
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z)), atol=1e-12)
        assert (roots >= d).all() and (roots[:-1] <= d[1:]).all() and np.allclose(apart, d[:, None] - roots, atol=1e-12)


def whitened(df):
    rows = df.orderBy("vec_id", "component").collect()
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, []).append(r.whitened)
    return rows, np.array([out[k] for k in sorted(out)])


def direct(x):
    n, total = len(x), x.sum(axis=0)
    apart = x - total / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    return values[::-1], apart @ vectors[:, ::-1], ((n * x - total) ** 2).sum(axis=1)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_whitening_is_that_of_the_covariance(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in table], float)).astype(np.int64) + 100_000
    values, projected, deviations = direct(x)
    rows, got = whitened(queries.QUERIES["op13_embedding_whitening"](spark, f"/root/testdata/{folder}"))
    want = projected[:, :8] / np.sqrt(values[:8])
    assert np.allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-9)
    assert [r.deviation for r in rows[::8]] == deviations.tolist()
    assert {r.n for r in rows} == {len(table)} and len(rows) == 8 * len(table)
    assert np.allclose([r.explained for r in rows[:8]], values[:8] / values.sum(), rtol=1e-10)
    assert {r.identity_error for r in rows}.pop() < 1e-9


def test_whitening_odd_rows(spark):
    nan = float("nan")
    odd = [(1, None, 0), (2, [], 0), (3, [nan, 1.0, 1.0], 0), (4, [None, 1.0, 1.0], 0), (5, [float("inf"), 0.0, 0.0], 0),
           (6, [1.0, 2.0], 0), (7, [1e30, 0.0, 0.0], 0)]
    good = [(10, [0.0, 0.0, 0.0], 0), (11, [-1.0, 0.25, 2.0], 0), (12, [3.0, 0.25, 2.0], 0), (12, [3.0, 0.25, 2.0], 0),
            (13, [0.5, -4.0, 1e6], 0)]
    df = spark.createDataFrame(odd + good, VECTORS).withColumns({c: F.lit("own") for c in ("id", "vec", "n", "k")})
    got = whiten.whiten(df, components=2).orderBy("vec_id", "component").collect()
    x = np.floor(1024 * np.float32([v for _, v, _ in good]).astype(float)).astype(np.int64) + 100_000
    exact = [sum((5 * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for row in x]
    assert [r.vec_id for r in got] == [10, 10, 11, 11, 12, 12, 12, 12, 13, 13]
    assert [r.deviation for r in got[::2]] == [e if e < 2**63 else None for e in exact]
    assert got[0].identity_error < 1e-6
    for nothing in (df.limit(0), df.where("vec_id = 12"), df.where("vec_id < 6")):
        assert whiten.whiten(nothing).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0], 0) for k in range(9)], VECTORS)
    assert whiten.whiten(line).select("component").distinct().collect() == [(1,)]  # one direction varies


def test_whitening_folds_spectra_of_many_tasks(spark):
    draw = np.random.default_rng(9)
    x = np.floor(1024 * draw.standard_normal((300, 6)).astype(np.float32).astype(float))
    df = spark.createDataFrame([(k, (r / 1024).tolist(), 0) for k, r in enumerate(x)], VECTORS).repartition(23)
    values, projected, _ = direct(x.astype(np.int64) + 100_000)
    _, got = whitened(whiten.whiten(df))
    want = projected / np.sqrt(values)
    assert np.allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-9)

"""Client limits against a plain sequential limiter."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from flowguard.operators import limiter


def sequential(requests, limit, seconds):
    """(id, allowed, remaining, retry) for rows of (client, at, id)."""
    window, hits, out = seconds * 1_000_000, {}, {}
    for client, at, key in sorted(requests):
        mine = hits.setdefault(client, deque())
        while mine and mine[0] <= at - window:
            mine.popleft()
        allowed = len(mine) < limit
        if allowed:
            mine.append(at)
        wait = max(1, -((at - window - mine[0]) // 1_000_000))
        out[key] = (allowed, limit - len(mine) if allowed else 0, wait)
    return out


def decided(spark, requests, limit, seconds, partitions):
    frame = spark.createDataFrame(requests, "client string, at bigint, id bigint")
    rows = limiter.batch_decisions(frame, limit, seconds, partitions).collect()
    return {r["id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in rows}


def test_four_requests_at_once(spark):
    rows = [("a", 1_000_000_000, i) for i in range(4)]
    got = decided(spark, rows, 3, 60, 2)
    assert [got[i][:2] for i in range(4)] == [(True, 2), (True, 1), (True, 0), (False, 0)]
    assert got[3][2] == 60


def test_free_again_after_exactly_one_window(spark):
    rows = [("a", 0, 0), ("a", 59_999_999, 1), ("a", 60_000_000, 2), ("b", 1, 3)]
    got = decided(spark, rows, 1, 60, 1)
    assert [got[i][0] for i in range(4)] == [True, False, True, True]


@pytest.mark.parametrize("partitions", [1, 4, 16])
@pytest.mark.parametrize("hot_gap", [50_000, 4_000_000])
def test_hot_client_over_many_partitions(spark, partitions, hot_gap):
    rng, rows, now = random.Random(7), [], 0
    for i in range(1500):
        now += rng.randrange(hot_gap)
        rows.append(("hot", now, i))
    for i in range(1500, 3000):
        rows.append((f"c{rng.randrange(40)}", rng.randrange(10**9), i))
    assert decided(spark, rows, 5, 30, partitions) == sequential(rows, 5, 30)


def test_trailing_counts(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"c{rng.randrange(9)}", rng.randrange(10**8) // 7 * 7, i)
            for i in range(2000)]
    frame = spark.createDataFrame(rows, "client string, at bigint, id bigint")
    got = {(r["client"], r["at"]): r["in_window"] for r in limiter.trailing_hits(frame, 5, ranges=6).collect()}
    for client, at, _ in rows:
        want = sum(1 for c, t, _ in rows if c == client and at - 5_000_000 < t <= at)
        assert got[(client, at)] == want


def test_micros_do_not_follow_the_session_zone(spark):
    frame = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00.000001' AS t")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert frame.select(limiter.micros(F.col("t")).alias("m")).first()["m"] == 1711852200000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)

"""Sliding-window client limits, decided exactly and without one task per client.

A request is admitted when fewer than ``limit`` admitted requests of its client
lie in the window before it; refused requests are not recorded. Whether a
request passes therefore depends on earlier admissions only, and at most
``limit`` of them.

Requests are range-partitioned by (client, time, id), so a client with a third
of all requests is spread over many partitions of equal size. Each partition is
read as a stream of Arrow batches and holds one list of at most ``limit``
times. What a partition needs from its predecessor is that list. The lists are
settled by iteration: every partition starts from a guess, and only partitions
whose incoming list changed are run again. Traffic that falls below the limit
forgets its past, so this usually takes two rounds; a client kept above the
limit across k whole partitions takes up to k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.operators.prefix import running_totals
from flowguard.session import ensure_checkpoint_dir

MICROS = 1_000_000
DECISION = "allowed boolean, remaining int, retry_after bigint"


def micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp since 1970, whatever the session zone."""
    span = ts.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (span.cast("interval second").cast("decimal(30,6)") * MICROS).cast("bigint")


def decide(hits: list[int], times: np.ndarray, limit: int, window: int):
    """Decisions for ordered request times of one client, and the new hit list.

    ``hits`` are earlier admissions, oldest first. Runs of refusals are skipped
    in one step: nothing changes until the oldest hit leaves the window.
    """
    n = len(times)
    allowed = np.zeros(n, dtype=bool)
    remaining = np.zeros(n, dtype=np.int32)
    oldest = np.zeros(n, dtype=np.int64)
    known = np.concatenate([np.asarray(hits, dtype=np.int64), times])
    if len(known) <= limit or (known[limit:] - known[:-limit] >= window).all():
        # No window is ever full: everything passes, and counts follow from positions.
        start = np.searchsorted(known, times - window, side="right")
        allowed[:] = True
        remaining[:] = limit - (np.arange(len(hits), len(known)) - start + 1)
        oldest = known[start]
        kept = known[-limit:]
    else:
        live, i = list(hits), 0
        while i < n:
            now = times[i]
            while live and live[0] <= now - window:
                live.pop(0)
            if len(live) >= limit:
                free = int(np.searchsorted(times, live[0] + window, side="left"))
                oldest[i:free] = live[0]
                i = free
                continue
            live.append(int(now))
            allowed[i], remaining[i], oldest[i] = True, limit - len(live), live[0]
            i += 1
        kept = np.asarray(live[-limit:], dtype=np.int64)
    wait = np.maximum(1, -((times - window - oldest) // MICROS))
    last = times[-1] - window if n else 0
    return allowed, remaining, wait, [int(x) for x in kept if x > last]


def _scan(batches: Iterator[pd.DataFrame], carried: dict, limit: int, window: int):
    """Run through one ordered partition; yields decided batches and the end state."""
    client, hits, first, part, clients = None, [], None, None, 0
    for batch in batches:
        if batch.empty:
            continue
        names = batch["client"].to_numpy()
        times = batch["at"].to_numpy(dtype=np.int64)
        cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
        allowed, remaining, wait = [], [], []
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(names)]):
            if names[a] != client:
                hits = carried.get(int(batch["part"].iloc[0]), []) if client is None else []
                client, clients = names[a], clients + 1
                first, part = (client, int(batch["part"].iloc[0])) if first is None else (first, part)
            ok, left, retry, hits = decide(hits, times[a:b], limit, window)
            allowed.append(ok)
            remaining.append(left)
            wait.append(retry)
        yield batch.assign(allowed=np.concatenate(allowed), remaining=np.concatenate(remaining),
                           retry_after=np.concatenate(wait)), None
    if part is not None:
        yield None, (part, first, client, clients == 1, hits)


def batch_decisions(requests: DataFrame, limit: int = vocab.LIMITER_LIMIT,
                    window_seconds: int = vocab.LIMITER_WINDOW_SECONDS,
                    partitions: int | None = None) -> DataFrame:
    """Decision for every row of ``(client, at, id)``; ``at`` in microseconds."""
    ensure_checkpoint_dir(requests.sparkSession)
    window = window_seconds * MICROS
    order = ["client", "at", "id"]
    by_range = (requests.repartitionByRange(partitions, *order) if partitions
                else requests.repartitionByRange(*order))
    ordered = (by_range.sortWithinPartitions(*order)
               .select(*requests.columns, F.spark_partition_id().alias("part")).checkpoint())

    def ends(carried):
        def run(batches):
            for _, end in _scan(batches, carried, limit, window):
                if end:
                    yield pd.DataFrame([end], columns=["part", "first", "last", "single", "hits"])
        return run

    schema = "part int, first string, last string, single boolean, hits array<bigint>"
    state = {r["part"]: r for r in ordered.mapInPandas(ends({}), schema).collect()}
    carried: dict[int, list[int]] = {}
    while True:
        incoming, before = {}, None
        for p in sorted(state):
            if before and before["last"] == state[p]["first"] and len(before["hits"]):
                incoming[p] = list(before["hits"])
            before = state[p]
        # A partition with several clients ends the same way whatever comes in.
        changed = [p for p in state if state[p]["single"] and incoming.get(p) != carried.get(p)]
        carried = incoming
        if not changed:
            break
        again = ordered.where(F.col("part").isin(changed))
        needed = {p: carried[p] for p in changed if p in carried}
        for r in again.mapInPandas(ends(needed), schema).collect():
            state[r["part"]] = r

    def run(batches):
        for decided, _ in _scan(batches, carried, limit, window):
            if decided is not None:
                yield decided.drop(columns="part")

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return ordered.mapInPandas(run, f"{kept}, {DECISION}")


def trailing_hits(requests: DataFrame, window_seconds: int,
                  ranges: int | None = None) -> DataFrame:
    """Requests of the client in the window ending at each request time.

    Every time adds its hits and takes them back one window later, so the count
    is a running total over (client, time).
    """
    window = window_seconds * MICROS
    hits = requests.groupBy("client", "at").agg(F.count(F.lit(1)).alias("hits"))
    steps = hits.select("client", F.inline(F.array(
        F.struct(F.col("at").alias("at"), F.col("hits").alias("hits"), F.col("hits").alias("step")),
        F.struct((F.col("at") + window).alias("at"), F.lit(0).cast("bigint").alias("hits"),
                 (-F.col("hits")).alias("step")))))
    merged = steps.groupBy("client", "at").agg(F.sum("hits").alias("hits"),
                                               F.sum("step").alias("step"))
    total = running_totals(merged, ["client"], "at", ["step"], ranges)
    return total.where(F.col("hits") > 0).select(
        "client", "at", "hits", F.col("cum_step").alias("in_window"))

"""Structured Streaming: ingest, detection, client limits, audit, active clients.

State stays bounded: windows close behind the watermark, and a client's limiter
state is at most ``limit`` times, dropped when the window has passed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowguard import vocab
from flowguard.operators import detect, limiter, report
from flowguard.session import ensure_checkpoint_dir
from flowguard.sources import landing, listing, load, records


def work_folder(spark: SparkSession) -> str:
    """A fresh folder on the shared storage that checkpoints use."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream; new files are picked up as they land."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start(stream: DataFrame, writer, folder: str, mode: str, once: bool) -> StreamingQuery:
    """Start a query that hands every micro-batch to ``writer(frame, batch_id)``."""
    out = stream.writeStream.outputMode(mode).foreachBatch(writer).option(
        "checkpointLocation", f"{folder}/progress")
    return (out.trigger(availableNow=True) if once else out).start()


READABLE = (".csv", ".json")


def ingest(spark: SparkSession, folder: str, out: str, files_per_read: int = 1000,
           once: bool = True, settle: float = 0) -> StreamingQuery:
    """Parse landed CSV and JSON files and append their flow rows and errors.

    Every landed file, in the folder or below it, ends as rows or as an error: empty files and foreign
    types are told by the listing, the others by the readers, which take up to ``files_per_read`` at a
    time. Rows carry the batch id and a batch's folders are overwritten when it is retried, so a retry
    never doubles rows.
    """
    def write(frame: DataFrame, batch_id: int) -> None:
        session = frame.sparkSession
        files = listing.named(frame).persist()
        try:
            problem = (F.when(F.col("length") == 0, F.lit("empty_file"))
                       .when(~F.col("suffix").isin(*READABLE), F.lit("unsupported_type")))
            (files.select(F.col("path").alias("source_id"), problem.alias("problem")).where("problem is not null")
             .write.mode("overwrite").parquet(f"{out}/errors/batch={batch_id}/kind=file"))
            paths = (r["path"] for r in files.where(problem.isNull()).select("path").orderBy("path").toLocalIterator())
            for part in count():
                some = list(islice(paths, files_per_read))
                if not some:
                    break
                by_suffix = [[p for p in some if p.lower().endswith(s)] for s in READABLE]
                with records.holding():
                    flows, errors = load.load_flows(session, *by_suffix)
                    flows.write.mode("overwrite").parquet(f"{out}/flows/batch={batch_id}/part={part}")
                    errors.write.mode("overwrite").parquet(f"{out}/errors/batch={batch_id}/kind=content-{part}")
        finally:
            files.unpersist()
    return start(landing.stream(spark, folder, settle=settle), write, out, "append", once)


def ingested(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Flow rows and errors of all batches of an ingest."""
    return spark.read.parquet(f"{out}/flows"), spark.read.parquet(f"{out}/errors")


def instant(c: Column) -> Column:
    """A zone-less time as the instant it names in UTC; watermarks need instants."""
    return F.timestamp_micros(limiter.micros(c))


def zoneless(c: Column) -> Column:
    """An instant as its UTC wall-clock time, whatever the session zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c),
                           F.lit("1970-01-01").cast("timestamp_ntz"))


def windowed_verdicts(flows: DataFrame, time: str = "seen_at", width: str = "1 hour",
                      late: str | None = "1 hour") -> DataFrame:
    """One verdict per source and window; works on streams and on tables."""
    flows = flows.withColumn(time, instant(F.col(time)))
    if late is not None:
        flows = flows.withWatermark(time, late)
    keyed = flows.withColumn("w", F.window(time, width))
    verdicts = detect.detect(keyed, ["w", "source_id"])
    return verdicts.select(zoneless(F.col("w.start")).alias("window_start"),
                           *[c for c in verdicts.columns if c != "w"])


def limited(requests: DataFrame, limit: int = vocab.LIMITER_LIMIT,
            window_seconds: int = vocab.LIMITER_WINDOW_SECONDS,
            late: str = "1 minute") -> DataFrame:
    """Live decisions for a stream of ``(client, at, id)``, in order of arrival.

    State is one short list per client, and a client's rows pass through in Arrow
    batches, so a busy client needs time but no memory. The clock of a client
    never runs back: a late row is decided at the time of the last admission.
    A list is dropped once the watermark has passed it by a window.
    """
    window = window_seconds * limiter.MICROS

    def decide(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        hits, last = list(state.get[0]) if state.exists else [], 0
        for frame in frames:
            rows = frame[["client", "at", "id"]].sort_values(["at", "id"], kind="stable")
            times = np.maximum(rows["at"].to_numpy(np.int64), hits[-1] if hits else 0)
            ok, left, wait, hits = limiter.decide(hits, times, limit, window)
            last = max(last, int(times[-1]))
            yield rows.assign(allowed=ok, remaining=left, retry_after=wait)
        state.update((hits,))
        expiry = (last + window) // 1000 + 1
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))

    timed = requests.select("client", "at", "id", F.timestamp_micros("at").alias("ts"))
    return timed.withWatermark("ts", late).groupBy("client").applyInPandasWithState(
        decide, f"client string, at bigint, id bigint, {limiter.DECISION}", "hits array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout)


class Limiter(StatefulProcessor):
    """Decisions of one client in order of request time, once the watermark has passed a request.

    State: the requests that wait for the watermark, and the admissions of the last window, ``limit`` at
    most. One timer at a time: at the first waiting request, or else a window after the last admission,
    where it clears what is left. So a client that is not seen for a window leaves no state.
    """

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id bigint")
        self.hits = handle.getValueState("hits", "hits array<bigint>")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            self.waiting.appendList(list(zip(frame["at"].tolist(), frame["id"].tolist())))
        self._timer(min(at for at, _ in self.waiting.get()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in waiting if r[0] < now]
        hits = list(self.hits.get()[0]) if self.hits.exists() else []
        if due:
            times = np.array([at for at, _ in due], np.int64)
            ok, left, wait, hits = limiter.decide(hits, times, self.limit, self.window)
            yield pd.DataFrame({"client": key[0], "at": times, "id": [i for _, i in due], "allowed": ok,
                                "remaining": left, "retry_after": wait})
        rest = waiting[len(due):]
        hits = [h for h in hits if h > now - self.window]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if hits:
            self.hits.update((hits,))
        else:
            self.hits.clear()
        if rest or hits:
            self._timer(rest[0][0] if rest else hits[-1] + self.window)

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams started inside keep their state in the store that timers and state variables need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


def limited_in_order(requests: DataFrame, limit: int = vocab.LIMITER_LIMIT,
                     window_seconds: int = vocab.LIMITER_WINDOW_SECONDS, late: str = "1 minute") -> DataFrame:
    """Decisions for a stream of ``(client, at, id)`` by request time, as soon as none earlier can come.

    Start it inside ``rocks_state``.
    """
    timed = requests.select("client", "at", "id", F.timestamp_micros("at").alias("ts"))
    return timed.withWatermark("ts", late).groupBy("client").transformWithStateInPandas(
        statefulProcessor=Limiter(limit, window_seconds * limiter.MICROS),
        outputStructType=f"client string, at bigint, id bigint, {limiter.DECISION}",
        outputMode="append", timeMode="EventTime")


def limited_batches(requests: DataFrame, out: str, limit: int = vocab.LIMITER_LIMIT,
                    window_seconds: int = vocab.LIMITER_WINDOW_SECONDS, once: bool = True,
                    late_seconds: int | None = None):
    """Decisions per micro-batch with the distributed operator, for very busy clients.

    The admissions inside a client's last window, by the client's own clock, are
    carried to the next micro-batch as rows and decided again first, which admits
    them again; that is ``limit`` rows a client at most. Requests of a client may
    come in any order inside a micro-batch but not across them. With ``late_seconds``,
    how far a client may lag behind the newest request of all, admissions that no
    request can meet any more are dropped, so the rows carried do not grow with the
    clients ever seen. Every folder is named by its batch and overwritten on a retry.
    """
    schema = f"client string, at bigint, id bigint, carried boolean, {limiter.DECISION}"

    def write(frame: DataFrame, batch_id: int) -> None:
        spark = frame.sparkSession
        rows = frame.select("client", "at", "id", F.lit(False).alias("carried"))
        if batch_id:
            earlier = spark.read.schema(schema).parquet(f"{out}/decided/batch={batch_id - 1}")
            clocks = earlier.groupBy("client").agg(F.max("at").alias("clock"))
            open_hits = earlier.where("allowed").join(clocks, "client").where(
                F.col("at") > F.col("clock") - window_seconds * limiter.MICROS)
            if late_seconds is not None:
                newest = earlier.agg(F.max("at").alias("newest"))  # one row
                open_hits = open_hits.join(F.broadcast(newest), F.col("at") > F.col("newest") - (
                    window_seconds + late_seconds) * limiter.MICROS)
            rows = rows.unionByName(open_hits.select(
                "client", "at", "id", F.lit(True).alias("carried")))
        decided = limiter.batch_decisions(rows, limit, window_seconds)
        decided.write.mode("overwrite").parquet(f"{out}/decided/batch={batch_id}")
    return start(requests.select("client", "at", "id"), write, out, "append", once)


def limited_results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/decided/*").where("NOT carried").drop("carried")


def audit_sink(actions: DataFrame, out: str, enabled: bool = True, once: bool = True):
    """Append known audit actions; unknown ones go to a table of their own."""
    def write(frame: DataFrame, batch_id: int) -> None:
        accepted, rejected = report.audit_entries(frame, enabled)
        accepted.write.mode("overwrite").parquet(f"{out}/audit/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
    return start(actions, write, out, "append", once)


def active_clients(requests: DataFrame, time: str = "ts", width: str = "1 minute",
                   late: str = "5 minutes") -> DataFrame:
    """Requests and clients per window: counted per client first, then over clients."""
    requests = requests.withColumn(time, instant(F.col(time)))
    per_client = (requests.withWatermark(time, late).groupBy(F.window(time, width).alias("v"), "client")
                  .agg(F.count(F.lit(1)).alias("n")))
    return (per_client.groupBy(F.window(F.col("v"), width).alias("w"))
            .agg(F.sum("n").alias("n_requests"), F.count(F.lit(1)).alias("n_clients"))
            .select(zoneless(F.col("w.start")).alias("window_start"), "n_requests", "n_clients"))


def drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now and return the rows it has finished.

    A window is finished, and its state dropped, once the watermark has passed its end.
    """
    folder = work_folder(spark)

    def write(frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
    start(stream, write, folder, "append", True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*")

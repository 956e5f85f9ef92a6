"""Landing folders, streamed ingest, the report store and the timed limiter."""

import pytest
from pyspark.sql import functions as F

from flowguard.operators import limiter
from flowguard.sources import landing, listing, sinks
from flowguard.streaming import jobs


def lay(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


def names(frame, folder):
    return {r["path"].split(folder, 1)[1].lstrip("/"): r["length"] for r in frame.collect()}


def test_files_are_listed_at_any_depth(spark, tmp_path):
    folder = lay(tmp_path / "in", {"a.csv": "x\n", "day/b.csv": "", "day/deep/c.txt": "abc", ".hidden": "x",
                                   "_temporary/d.csv": "x", "day/_SUCCESS": ""})
    assert names(landing.files(spark, folder), folder) == {"a.csv": 2, "day/b.csv": 0, "day/deep/c.txt": 3}
    assert names(landing.files(spark, "file://" + folder, recursive=False), folder) == {"a.csv": 2}
    assert landing.files(spark, folder + "/absent").count() == 0
    assert not landing.reachable("viewfs://store/in") and listing.list_files(spark, folder).count() == 1
    (tmp_path / "in" / "many").mkdir()
    for k in range(30):
        (tmp_path / "in" / "many" / f"{k}.csv").write_text("x")
    old, landing.CHUNK = landing.CHUNK, 7
    try:
        assert sum(b.num_rows for b in landing._walk(landing.Prefix(folder, True))) == 33
    finally:
        landing.CHUNK = old


def test_each_landed_file_ends_as_rows_or_as_an_error(spark, tmp_path):
    folder, out = lay(tmp_path / "in", {"a.csv": "bytes\n1\n2\n", "x/b.json": '[{"bytes": 3}]', "x/empty.csv": "",
                                        "note.txt": "x", "bad.csv": "a,a\n1,2\n"}), str(tmp_path / "out")
    jobs.ingest(spark, folder, out, files_per_read=2).awaitTermination()
    lay(tmp_path / "in", {"y/c.csv": "bytes\n4\n", "y/empty.json": ""})
    jobs.ingest(spark, folder, out, files_per_read=2).awaitTermination()
    jobs.ingest(spark, folder, out).awaitTermination()  # nothing new
    flows, errors = jobs.ingested(spark, out)
    assert sorted(r["total_bytes"] for r in flows.collect()) == [1.0, 2.0, 3.0, 4.0]
    assert {r["source_id"].rsplit("/", 1)[1]: r["problem"] for r in errors.collect()} == {
        "empty.csv": "empty_file", "note.txt": "unsupported_type", "bad.csv": "duplicate_column_name",
        "empty.json": "empty_file"}


def documents(spark, ids):
    rows = spark.createDataFrame([(i, 7, "DoS", 0.9, "High") for i in ids],
                                 "id string, upload_id bigint, attack_type string, confidence double, severity string")
    return rows.withColumn("created_at", F.expr("timestamp_ntz'2024-05-01 10:20:30'"))


def test_one_report_is_read_from_one_file(spark, tmp_path):
    uploads = spark.createDataFrame([(7, "events.csv")], "id bigint, filename string")
    ids, path = [f"p{k}" for k in range(40)], str(tmp_path / "store")
    found = documents(spark, ids)
    sinks.create_reports(spark, found.select("id"), found, uploads, path, 1, "x", run="one", buckets=8)
    sinks.create_reports(spark, found.where("id = 'p3'").select("id"), found, uploads, path, 1, "x", run="two", buckets=8)
    rows = sinks.manifest(spark, path)
    assert rows.count() == 41 and rows.where("export_path is null").count() == 0
    one = sinks.stored_report(spark, path, "p5", buckets=8)
    assert [r["evidence"]["prediction_id"] for r in one.collect()] == ["p5"] and len(one.inputFiles()) == 1
    assert sinks.stored_report(spark, path, "p3", buckets=8).count() == 2
    assert sinks.stored_report(spark, path, "nobody", buckets=8).count() == 0
    there = landing.files(spark, path)
    assert sinks.missing_exports(rows, there).count() == 0
    bucket = rows.where("prediction_id = 'p5'").first()["bucket"]
    gone = sinks.missing_exports(rows, there.where(~F.col("path").contains(f"/csv/run=one/bucket={bucket}/")))
    want = {r["prediction_id"] for r in rows.where(F.col("bucket") == bucket).where("run = 'one'").collect()}
    assert {r["prediction_id"] for r in gone.collect()} == want and "p5" in want


def arrive(spark, folder, *rows):
    frame = spark.createDataFrame([(c, (10_000 + t) * 1_000_000, i) for c, t, i in rows], "client string, at bigint, id bigint")
    frame.coalesce(1).write.mode("append").parquet(folder)


def test_timed_limits_follow_request_time_and_leave_no_state(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    rows_left = []

    def run():
        with jobs.rocks_state(spark):
            query = jobs.start(jobs.limited_in_order(jobs.read_table(spark, folder), 2, 60, late="10 seconds"),
                               lambda f, n: f.write.mode("overwrite").parquet(f"{work}/out/batch={n}"), work, "append", True)
            query.awaitTermination()
        rows_left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    arrive(spark, folder, ("a", 3, 4), ("a", 1, 2), ("b", 2, 3), ("a", 0, 1), ("a", 100, 6), ("a", 60, 5))
    run()
    arrive(spark, folder, ("c", 1000, 7))
    run()
    arrive(spark, folder, ("d", 2000, 8))
    run()
    arrive(spark, folder, ("e", 9000, 9))
    run()
    got = {r["id"]: (r["client"], r["allowed"], r["remaining"]) for r in spark.read.parquet(f"{work}/out/*").collect()}
    assert got == {1: ("a", True, 1), 2: ("a", True, 0), 3: ("b", True, 1), 4: ("a", False, 0), 5: ("a", True, 0),
                   6: ("a", True, 0), 7: ("c", True, 1), 8: ("d", True, 1)}
    assert rows_left[-1] <= rows_left[0] and rows_left[-1] <= 4  # of five clients only the last is kept


@pytest.mark.parametrize("seed", range(3))
def test_timed_limits_are_those_of_the_batch_operator(spark, tmp_path, seed):
    folder = str(tmp_path / "in")
    frame = spark.range(400).select(F.concat(F.lit("c"), (F.rand(seed) * 3).cast("int")).alias("client"),
                                    (F.rand(seed + 9) * 600).cast("long").alias("s"), F.col("id"))
    frame = frame.select("client", ((F.col("s") + 10_000) * 1_000_000).alias("at"), "id").coalesce(1)
    frame.write.parquet(folder)
    rows = spark.read.parquet(folder)
    late = spark.createDataFrame([("z", 10**11, 10**6)], rows.schema)
    late.write.mode("append").parquet(folder)
    with jobs.rocks_state(spark):
        got = jobs.drain(spark, jobs.limited_in_order(jobs.read_table(spark, folder), 5, 60))
    want = limiter.batch_decisions(rows.where("client <> 'z'"), 5, 60)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_batches_carry_only_what_can_still_count(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    for rows in ([("a", 0, 1), ("b", 10, 2)], [("c", 500, 3)], [("c", 530, 4), ("d", 531, 5)]):
        arrive(spark, folder, *rows)
        jobs.limited_batches(jobs.read_table(spark, folder), work, 1, 60, late_seconds=100).awaitTermination()
    decided = [{(r["id"], r["carried"]) for r in spark.read.parquet(f"{work}/decided/batch={k}").collect()} for k in range(3)]
    assert decided == [{(1, False), (2, False)}, {(3, False), (1, True), (2, True)}, {(4, False), (5, False), (3, True)}]
    assert {r["id"]: r["allowed"] for r in jobs.limited_results(spark, work).collect()} == {
        1: True, 2: True, 3: True, 4: False, 5: True}

"""Reports, stored findings, audit and streams on files."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.operators import capture, report
from flowguard.plans import catalog
from flowguard.plans.training import converted
from flowguard.plans.views import view
from flowguard.sources import listing, sinks
from flowguard.streaming import jobs


def findings(spark):
    rows = [("p1", 7, "DoS", 0.95, "Critical"), ("p2", 8, "Benign", 0.7, "Low"),
            ("p3", 7, "Odd", 0.7, "Low"), ("p4", 7, "DoS", 1.5, "Low"), ("p5", 7, "DoS", 0.5, "Worst")]
    return spark.createDataFrame(rows, "id string, upload_id bigint, attack_type string, confidence double, severity string") \
        .withColumn("created_at", F.expr("timestamp_ntz'2024-05-01 10:20:30.5'"))


def test_reports_round_trip(spark, tmp_path):
    uploads = spark.createDataFrame([(7, "events.csv")], "id bigint, filename string")
    wanted = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("absent",)], "id string")
    path = str(tmp_path / "r")
    missing = sinks.create_reports(spark, wanted, findings(spark), uploads, path, 3, "10.0.0.1")
    assert [r["id"] for r in missing.collect()] == ["absent"]
    good, bad = sinks.read_reports(spark, f"{path}/json")
    docs = {r["evidence"]["prediction_id"]: r for r in good.collect()}
    assert set(docs) == {"p1", "p2"} and bad.count() == 0
    assert docs["p1"]["findings"]["summary"] == "Upload 7 shows DoS at 95% confidence, severity Critical."
    assert docs["p1"]["findings"]["requires_immediate_action"]
    assert docs["p2"]["evidence"]["source_filename"] is None
    export = spark.read.option("header", "true").csv(f"{path}/csv")
    rows = {r["field"]: r["value"] for r in export.where("prediction_id = 'p1'").collect()}
    assert rows["evidence.confidence"] == "0.95"
    assert rows["evidence.predicted_at"] == "2024-05-01 10:20:30.500000"
    assert rows["findings.requires_immediate_action"] == "True"
    assert rows["recommendations[0]"].startswith("Page")
    assert spark.read.parquet(f"{path}/audit").count() == spark.read.parquet(f"{path}/rows").count() == 2
    assert sinks.report_by_id(good, "p2").count() == 1
    again = spark.createDataFrame([("p1",)], "id string")
    for _ in range(2):  # a retry of a run replaces that run alone
        sinks.create_reports(spark, again, findings(spark), uploads, path, 3, "x", run="second")
    assert sinks.read_reports(spark, f"{path}/json")[0].count() == 3
    assert spark.read.parquet(f"{path}/rows").count() == spark.read.parquet(f"{path}/audit").count() == 3
    with pytest.raises(PermissionError):
        sinks.create_reports(spark, wanted, findings(spark), uploads, path, 3, "x", enabled=False)


def test_edited_reports_are_malformed(spark, tmp_path):
    uploads = spark.createDataFrame([(7, "events.csv")], "id bigint, filename string")
    path = str(tmp_path / "r")
    sinks.create_reports(spark, spark.createDataFrame([("p1",)], "id string"), findings(spark), uploads,
                         path, 3, "x", audited=False)
    text = spark.read.text(f"{path}/json").first()["value"]
    doc = json.loads(text)
    extra = json.dumps({**doc, "note": "x"})
    inner = json.dumps({**doc, "evidence": {**doc["evidence"], "note": 1}})
    odd = json.dumps({**doc, "evidence": {**doc["evidence"], "attack_type": "Odd"}})
    (tmp_path / "edited").mkdir()
    (tmp_path / "edited" / "a.json").write_text("\n".join([text, extra, inner, odd, "{", "[]"]))
    good, bad = sinks.read_reports(spark, str(tmp_path / "edited"))
    assert (good.count(), bad.count()) == (1, 5)


def test_findings_are_checked_before_storing(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    sinks.store_predictions(findings(spark), good, bad)
    assert spark.read.parquet(good).count() == 3
    assert {r["id"]: r["problem"] for r in spark.read.parquet(bad).collect()} == {
        "p4": "bad_confidence", "p5": "bad_severity"}


def test_exclusions_and_examples_on_disk(spark, sf, tmp_path):
    rows = converted(spark, sf)
    sinks.write_exclusions(capture.exclusions(rows), str(tmp_path / "x"))
    sinks.write_examples(capture.examples(rows), str(tmp_path / "e"))
    total = spark.read.json(str(tmp_path / "x")).count() + spark.read.parquet(str(tmp_path / "e")).count()
    assert total == view(spark, sf, "capture_cells").count()


def test_stored_logs_and_missing_exports(spark):
    files = spark.createDataFrame([("/a.csv", 1)], "path string, length bigint")
    uploads = spark.createDataFrame([(1, "/a.csv", "completed"), (2, "/b.csv", "completed"), (3, "/c.csv", "failed")],
                                    "id int, file_path string, upload_status string")
    found, gone = listing.stored_logs(uploads, files)
    assert ([r["id"] for r in found.collect()], [r["id"] for r in gone.collect()]) == ([1], [2])
    expected = spark.createDataFrame([("/a.csv",), ("/z.csv",)], "path string")
    assert [r["path"] for r in listing.missing_files(expected, files).collect()] == ["/z.csv"]


def test_streamed_ingest_appends_new_files_once(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    (landing / "a.csv").write_text("Flow Duration,bytes\n1,2\n3,4\n")
    (landing / "bad.csv").write_text("a,a\n1,2\n")
    jobs.ingest(spark, str(landing), out).awaitTermination()
    (landing / "b.json").write_text('{"bytes": 5}\n{"bytes": 6}\n')
    jobs.ingest(spark, str(landing), out).awaitTermination()
    flows = spark.read.parquet(f"{out}/flows")
    assert sorted(r["total_bytes"] for r in flows.collect()) == [2.0, 4.0, 5.0, 6.0]
    assert spark.read.parquet(f"{out}/errors").where("problem = 'duplicate_column_name'").count() == 1


def requests_at(spark, seconds):
    return spark.createDataFrame([("a", 10**12 + i * 1_000_000, i) for i in seconds],
                                 "client string, at bigint, id bigint").coalesce(1)


@pytest.mark.parametrize("keyed", [True, False])
def test_streamed_limits_continue_across_batches(spark, tmp_path, keyed):
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")

    def run():
        stream = jobs.read_table(spark, folder)
        if not keyed:
            return jobs.limited_batches(stream, work, 2, 60).awaitTermination()
        return jobs.start(jobs.limited(stream, 2, 60, late="10 minutes"),
                          lambda f, n: f.write.mode("overwrite").parquet(f"{work}/out/batch={n}"),
                          work, "append", True).awaitTermination()
    requests_at(spark, range(3)).write.parquet(folder)
    run()
    requests_at(spark, (3, 60, 61)).write.mode("append").parquet(folder)
    run()
    rows = spark.read.parquet(f"{work}/out/*") if keyed else jobs.limited_results(spark, work)
    assert {r["id"]: r["allowed"] for r in rows.collect()} == {
        0: True, 1: True, 2: False, 3: False, 60: True, 61: True}


def test_a_client_that_lags_behind_others_keeps_its_admissions(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    schema = "client string, at bigint, id bigint"

    def arrive(*rows):
        frame = spark.createDataFrame([(c, t * 1_000_000, i) for c, t, i in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(folder)
        jobs.limited_batches(jobs.read_table(spark, folder), work, 1, 60).awaitTermination()
    arrive(("a", 0, 1))
    arrive(("b", 1000, 2))
    arrive(("a", 30, 3), ("a", 60, 4))
    assert {r["id"]: r["allowed"] for r in jobs.limited_results(spark, work).collect()} == {
        1: True, 2: True, 3: False, 4: True}


def test_reports_are_packed_one_file_a_bucket(spark, tmp_path):
    rows = spark.range(400).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.lit(7).cast("bigint").alias("upload_id"),
        F.lit("DoS").alias("attack_type"), F.lit(0.5).alias("confidence"), F.lit("High").alias("severity"),
        F.expr("timestamp_ntz'2024-05-01 10:20:30.123456'").alias("created_at"))
    uploads = spark.createDataFrame([(7, "events.csv")], "id bigint, filename string")
    sinks.create_reports(spark, rows.select("id"), rows.unionByName(rows), uploads, str(tmp_path), 3, "x", run="r", buckets=16)
    for kind in ("json", "csv"):
        files = [f.name for b in (tmp_path / kind / "run=r").glob("bucket=*") for f in b.glob("part-*")]
        assert len(files) == 16 and all(f.endswith(f".{kind}.gz") for f in files)
    manifest = sinks.manifest(spark, str(tmp_path)).collect()
    assert len(manifest) == 400 == len({r["prediction_id"] for r in manifest})
    for r in manifest:
        assert f"/json/run=r/bucket={r['bucket']}/" in r["report_path"] and f"/csv/run=r/bucket={r['bucket']}/" in r["export_path"]
    assert sinks.stored_report(spark, str(tmp_path), "p9", 16).count() == 2
    export = spark.read.option("header", "true").csv(f"{tmp_path}/csv")
    assert export.count() == sum(10 + len(d["recommendations"]) for d in sinks.read_reports(spark, f"{tmp_path}/json")[0].collect())
    assert {r["value"] for r in export.where("field = 'evidence.predicted_at'").collect()} == {"2024-05-01 10:20:30.123456"}


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_export_texts_are_made_once_in_short_generated_code(spark, sf, capsys, broadcast):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": broadcast}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = catalog.QUERIES["report_export"](spark, sf)
        rows.explain()
        plan = capsys.readouterr().out
        rows.explain("codegen")
        code = capsys.readouterr().out
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert re.search(r"\*\(\d+\) Generate posexplode", plan)
    assert sum("date_format" in line for line in plan.splitlines()) == 1
    # Methods above 8,000 bytes are never compiled by the JVM.
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


def test_export_of_odd_documents(spark):
    at = datetime.datetime(2024, 5, 1, 10, 20, 30)
    stored = spark.createDataFrame(
        [("a", None, "DoS", 0.0005, "High", at), ("b", 2, "Unknown", 5e-05, "Low", at.replace(microsecond=120)),
         ("c", 3, "Benign", 1.0, "Critical", at)],
        "id string, upload_id bigint, attack_type string, confidence double, severity string, created_at timestamp_ntz")
    uploads = spark.createDataFrame([(2, "two.csv")], "id bigint, filename string")
    docs = report.documents(stored, uploads, F.col("created_at"))
    long = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.when(i != 3, i.cast("string")))
    docs = docs.withColumn("recommendations", F.when(F.col("evidence.prediction_id") == "c", long).otherwise(
        F.when(F.col("evidence.prediction_id") == "a", F.col("recommendations"))))
    got = report.export_rows(docs).orderBy("prediction_id", "ordinal").collect()
    a = {r["field"]: r["value"] for r in got if r["prediction_id"] == "a"}
    assert a["findings.summary"] is None and a["evidence.upload_id"] is None and a["evidence.source_filename"] == ""
    assert a["evidence.confidence"] == "0.0005" and a["generated_at"] == "2024-05-01T10:20:30"
    assert [a[f"recommendations[{i}]"] for i in range(3)] == [vocab.ESCALATION_TEXT % "High", *vocab.GUIDANCE["DoS"]]
    assert not [r for r in got if r["prediction_id"] == "b"]  # a document without the list has no rows
    c = [r for r in got if r["prediction_id"] == "c"]
    assert [r["ordinal"] for r in c] == list(range(30))
    assert [(r["field"], r["value"]) for r in c[10:]] == [
        (f"recommendations[{i}]", None if i == 2 else str(i + 1)) for i in range(20)]
    whole = report.export_rows(report.documents(stored, uploads, F.col("created_at"))).where("prediction_id = 'b'").collect()
    b = {r["field"]: r["value"] for r in whole}
    assert b["evidence.confidence"] == "5e-05" and b["evidence.predicted_at"] == "2024-05-01 10:20:30.000120"
    assert b["generated_at"] == "2024-05-01T10:20:30.000120" and b["evidence.source_filename"] == "two.csv"

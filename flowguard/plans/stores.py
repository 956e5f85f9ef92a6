"""Queries: the given tables through landing folders, stores and their manifests, and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.operators import dataset, limiter, model
from flowguard.plans import traffic
from flowguard.plans.detection import VERDICT_SQL
from flowguard.plans.readers import CAPTURE_HEADERS, FLOW_COLUMNS, HAS_CELL, SPELLINGS, write_csv
from flowguard.plans.registry import ORACLES, query
from flowguard.plans.relational import DOCS_SQL
from flowguard.plans.streams import request_stream
from flowguard.plans.training import CONVERTED_SQL, example_rows
from flowguard.plans.views import view
from flowguard.sources import landing, load, sinks
from flowguard.streaming import jobs

FILES = 20


def _file_number(path):
    return F.nullif(F.regexp_extract(path, "k=([0-9]+)", 1), F.lit("")).cast("bigint")


def _write_logs(spark, sf, folder: str) -> None:
    """One CSV file for each number that sources leave when divided by ``FILES``."""
    rows = view(spark, sf, "flows").select(
        (F.col("source_id") % FILES).alias("k"), *[F.col(c).alias(s) for c, s in zip(FLOW_COLUMNS, SPELLINGS)])
    (rows.repartition(FILES, "k").write.partitionBy("k").option("header", "true")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(folder))


@query("ingest_files", views="flows", oracle=f"""
SELECT 'log' AS kind, source_id % {FILES} AS k, NULL AS problem, COUNT(*) AS n_rows FROM flows WHERE {HAS_CELL} GROUP BY 2
UNION ALL SELECT DISTINCT 'note', source_id % {FILES}, 'unsupported_type', 0 FROM flows
UNION ALL SELECT 'empty', NULL, 'empty_file', 0""")
def ingest_files(spark, sf):
    """A row for each landed file, at any depth: logs, files of a foreign type, an empty file."""
    folder = jobs.work_folder(spark)
    _write_logs(spark, sf, f"{folder}/in/logs")
    numbers = view(spark, sf, "flows").select((F.col("source_id") % FILES).alias("k")).distinct()
    numbers.withColumn("value", F.lit("x")).repartition(FILES, "k").write.partitionBy("k").text(f"{folder}/in/notes")
    spark.range(0).select(F.lit("x").alias("value")).coalesce(1).write.option("header", "false").csv(f"{folder}/in/empty")
    jobs.ingest(spark, f"{folder}/in", f"{folder}/out", files_per_read=8).awaitTermination()
    flows, errors = jobs.ingested(spark, f"{folder}/out")
    told = flows.groupBy("source_id").agg(F.count("*").alias("n_rows")).join(errors, "source_id", "full")
    kind = (F.when(F.col("source_id").contains("/logs/"), "log").when(F.col("source_id").contains("/notes/"), "note")
            .otherwise("empty"))
    return told.select(kind.alias("kind"), _file_number("source_id").alias("k"), "problem",
                       F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


@query("landing_files", views="flows", oracle=f"""
SELECT DISTINCT source_id % {FILES} AS k, TRUE AS has_bytes FROM flows""")
def landing_files(spark, sf):
    """The visible files of a folder, listed by tasks."""
    folder = jobs.work_folder(spark)
    _write_logs(spark, sf, folder)
    return landing.files(spark, folder).select(_file_number("path").alias("k"), (F.col("length") > 0).alias("has_bytes"))


@query("detect_uploads", views="flows", oracle=f"""
, filed AS (SELECT * REPLACE (source_id % {FILES} AS source_id) FROM flows WHERE {HAS_CELL})
""" + VERDICT_SQL.replace("FROM flows", "FROM filed") + f"""
SELECT source_id AS upload_id, attack_type, confidence, severity, matched_rules, row_count AS records_analysed, NULL AS problem
FROM final WHERE source_id % 5 < 3
UNION ALL SELECT DISTINCT source_id, NULL, NULL, NULL, NULL, NULL, CASE source_id % 5 WHEN 3 THEN 'not_ready_processing'
  ELSE 'not_ready_failed' END FROM filed WHERE source_id % 5 >= 3
UNION ALL SELECT -1, NULL, NULL, NULL, NULL, NULL, 'file_unavailable'""")
def detect_uploads(spark, sf):
    """Uploaded files by their state; one of them is gone."""
    folder = jobs.work_folder(spark)
    _write_logs(spark, sf, folder)
    k = _file_number("path")
    status = F.when(k % 5 < 3, "completed").when(k % 5 == 3, "processing").otherwise("failed")
    uploads = landing.files(spark, folder).select(k.alias("id"), F.col("path").alias("file_path"), status.alias("upload_status"))
    gone = spark.range(1).select(F.lit(-1).cast("bigint"), F.lit(f"{folder}/gone.csv"), F.lit("completed"))
    out = load.upload_outcomes(spark, uploads.union(gone), csv_paths=[folder])
    return out.withColumn("matched_rules", F.array_join("matched_rules", "; "))


@query("load_training_set", views="capture_cells", oracle=CONVERTED_SQL + "".join(f"""
{union}SELECT '{reader}' AS reader, label, CAST(label_code AS TINYINT) AS label_code, {", ".join(vocab.FEATURES)} FROM used"""
    for union, reader in (("", "capture"), ("UNION ALL ", "generic"))))
def load_training_set(spark, sf):
    """Training sets from folders: captures, and their sound rows as generic logs."""
    folder, out = jobs.work_folder(spark), []
    write_csv(view(spark, sf, "capture_cells").select(
        *[F.col(c).alias(h) for c, h in CAPTURE_HEADERS.items()]), f"{folder}/capture", ",")
    rows = example_rows(spark, sf)
    write_csv(rows.select("label", *[F.get("features", F.lit(i)).cast("double").alias(s)
                                     for i, s in enumerate(SPELLINGS[1:])]), f"{folder}/generic", ";")
    for reader in ("capture", "generic"):
        examples = load.load_training(spark, f"{folder}/{reader}", reader).examples
        out.append(examples.select(F.lit(reader).alias("reader"), "label", F.col("label_code").cast("tinyint").alias("label_code"), *[
            F.get("features", F.lit(i)).cast("double").alias(f) for i, f in enumerate(vocab.FEATURES)]))
    return out[0].unionByName(out[1])


@query("training_manifest", views="capture_cells", oracle=CONVERTED_SQL + """
SELECT t.k AS label_code, COUNT(*) FILTER (WHERE used.label_code = t.k) AS n_rows, COUNT(*) AS n_all, TRUE AS complete,
  CAST(SUM(CAST('0x' || substr(md5(row_key), 1, 8) AS BIGINT)) AS BIGINT) AS digest
FROM used, (SELECT unnest(range(0, 8)) AS k) t GROUP BY 1""")
def training_manifest(spark, sf):
    """The manifest of a written training set, which reading it again confirms."""
    folder = jobs.work_folder(spark)
    sinks.write_training_set(example_rows(spark, sf), folder, dataset.Completeness())
    _, completeness = sinks.read_training_set(spark, folder)
    said = spark.read.schema(sinks.MANIFEST).json(f"{folder}/manifest")
    return said.select(F.posexplode("class_rows").alias("label_code", "n_rows"), F.col("n_rows").alias("n_all"),
                       F.lit(completeness.complete).alias("complete"), "digest").select(
        F.col("label_code").cast("bigint").alias("label_code"), "n_rows", "n_all", "complete", "digest")


@query("training_run", views="capture_cells", oracle=CONVERTED_SQL + """
SELECT 'random_forest' AS model_name, '1' AS version, (SELECT COUNT(*) FROM used) AS rows_trained, TRUE AS dataset_complete,
  label, COUNT(*) AS n_rows, 200 AS n_trees FROM used GROUP BY label""")
def training_run(spark, sf):
    """A fit of 200 trees, published as the first version and loaded again."""
    registry = f"{jobs.work_folder(spark)}/registry"
    fitted, run = model.train(example_rows(spark, sf), completeness=dataset.Completeness())
    model.publish(spark, fitted, registry, model.current_version(spark, registry))
    loaded, metadata = model.load_version(spark, registry)
    return model.describe_run(spark, run | {"version": metadata.version}).withColumn(
        "n_trees", F.lit(loaded.stages[-1].getNumTrees))


@query("sources_below_coverage", views="capture_cells", oracle=CONVERTED_SQL + """
SELECT source_id, COUNT(DISTINCT label_code) AS n_classes FROM used GROUP BY source_id HAVING COUNT(DISTINCT label_code) < 8""")
def sources_below_coverage(spark, sf):
    return dataset.sources_below_coverage(example_rows(spark, sf), 8)


@query("combined_sets", views="capture_cells", oracle=CONVERTED_SQL + """
SELECT source_id, row_key, label FROM used""")
def combined_sets(spark, sf):
    """The examples of two sets as one."""
    rows = example_rows(spark, sf)
    parts = [rows.where("label_code < 4"), rows.where("label_code >= 4")]
    return dataset.combine(parts).select("source_id", "row_key", "label")


WHOLE_SQL = " AND ".join(f"{f} IS NOT NULL" for f in vocab.FEATURES)


@query("feature_vectors", views="flows", oracle=f"""
SELECT row_key, {", ".join(f"CAST(CAST({f} AS REAL) AS DOUBLE) AS {f}" for f in vocab.FEATURES)} FROM flows WHERE {WHOLE_SQL}""")
def feature_vectors(spark, sf):
    """Vectors of the rows that have all features, in their fixed order."""
    rows = view(spark, sf, "flows").where(WHOLE_SQL).select("row_key", dataset.feature_vector().alias("vector"))
    return rows.select("row_key", *[F.get("vector", F.lit(i)).cast("float").cast("double").alias(f)
                                    for i, f in enumerate(vocab.FEATURES)])


@query("capture_exclusions_read", views="capture_cells", oracle=CONVERTED_SQL + f"""
, placed AS (SELECT source_id % {FILES} AS k, row_key, ROW_NUMBER() OVER (PARTITION BY source_id % {FILES} ORDER BY row_key) - 1 AS row_idx
  FROM capture_cells)
SELECT placed.k, row_idx, code FROM coded JOIN placed USING (row_key) WHERE code IS NOT NULL""")
def capture_exclusions_read(spark, sf):
    """Rows left out of capture files, with their place in the file; written and read as a table."""
    folder = jobs.work_folder(spark)
    rows = view(spark, sf, "capture_cells").withColumn("k", F.col("source_id") % FILES)
    (rows.repartition(FILES, "k").sortWithinPartitions("k", "row_key")
     .select("k", *[F.col(c).alias(h) for c, h in CAPTURE_HEADERS.items()]).write.partitionBy("k").option("header", "true")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{folder}/files"))
    sinks.write_exclusions(load.load_captures(spark, f"{folder}/files").exclusions, f"{folder}/left-out")
    return spark.read.json(f"{folder}/left-out").select(
        _file_number("source_id").alias("k"), F.col("row_idx").cast("bigint").alias("row_idx"), "code")


def _reported(spark, sf, folder: str) -> None:
    predictions = view(spark, sf, "predictions")
    wanted = predictions.select("id").unionByName(spark.range(1).select(F.lit("absent").alias("id")))
    missing = sinks.create_reports(spark, wanted, predictions, view(spark, sf, "uploads"), folder, 7, "10.0.0.1", run="all")
    missing.write.parquet(f"{folder}/missing")


BUCKET_SQL = f"CAST(CAST('0x' || substr(md5(prediction_id), 1, 8) AS BIGINT) % {sinks.BUCKETS} AS INTEGER)"


@query("stored_reports", views="predictions uploads", oracle=DOCS_SQL + f"""
SELECT prediction_id, upload_id, source_filename, attack_type, confidence, severity, predicted_at, summary,
  requires_immediate_action, array_to_string(recs, ' | ') AS recommendations, {BUCKET_SQL} AS bucket,
  TRUE AS in_its_files, 'report.generated' AS action_performed FROM docs
UNION ALL SELECT 'absent', {", ".join(["NULL"] * 12)}""")
def stored_reports(spark, sf):
    """All findings as reports: documents read back, the manifest's files for each, its audit entry, ids without finding."""
    folder = jobs.work_folder(spark)
    _reported(spark, sf, folder)
    file = F.regexp_extract(F.col("_metadata.file_path"), "bucket=([0-9]+)", 1).cast("int")
    exported = (spark.read.schema(sinks.EXPORT).option("header", "true").csv(f"{folder}/csv").where("ordinal = 1")
                .select(F.col("value").alias("prediction_id"), file.alias("_file"))
                .groupBy("prediction_id").agg(F.min("_file").alias("_low"), F.max("_file").alias("_high")))
    audit = spark.read.parquet(f"{folder}/audit").select("action_performed").distinct()
    documents = sinks.read_reports(spark, f"{folder}/json")[0].select(
        "evidence.*", "findings.*", F.array_join("recommendations", " | ").alias("recommendations"))
    sound = (F.col("_low") == F.col("bucket")) & (F.col("_high") == F.col("bucket")) & F.col("report_path").contains(
        "bucket=") & F.col("export_path").isNotNull()
    filed = sinks.manifest(spark, folder).join(exported, "prediction_id").select(
        "prediction_id", "bucket", sound.alias("in_its_files"))
    # Ids alone are compared; documents, which are long, meet only what is wrong with some.
    own = sinks.bucket_of(F.col("prediction_id"))
    odd = documents.select("prediction_id").join(filed, "prediction_id", "left").where(
        ~F.coalesce(F.col("in_its_files") & (F.col("bucket") == own), F.lit(False))).distinct().persist()
    if odd.isEmpty():
        out = documents.select("*", own.alias("bucket"), F.lit(True).alias("in_its_files"))
    else:
        told = documents.join(odd.withColumn("_odd", F.lit(True)), "prediction_id", "left")
        out = told.where("_odd is null or bucket is not null").withColumn("in_its_files", F.when(
            F.col("_odd").isNull(), True).otherwise(F.col("in_its_files"))).withColumn(
            "bucket", F.when(F.col("_odd").isNull(), own).otherwise(F.col("bucket"))).drop("_odd")
    out = out.crossJoin(F.broadcast(audit))  # one row: all entries are of one action
    gone = spark.read.parquet(f"{folder}/missing").select(F.col("id").alias("prediction_id"))
    return out.unionByName(gone, allowMissingColumns=True)


@query("missing_exports", views="predictions uploads", oracle=DOCS_SQL + f"""
SELECT prediction_id, bucket FROM (SELECT DISTINCT prediction_id, {BUCKET_SQL} AS bucket FROM docs) WHERE bucket % 5 = 3""")
def missing_exports(spark, sf):
    """Reports whose export is gone: the last run wrote none for a fifth of the buckets."""
    folder = jobs.work_folder(spark)
    _reported(spark, sf, folder)
    documents = sinks.read_reports(spark, f"{folder}/json")[0].withColumn(
        "bucket", sinks.bucket_of(F.col("evidence.prediction_id")))
    sinks.write_exports(documents.where("bucket % 5 <> 3"), f"{folder}/kept", "all")
    # The files of the kept run are named by bucket, as those of the manifest are.
    def by_bucket(path):
        return F.concat(F.lit("bucket-"), F.regexp_extract(path, "bucket=([0-9]+)", 1))
    rows = sinks.manifest(spark, folder).withColumn("export_path", by_bucket(F.col("export_path")))
    there = landing.files(spark, f"{folder}/kept").select(by_bucket(F.col("path")).alias("path")).distinct()
    return sinks.missing_exports(rows, there).select("prediction_id", "bucket")


@query("store_predictions", views="predictions", oracle="""
SELECT id, upload_id, attack_type, confidence, severity, CASE WHEN severity NOT IN ('Low', 'Medium', 'High', 'Critical') THEN 'bad_severity'
  WHEN NOT confidence BETWEEN 0 AND 1 THEN 'bad_confidence' END AS problem FROM predictions""")
def store_predictions(spark, sf):
    """Findings stored twice by one run, the second replacing the first, and the rejected ones."""
    folder = jobs.work_folder(spark)
    rows = view(spark, sf, "predictions").select("id", "upload_id", "attack_type", "confidence", "severity")
    for _ in range(2):
        sinks.store_predictions(rows, f"{folder}/good", f"{folder}/bad", run="one")
    return spark.read.parquet(f"{folder}/good").drop("run").unionByName(
        spark.read.parquet(f"{folder}/bad").drop("run"), allowMissingColumns=True)


@query("stream_limiter_in_order", views="")
def stream_limiter_in_order(spark, sf):
    """Decisions by request time with timers: all requests that the watermark has passed."""
    keyed = request_stream(spark, sf).select(
        F.col("event_id").alias("id"), "client", limiter.micros(F.col("ts")).alias("at"))
    with jobs.rocks_state(spark):
        return jobs.drain(spark, jobs.limited_in_order(keyed, traffic.LIMIT, traffic.WINDOW)).select(
            "id", "client", "at", "allowed", "remaining", "retry_after")


# The clock of the watermark counts whole milliseconds.
ORACLES["stream_limiter_in_order"] = f"""SELECT * FROM ({ORACLES["limiter_decisions"]})
WHERE "at" // 1000 < (SELECT MAX(epoch_us(ts)) // 1000 - 60000 FROM events)"""

"""Queries: cells, labels, headers and small text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.functions import cells, labels, text
from flowguard.operators import dataset
from flowguard.plans.detection import CLASS_TABLE, LABEL_CODES_SQL
from flowguard.plans.registry import query, values_sql
from flowguard.plans.views import view
from flowguard.session import spread

NUMBER = r"[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?"
LOOSE = (r"[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)"
         r"([eE][+-]?[0-9](_?[0-9])*)?")

KIND_SQL = f"""
trimmed AS (SELECT *, TRIM(raw) AS s,
  CASE WHEN regexp_full_match(TRIM(raw), '{NUMBER}') THEN TRY_CAST(TRIM(raw) AS DOUBLE) END AS d
  FROM log_cells),
kinds AS (SELECT *, CASE WHEN s IS NULL OR s = '' THEN 'null'
    WHEN LOWER(s) IN ('true', 'false') THEN 'boolean'
    WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN 'integer'
    WHEN isfinite(d) THEN 'float' ELSE 'string' END AS kind FROM trimmed)"""


@query("coerce_cells", views="log_cells", oracle=f"""
, {KIND_SQL}
SELECT row_key, kind,
  CASE kind WHEN 'boolean' THEN UPPER(s[1]) || LOWER(s[2:]) WHEN 'integer' THEN CAST(CAST(s AS BIGINT) AS VARCHAR)
    WHEN 'float' THEN CAST(d AS VARCHAR) WHEN 'string' THEN s END AS "text",
  CASE WHEN kind IN ('integer', 'float') THEN d END AS number
FROM kinds""")
def coerce_cells(spark, sf):
    rows = spread(view(spark, sf, "log_cells").select("row_key", "raw"), "row_key")
    return rows.select("row_key", cells.coerce(F.col("raw")).alias("c")) \
        .select("row_key", "c.kind", "c.text", "c.number")


@query("to_number", views="log_cells", oracle=f"""
SELECT row_key,
  CASE WHEN regexp_full_match(TRIM(raw), '{LOOSE}') AND isfinite(TRY_CAST(REPLACE(TRIM(raw), '_', '') AS DOUBLE))
       THEN TRY_CAST(REPLACE(TRIM(raw), '_', '') AS DOUBLE) END AS loose,
  CASE WHEN regexp_full_match(TRIM(raw), '{NUMBER}') AND isfinite(TRY_CAST(TRIM(raw) AS DOUBLE))
       THEN TRY_CAST(TRIM(raw) AS DOUBLE) END AS strict
FROM log_cells""")
def to_number(spark, sf):
    return view(spark, sf, "log_cells").select(
        "row_key", cells.to_number(F.col("raw")).alias("loose"),
        cells.to_number(F.col("raw"), strict=True).alias("strict"))


@query("normalize_labels", views="log_cells", oracle="""
SELECT row_key, TRIM(regexp_replace(LOWER(TRIM(raw)), '[^a-z0-9]+', ' ', 'g')) AS normalized,
  NULLIF(TRIM(raw), '') AS stated FROM log_cells WHERE col_name = 'Label'""")
def normalize_labels(spark, sf):
    return view(spark, sf, "log_cells").where(F.col("col_name") == "Label").select(
        "row_key", labels.normalize_label(F.col("raw")).alias("normalized"),
        F.nullif(cells.cell_text(F.col("raw")), F.lit("")).alias("stated"))


@query("label_classes", views="log_cells", oracle=f"""
, flows AS (SELECT row_key, NULLIF(TRIM(raw), '') AS label FROM log_cells WHERE col_name = 'Label'),
{LABEL_CODES_SQL}
SELECT row_key, label, t.name AS attack_type FROM flows LEFT JOIN label_codes USING (label)
LEFT JOIN {CLASS_TABLE} ON label_codes.code = t.code""")
def label_classes(spark, sf):
    stated = view(spark, sf, "log_cells").where(F.col("col_name") == "Label").select(
        "row_key", F.nullif(cells.strip(F.col("raw")), F.lit("")).alias("label"))
    return stated.withColumn("attack_type", labels.label_class(F.col("label")))


CAPTURE_TABLE = values_sql(list(vocab.CAPTURE_LABELS.items()), "spelling, klass")


@query("cic_labels", views="capture_cells", oracle=f"""
, keyed AS (SELECT row_key, LOWER(TRIM(regexp_replace(regexp_replace(label, '[-–—_]', ' ', 'g'), '\\s+', ' ', 'g'))) AS normalized
  FROM capture_cells)
SELECT row_key, normalized,
  CASE WHEN normalized = '' OR REPLACE(normalized, ' ', '') LIKE '%heartbleed%' THEN NULL ELSE klass END AS attack_type,
  CASE WHEN normalized = '' THEN 'missing_label'
       WHEN REPLACE(normalized, ' ', '') LIKE '%heartbleed%' THEN 'heartbleed_excluded'
       WHEN klass IS NULL THEN 'unknown_label' END AS code
FROM keyed LEFT JOIN {CAPTURE_TABLE} ON normalized = spelling""")
def cic_labels(spark, sf):
    keyed = view(spark, sf, "capture_cells").select(
        "row_key", labels.normalize_capture_label(F.col("label")).alias("normalized"))
    classed = keyed.withColumn("attack_type", labels.capture_class(F.col("normalized")))
    return classed.withColumn(
        "code", labels.capture_label_code(F.col("normalized"), F.col("attack_type")))


@query("normalize_headers", views="log_cells", oracle="""
SELECT col_name, regexp_replace(LOWER(TRIM(col_name)), '[^0-9a-z]+', '', 'g') AS normalized,
  COUNT(*) AS n_cells FROM log_cells GROUP BY col_name""")
def normalize_headers(spark, sf):
    return (view(spark, sf, "log_cells").groupBy("col_name")
            .agg(F.count(F.lit(1)).alias("n_cells"))
            .withColumn("normalized", labels.normalize_header(F.col("col_name"))))


@query("mask_values", views="users", oracle="""
SELECT id, CASE WHEN LENGTH(email) <= 8 THEN '********' ELSE LEFT(email, 4) || '****' || RIGHT(email, 4) END AS masked_email,
  CASE WHEN LENGTH(role) <= 8 THEN '********' ELSE LEFT(role, 4) || '****' || RIGHT(role, 4) END AS masked_role
FROM users""")
def mask_values(spark, sf):
    return view(spark, sf, "users").select(
        "id", text.mask(F.col("email")).alias("masked_email"),
        text.mask(F.col("role")).alias("masked_role"))


@query("email_checks", views="users", oracle=f"""
SELECT id, LOWER(TRIM(email)) AS email, regexp_full_match(LOWER(TRIM(email)), '{vocab.EMAIL_PATTERN[1:-1]}')
  AND LENGTH(TRIM(email)) <= 255 AS valid FROM users""")
def email_checks(spark, sf):
    return view(spark, sf, "users").select(
        "id", text.normalize_email(F.col("email")).alias("email"),
        text.email_ok(F.col("email")).alias("valid"))


@query("missing_features", views="flows", oracle="""
SELECT source_id, row_key, concat_ws(',', """ + ", ".join(
    f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in vocab.FEATURES) + """) AS missing FROM flows""")
def missing_features(spark, sf):
    return view(spark, sf, "flows").select(
        "source_id", "row_key", F.array_join(dataset.missing_features(), ",").alias("missing"))


@query("label_codes", views="flows", oracle=f"""
, {LABEL_CODES_SQL}
SELECT row_key, label, CAST(CASE WHEN code < 8 THEN code END AS TINYINT) AS label_code,
  CASE WHEN code < 8 THEN t.name END AS decoded
FROM flows LEFT JOIN label_codes USING (label) LEFT JOIN {CLASS_TABLE} USING (code)""")
def label_codes(spark, sf):
    coded = view(spark, sf, "flows").select(
        "row_key", "label", labels.class_code(labels.label_class(F.col("label"))).alias("label_code"))
    return coded.withColumn("decoded", labels.class_of_code(F.col("label_code")))


@query("filename_checks", views="uploads", oracle="""
, n AS (SELECT id, client_filename, TRIM(client_filename) AS s FROM uploads)
SELECT id, CASE WHEN s = '' THEN 'empty' WHEN LENGTH(s) > 255 THEN 'too_long' WHEN s IN ('.', '..') THEN 'directory'
    WHEN regexp_matches(s, '[/\\\\]') THEN 'separator' END AS problem,
  CASE WHEN LOWER(s) LIKE '%.csv' THEN 'csv' WHEN LOWER(s) LIKE '%.json' THEN 'json' END AS log_format,
  regexp_replace(regexp_replace(regexp_extract(s, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1'), '[^A-Za-z0-9_.-]+', '_', 'g') AS stem
FROM n""")
def filename_checks(spark, sf):
    name = cells.strip(F.col("client_filename"))
    return view(spark, sf, "uploads").select(
        "id", text.filename_problem(F.col("client_filename")).alias("problem"),
        text.log_format(name).alias("log_format"), text.safe_stem(name).alias("stem"))


@query("client_keys", views="requests", oracle="""
SELECT event_id, CASE WHEN COALESCE(x_forwarded_for, '') <> ''
    THEN COALESCE(NULLIF(TRIM(split_part(x_forwarded_for, ',', 1)), ''), 'unknown')
  ELSE COALESCE(NULLIF(TRIM(x_real_ip), ''), NULLIF(peer, ''), 'unknown') END AS client FROM requests""")
def client_keys(spark, sf):
    return view(spark, sf, "requests").select(
        "event_id", text.client_key(F.col("x_forwarded_for"), F.col("x_real_ip"),
                                    F.col("peer")).alias("client"))

"""Queries: capture conversion, exclusions, coverage and checks of training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.operators import capture, dataset
from flowguard.plans.cells import CAPTURE_TABLE, NUMBER
from flowguard.plans.detection import CLASS_TABLE, LABEL_CODES_SQL
from flowguard.plans.registry import query
from flowguard.plans.views import view
from flowguard.session import spread


def _measure(name: str) -> str:
    words = ", ".join(f"'{w}'" for w in
                      ("nan", "+nan", "-nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"))
    return f"""
  CASE WHEN {name} IS NULL OR TRIM({name}) = '' THEN 'missing_value'
    WHEN LOWER(TRIM({name})) IN ({words}) THEN 'non_finite_value'
    WHEN NOT regexp_full_match(TRIM({name}), '{NUMBER}') THEN 'unparsable_value'
    WHEN NOT isfinite(COALESCE(TRY_CAST(TRIM({name}) AS DOUBLE), CAST('inf' AS DOUBLE))) THEN 'non_finite_value'
    END AS c_{name},
  CASE WHEN regexp_full_match(TRIM({name}), '{NUMBER}') THEN TRY_CAST(TRIM({name}) AS DOUBLE) END AS v_{name}"""


M = vocab.CAPTURE_MEASUREMENTS
CONVERTED_SQL = f"""
, measured AS (SELECT *, LOWER(TRIM(regexp_replace(regexp_replace(label, '[-–—_]', ' ', 'g'), '\\s+', ' ', 'g'))) AS k,
  {", ".join(_measure(n) for n in M)} FROM capture_cells),
classed AS (SELECT *, CASE WHEN k = '' THEN 'missing_label'
    WHEN REPLACE(k, ' ', '') LIKE '%heartbleed%' THEN 'heartbleed_excluded'
    WHEN klass IS NULL THEN 'unknown_label' END AS c_label
  FROM measured LEFT JOIN {CAPTURE_TABLE} ON k = spelling),
coded AS (SELECT *, COALESCE(c_label, {", ".join("c_" + n for n in M)},
    CASE WHEN NOT (isfinite(v_fwd_bytes + v_bwd_bytes) AND isfinite(v_fwd_packets + v_bwd_packets))
         THEN 'non_finite_derived_value' END) AS code,
  COALESCE({", ".join(f"CASE WHEN c_{n} IS NOT NULL THEN '{n}' END" for n in M)}) AS bad_name,
  COALESCE({", ".join(f"CASE WHEN c_{n} IS NOT NULL THEN TRIM({n}) END" for n in M)}) AS bad_text
  FROM classed),
used AS (SELECT source_id, row_key, klass AS label, t.code AS label_code,
    CAST(CAST(v_flow_duration AS REAL) AS DOUBLE) AS flow_duration,
    CAST(CAST(v_fwd_bytes + v_bwd_bytes AS REAL) AS DOUBLE) AS total_bytes,
    CAST(CAST(v_fwd_packets + v_bwd_packets AS REAL) AS DOUBLE) AS total_packets,
    CAST(CAST(v_avg_packet_size AS REAL) AS DOUBLE) AS avg_packet_size,
    CAST(CAST(v_packet_rate AS REAL) AS DOUBLE) AS packet_rate
  FROM coded JOIN {CLASS_TABLE} ON klass = t.name WHERE coded.code IS NULL)
"""


def converted(spark, sf):
    return capture.convert(spread(view(spark, sf, "capture_cells"), "row_key"))


def example_rows(spark, sf):
    return capture.examples(converted(spark, sf))


def _spread(examples):
    return examples.select(
        *[c for c in examples.columns if c != "features"],
        *[F.get("features", F.lit(i)).cast("double").alias(f)
          for i, f in enumerate(vocab.FEATURES)])


@query("cic_examples", views="capture_cells", oracle=CONVERTED_SQL + """
SELECT source_id, row_key, label, CAST(label_code AS TINYINT) AS label_code, flow_duration, total_bytes,
  total_packets, avg_packet_size, packet_rate FROM used""")
def cic_examples(spark, sf):
    return _spread(example_rows(spark, sf))


@query("cic_exclusions", views="capture_cells", oracle=CONVERTED_SQL + """
SELECT source_id, row_key, code, CASE code WHEN 'missing_label' THEN 'the label is blank'
  WHEN 'heartbleed_excluded' THEN 'label ' || TRIM(label) || ' is Heartbleed, which no class covers'
  WHEN 'unknown_label' THEN 'label ' || TRIM(label) || ' names no class'
  WHEN 'missing_value' THEN bad_name || ' is blank'
  WHEN 'unparsable_value' THEN bad_name || ' holds ' || bad_text || ', which is no number'
  WHEN 'non_finite_value' THEN bad_name || ' holds ' || bad_text || ', which is not finite'
  ELSE 'the summed bytes or packets are not finite' END AS reason
FROM coded WHERE code IS NOT NULL""")
def cic_exclusions(spark, sf):
    return capture.exclusions(converted(spark, sf))


@query("exclusion_counts", views="capture_cells", oracle=CONVERTED_SQL + """
SELECT code, COUNT(*) AS n_rows FROM coded WHERE code IS NOT NULL GROUP BY code ORDER BY code""")
def exclusion_counts(spark, sf):
    return capture.exclusion_counts(capture.exclusions(converted(spark, sf))).orderBy("code")


@query("exclusion_counts_by_source", views="capture_cells", oracle=CONVERTED_SQL + """
SELECT source_id, code, COUNT(*) AS n_rows FROM coded WHERE code IS NOT NULL GROUP BY source_id, code""")
def exclusion_counts_by_source(spark, sf):
    return capture.exclusion_counts(capture.exclusions(converted(spark, sf)), "source_id")


@query("class_counts", views="capture_cells", oracle=CONVERTED_SQL + """
SELECT CAST(label_code AS TINYINT) AS label_code, label, COUNT(*) AS n_rows FROM used GROUP BY ALL""")
def class_counts(spark, sf):
    return dataset.class_counts(example_rows(spark, sf))


@query("missing_classes", views="capture_cells", oracle=CONVERTED_SQL + f"""
, orders AS (SELECT DISTINCT split_part(row_key, '-', 1) AS order_id, label FROM used),
ids AS (SELECT DISTINCT order_id FROM orders)
SELECT order_id, name AS missing_class FROM ids, {CLASS_TABLE}
WHERE code < 8 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.order_id = ids.order_id AND o.label = name)""")
def missing_classes(spark, sf):
    """By order, as the rows of an order never cover all classes."""
    return dataset.missing_classes(example_rows(spark, sf).withColumn(
        "order_id", F.split_part("row_key", F.lit("-"), F.lit(1))), "order_id")


@query("classes_present", views="capture_cells", oracle=CONVERTED_SQL + """
, d AS (SELECT DISTINCT source_id, label, label_code FROM used)
SELECT source_id, string_agg(label, ',' ORDER BY label_code) AS classes, COUNT(*) AS n_classes
FROM d GROUP BY source_id""")
def classes_present(spark, sf):
    out = dataset.classes_present(example_rows(spark, sf), "source_id")
    return out.select("source_id", F.array_join("classes", ",").alias("classes"),
                      F.size("classes").cast("bigint").alias("n_classes"))


@query("feature_coverage", views="flows", oracle="SELECT source_id, COUNT(*) AS row_count, " + ", ".join(
    f"COUNT({f}) AS n_{f}" for f in vocab.FEATURES) + " FROM flows GROUP BY source_id")
def feature_coverage(spark, sf):
    return dataset.feature_coverage(view(spark, sf, "flows"), "source_id")


@query("reconciliation", views="capture_cells", oracle=CONVERTED_SQL + """
SELECT source_id, COUNT(*) AS rows_seen, COUNT(*) FILTER (code IS NULL) AS rows_used, """
       + ", ".join(f"COUNT(*) FILTER (code = '{c}') AS {c}" for c in vocab.EXCLUSION_CODES)
       + """, COUNT(code) AS rows_excluded, TRUE AS adds_up FROM coded GROUP BY source_id""")
def reconciliation(spark, sf):
    return capture.reconcile(converted(spark, sf))


@query("dataset_violations", views="capture_cells", oracle=CONVERTED_SQL + """
SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS wrong_width,
  COUNT(*) FILTER (NOT isfinite(total_bytes)) AS not_finite,
  CAST(0 AS BIGINT) AS bad_code, CAST(NULL AS VARCHAR) AS first_wrong_width,
  MIN(row_key) FILTER (NOT isfinite(total_bytes)) AS first_not_finite,
  CAST(NULL AS VARCHAR) AS first_bad_code, COUNT(DISTINCT label_code) AS n_classes FROM used""")
def dataset_violations(spark, sf):
    return dataset.violations(example_rows(spark, sf))


COMPLETE_SQL = CONVERTED_SQL + """
, complete AS (SELECT source_id, COUNT(*) AS rows_in_source, COUNT(*) FILTER (code IS NULL) AS rows_kept,
  COUNT(code) > 0 AS truncated FROM coded GROUP BY source_id)"""


@query("source_completeness", views="capture_cells", oracle=COMPLETE_SQL + "SELECT * FROM complete")
def source_completeness(spark, sf):
    return dataset.source_completeness(converted(spark, sf))


@query("merged_completeness", views="capture_cells", oracle=COMPLETE_SQL + """
SELECT bool_and(NOT truncated) AS complete, COUNT(*) FILTER (truncated) AS n_truncated,
  MIN(source_id) FILTER (truncated) AS first_truncated FROM complete""")
def merged_completeness(spark, sf):
    return dataset.merged_completeness(dataset.source_completeness(converted(spark, sf)))


GENERIC_SQL = f"""
, {LABEL_CODES_SQL},
staged AS (SELECT flows.*, code, CASE WHEN label IS NULL THEN 'unlabelled_row' WHEN code = 8 THEN 'unknown_label'
    WHEN {" OR ".join(f + " IS NULL" for f in vocab.FEATURES)} THEN 'missing_feature' END AS problem
  FROM flows LEFT JOIN label_codes USING (label))"""


@query("generic_examples", views="flows", oracle=GENERIC_SQL + f"""
SELECT source_id, row_key, t.name AS label, CAST(code AS TINYINT) AS label_code, """ + ", ".join(
    f"CAST(CAST({f} AS REAL) AS DOUBLE) AS {f}" for f in vocab.FEATURES) + f"""
FROM staged JOIN {CLASS_TABLE} USING (code)
WHERE source_id NOT IN (SELECT source_id FROM staged WHERE problem IS NOT NULL)""")
def generic_examples(spark, sf):
    good, _ = dataset.build_examples(view(spark, sf, "flows"))
    return _spread(good)


@query("generic_problems", views="flows", oracle=GENERIC_SQL + """
SELECT source_id, problem, COUNT(*) AS n_rows, MIN(row_key) AS first_row FROM staged
WHERE problem IS NOT NULL GROUP BY source_id, problem""")
def generic_problems(spark, sf):
    _, problems = dataset.build_examples(view(spark, sf, "flows"))
    return problems

"""Queries: dashboards, metrics and feature selection."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.operators import analytics
from flowguard.plans.detection import CLASS_TABLE, LABEL_CODES_SQL
from flowguard.plans.registry import query, values_sql
from flowguard.plans.views import view

DAILY_SQL = """SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS n_findings,
  COUNT(*) FILTER (attack_type NOT IN ('Benign', 'Unknown')) AS n_threats,
  COUNT(*) FILTER (attack_type NOT IN ('Benign', 'Unknown') AND severity = 'Critical') AS n_critical,
  COUNT(*) FILTER (attack_type = 'Benign') AS n_benign,
  COUNT(*) FILTER (attack_type NOT IN ('Benign', 'Unknown')) / COUNT(*) AS detection_rate
FROM predictions GROUP BY 1"""


@query("daily_summary", views="predictions", oracle=DAILY_SQL)
def daily_summary(spark, sf):
    return analytics.daily_summary(view(spark, sf, "predictions"))


@query("dashboard_summary", views="predictions", oracle=DAILY_SQL + " ORDER BY day DESC LIMIT 1")
def dashboard_summary(spark, sf):
    return analytics.daily_summary(view(spark, sf, "predictions")).orderBy(F.desc("day")).limit(1)


@query("attack_timeline", views="predictions", oracle="""
SELECT time_bucket(INTERVAL 7 DAYS, created_at, TIMESTAMP '1970-01-01') AS window_start, attack_type, COUNT(*) AS n_findings
FROM predictions GROUP BY 1, 2""")
def attack_timeline(spark, sf):
    return analytics.timeline(view(spark, sf, "predictions"))


@query("attack_distribution", views="predictions",
       oracle="SELECT attack_type, COUNT(*) AS n_rows FROM predictions GROUP BY attack_type")
def attack_distribution(spark, sf):
    return analytics.distribution(view(spark, sf, "predictions"), "attack_type")


@query("top_threats", views="predictions", oracle="""
SELECT attack_type, COUNT(*) AS n_rows FROM predictions WHERE attack_type NOT IN ('Benign', 'Unknown')
GROUP BY attack_type ORDER BY n_rows DESC, attack_type LIMIT 5""")
def top_threats(spark, sf):
    rows = view(spark, sf, "predictions").where(analytics.is_threat(F.col("attack_type")))
    return analytics.top(rows, "attack_type", 5)


@query("top_sources", views="audit_logs", oracle="""
SELECT ip_address, COUNT(*) AS n_rows FROM audit_logs GROUP BY ip_address ORDER BY n_rows DESC, ip_address LIMIT 10""")
def top_sources(spark, sf):
    return analytics.top(view(spark, sf, "audit_logs"), "ip_address", 10)


@query("confidence_histogram", views="predictions", oracle="""
SELECT CAST(CASE WHEN confidence BETWEEN 0 AND 1 THEN LEAST(FLOOR(confidence * 10), 9) ELSE -1 END AS INTEGER) AS tenth,
  COUNT(*) AS n_findings FROM predictions GROUP BY 1""")
def confidence_histogram(spark, sf):
    return analytics.confidence_histogram(view(spark, sf, "predictions"))


@query("recent_incidents", views="predictions", oracle="""
SELECT id, upload_id, attack_type, severity, created_at FROM predictions WHERE attack_type NOT IN ('Benign', 'Unknown')
ORDER BY created_at DESC, id DESC LIMIT 20""")
def recent_incidents(spark, sf):
    rows = view(spark, sf, "predictions").where(analytics.is_threat(F.col("attack_type")))
    return analytics.latest(rows.select("id", "upload_id", "attack_type", "severity", "created_at"),
                            "created_at", "id", 20)


@query("recent_uploads", views="uploads", oracle="""
SELECT id, filename, upload_status, created_at FROM uploads ORDER BY created_at DESC, id DESC LIMIT 20""")
def recent_uploads(spark, sf):
    rows = view(spark, sf, "uploads").select("id", "filename", "upload_status", "created_at")
    return analytics.latest(rows, "created_at", "id", 20)


TECH = values_sql([(k, i, n) for k, (i, n) in vocab.TECHNIQUES.items()],
                  "klass, technique_id, technique")


@query("mitre_mapping", views="predictions", oracle=f"""
SELECT attack_type, technique_id, technique, COUNT(*) AS n_findings
FROM predictions LEFT JOIN {TECH} ON klass = attack_type GROUP BY ALL""")
def mitre_mapping(spark, sf):
    counted = view(spark, sf, "predictions").groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("n_findings"))
    return analytics.with_techniques(counted)


@query("confusion_matrix", views="scored", oracle="""
SELECT label_code, predicted_code, COUNT(*) AS n_rows FROM scored GROUP BY ALL""")
def confusion_matrix(spark, sf):
    return analytics.confusion(view(spark, sf, "scored"))


METRICS_SQL = f"""
, a AS (SELECT label_code AS code, COUNT(*) AS n_actual, COUNT(*) FILTER (label_code = predicted_code) AS n_hit FROM scored GROUP BY 1),
p AS (SELECT predicted_code AS code, COUNT(*) AS n_predicted FROM scored GROUP BY 1),
s AS (SELECT COALESCE(a.code, p.code) AS code, COALESCE(n_actual, 0) AS n_actual, COALESCE(n_predicted, 0) AS n_predicted,
      COALESCE(n_hit, 0) AS n_hit FROM a FULL JOIN p ON a.code = p.code),
r AS (SELECT *, CASE WHEN n_predicted > 0 THEN n_hit / n_predicted ELSE 0.0 END AS precision,
      CASE WHEN n_actual > 0 THEN n_hit / n_actual ELSE 0.0 END AS recall FROM s),
m AS (SELECT r.*, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
      t.name AS label FROM r JOIN {CLASS_TABLE} ON r.code = t.code)
"""


@query("class_metrics", views="scored", oracle=METRICS_SQL + """
SELECT code, n_actual, n_predicted, n_hit, ROUND(precision, 9) AS precision, ROUND(recall, 9) AS recall, ROUND(f1, 9) AS f1, label FROM m""")
def class_metrics(spark, sf):
    out = analytics.class_metrics(analytics.confusion(view(spark, sf, "scored")))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("model_metrics", views="scored", oracle=METRICS_SQL + """
SELECT CAST(SUM(n_actual) AS BIGINT) AS n_rows, ROUND(SUM(n_hit) / SUM(n_actual), 9) AS accuracy,
  ROUND(AVG(precision), 9) AS macro_precision, ROUND(AVG(recall), 9) AS macro_recall, ROUND(AVG(f1), 9) AS macro_f1,
  ROUND(SUM(precision * n_actual) / SUM(n_actual), 9) AS weighted_precision,
  ROUND(SUM(recall * n_actual) / SUM(n_actual), 9) AS weighted_recall, ROUND(SUM(f1 * n_actual) / SUM(n_actual), 9) AS weighted_f1
FROM m""")
def model_metrics(spark, sf):
    out = analytics.overall_metrics(analytics.class_metrics(
        analytics.confusion(view(spark, sf, "scored"))))
    return out.select("n_rows", *[F.round(c, 9).alias(c) for c in out.columns if c != "n_rows"])


@query("roc_auc", views="class_scores", oracle=", s AS (" + " UNION ALL ".join(
    f"SELECT {c} AS class_code, p{c} AS score, label_code = {c} AS hit FROM class_scores" for c in range(4)) + """),
c AS (SELECT class_code, score, COUNT(*) FILTER (hit) AS pos, COUNT(*) FILTER (NOT hit) AS neg FROM s GROUP BY 1, 2),
r AS (SELECT *, SUM(neg) OVER (PARTITION BY class_code ORDER BY score) AS below FROM c),
w AS (SELECT class_code, CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg, SUM(pos * (below - neg / 2)) AS wins FROM r GROUP BY 1)
SELECT class_code, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN ROUND(wins / n_pos / n_neg, 9) END AS auc FROM w""")
def roc_auc(spark, sf):
    """One class against the rest: every row counts for every class, with that class's score."""
    rows = view(spark, sf, "class_scores").select("label_code", F.inline(F.array(*[
        F.struct(F.lit(c).alias("class_code"), F.col(f"p{c}").alias("score")) for c in range(4)])))
    rows = rows.withColumn("positive", F.col("label_code") == F.col("class_code"))
    return analytics.roc_auc(rows).withColumn("auc", F.round("auc", 9))


@query("variance_filter", views="flows", oracle=" UNION ALL ".join(
    f"SELECT '{f}' AS feature, ROUND(STDDEV_POP({f}), 6) AS deviation, VAR_POP({f}) > 0 AS keep FROM flows"
    for f in vocab.FEATURES))
def variance_filter(spark, sf):
    return analytics.variances(view(spark, sf, "flows")).select(
        "feature", "keep", F.round(F.sqrt("variance"), 6).alias("deviation"))


@query("correlation_pairs", views="flows", oracle=" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND(CORR({a}, {b}), 9) AS correlation, "
    f"COALESCE(ABS(CORR({a}, {b})) >= 0.95, FALSE) AS redundant FROM flows"
    for a, b in combinations(vocab.FEATURES, 2)))
def correlation_pairs(spark, sf):
    return analytics.correlations(view(spark, sf, "flows")).withColumn(
        "correlation", F.round("correlation", 9))


@query("mutual_information", views="flows", oracle=f"""
, {LABEL_CODES_SQL},
spans AS (SELECT """ + ", ".join(f"MIN({f}) AS lo_{f}, MAX({f}) AS hi_{f}" for f in vocab.FEATURES) + """ FROM flows),
cells AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, LEAST(FLOOR(({f} - lo_{f}) / (hi_{f} - lo_{f}) * 10), 9) AS bin, code "
    f"FROM flows JOIN label_codes USING (label), spans WHERE {f} IS NOT NULL" for f in vocab.FEATURES) + """),
j AS (SELECT feature, bin, code, COUNT(*) AS n FROM cells GROUP BY ALL),
x AS (SELECT feature, bin, SUM(n) AS nx FROM j GROUP BY ALL), y AS (SELECT feature, code, SUM(n) AS ny FROM j GROUP BY ALL),
t AS (SELECT feature, SUM(n) AS nt FROM j GROUP BY ALL)
SELECT feature, ROUND(SUM(n / nt * LN(n / nt / (nx / nt) / (ny / nt))), 9) AS information
FROM j JOIN x USING (feature, bin) JOIN y USING (feature, code) JOIN t USING (feature) GROUP BY feature""")
def mutual_information(spark, sf):
    return analytics.mutual_information(view(spark, sf, "flows")).withColumn(
        "information", F.round("information", 9))


@query("scaled_features", views="flows", oracle="""
, s AS (SELECT """ + ", ".join(f"AVG({f}) AS m_{f}, STDDEV_POP({f}) AS s_{f}" for f in vocab.FEATURES) + """ FROM flows)
SELECT source_id, row_key, """ + ", ".join(f"ROUND(({f} - m_{f}) / s_{f}, 6) AS {f}" for f in vocab.FEATURES) + """ FROM flows, s""")
def scaled_features(spark, sf):
    out = analytics.standardized(view(spark, sf, "flows"))
    return out.select("source_id", "row_key", *[F.round(f, 6).alias(f) for f in vocab.FEATURES])


@query("dedup_flows", views="flows", oracle="""
SELECT source_id, """ + ", ".join(vocab.FEATURES) + """, label, MIN(row_key) AS row_key, COUNT(*) AS n_copies
FROM flows GROUP BY ALL""")
def dedup_flows(spark, sf):
    return analytics.deduplicated(view(spark, sf, "flows"))

"""Queries: summaries, rules and verdicts per source."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.operators import detect
from flowguard.plans.registry import query, values_sql
from flowguard.plans.views import view

LABEL_TABLE = values_sql(
    [(k, vocab.ATTACK_TYPES.index(v)) for k, v in vocab.GENERIC_LABELS.items()], "spelling, code")
CLASS_TABLE = values_sql(
    [(i, n, vocab.SEVERITY_ORDER.index(vocab.SEVERITY_OF[n]))
     for i, n in enumerate(vocab.ATTACK_TYPES)], "code, name, sev")

SUMMARY_SQL = "COUNT(*) AS row_count, " + ", ".join(
    f"COUNT({f}) AS n_{f}, MAX({f}) AS max_{f}, AVG({f}) AS mean_{f}" for f in vocab.FEATURES)

# Label texts to class codes: whole text first, then words that agree.
LABEL_CODES_SQL = f"""
texts AS (SELECT DISTINCT label FROM flows WHERE label IS NOT NULL),
keyed AS (SELECT label, TRIM(regexp_replace(LOWER(TRIM(label)), '[^a-z0-9]+', ' ', 'g')) AS k
          FROM texts),
words AS (SELECT label, UNNEST(string_split(k, ' ')) AS w FROM keyed),
by_words AS (SELECT label, MIN(code) AS lo, MAX(code) AS hi
             FROM words JOIN {LABEL_TABLE} ON w = spelling GROUP BY label),
label_codes AS (SELECT keyed.label, COALESCE(t.code, CASE WHEN lo = hi THEN lo END, 8) AS code
  FROM keyed LEFT JOIN {LABEL_TABLE} ON k = spelling LEFT JOIN by_words USING (label))"""

VERDICT_SQL = f"""
, {LABEL_CODES_SQL},
summary AS (SELECT source_id, {SUMMARY_SQL}, MIN(code) AS lo, MAX(code) AS hi
            FROM flows LEFT JOIN label_codes USING (label) GROUP BY source_id),
fired AS (SELECT *,
  n_total_bytes > 0 AND (mean_total_bytes >= 1000000
       OR COALESCE(max_packet_rate >= 1000, FALSE)) AS flood,
  n_total_packets > 0 AND n_avg_packet_size > 0 AND max_total_packets >= 20
       AND max_avg_packet_size <= 64 AS scan,
  n_flow_duration > 0 AND row_count >= 10 AND max_flow_duration <= 1000000 AS guess
  FROM summary),
fired2 AS (SELECT *, CASE WHEN flood THEN 1 ELSE 0 END + CASE WHEN scan THEN 1 ELSE 0 END
                     + CASE WHEN guess THEN 1 ELSE 0 END AS n_fired FROM fired),
decided AS (SELECT *, CASE WHEN lo IS NOT NULL AND lo = hi THEN 'label'
    WHEN n_flow_duration + n_total_bytes + n_total_packets + n_avg_packet_size + n_packet_rate = 0
      THEN 'no_signal'
    WHEN n_fired > 0 THEN 'rules' ELSE 'no_rule' END AS decided_by FROM fired2),
classed AS (SELECT *, CASE decided_by WHEN 'label' THEN lo WHEN 'no_signal' THEN 8
    WHEN 'rules' THEN CASE WHEN flood THEN 1 WHEN scan THEN 3 ELSE 5 END ELSE 0 END AS code,
  CASE decided_by WHEN 'label' THEN CASE WHEN lo = 8 THEN 0.3 ELSE 0.99 END WHEN 'no_signal' THEN 0.3
    WHEN 'rules' THEN ROUND(LEAST(1.0, CASE WHEN flood THEN 0.9 WHEN scan THEN 0.8 ELSE 0.7 END
                                  + 0.05 * (n_fired - 1)), 4)
    ELSE 0.7 END AS confidence FROM decided),
verdicts AS (SELECT source_id, row_count, decided_by, t.name AS attack_type,
  CAST(confidence AS DOUBLE) AS confidence,
  CASE WHEN confidence < 0.5 THEN GREATEST(t.sev - 1, 0) ELSE t.sev END AS sev,
  CASE WHEN decided_by <> 'rules' THEN '' ELSE
    concat_ws('; ', CASE WHEN flood THEN '{detect.RULES[0].text}' END,
              CASE WHEN scan THEN '{detect.RULES[1].text}' END,
              CASE WHEN guess THEN '{detect.RULES[2].text}' END) END AS matched_rules
  FROM classed JOIN {CLASS_TABLE} ON classed.code = t.code),
final AS (SELECT source_id, row_count, decided_by, attack_type, confidence,
  CASE sev WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS severity,
  matched_rules FROM verdicts)
"""


@query("feature_summary", views="flows",
       oracle=f"SELECT source_id, {SUMMARY_SQL} FROM flows GROUP BY source_id")
def feature_summary(spark, sf):
    return view(spark, sf, "flows").groupBy("source_id").agg(*detect.feature_aggregates())


@query("detect_sources", views="flows", oracle=VERDICT_SQL + "SELECT * FROM final")
def detect_sources(spark, sf):
    out = detect.detect(view(spark, sf, "flows"))
    return out.withColumn("matched_rules", F.array_join("matched_rules", "; "))


@query("rule_matches", views="flows", oracle=VERDICT_SQL + """
SELECT source_id, n_total_bytes > 0 AS flood_ready, COALESCE(flood, FALSE) AS flood_fired,
  n_total_packets > 0 AND n_avg_packet_size > 0 AS scan_ready, COALESCE(scan, FALSE) AS scan_fired,
  n_flow_duration > 0 AS guessing_ready, COALESCE(guess, FALSE) AS guessing_fired FROM fired""")
def rule_matches(spark, sf):
    return detect.rule_matches(view(spark, sf, "flows"))


@query("severity_by_source", views="flows", oracle=VERDICT_SQL + """
SELECT severity, attack_type, COUNT(*) AS n_sources, CAST(SUM(row_count) AS BIGINT) AS n_rows
FROM final GROUP BY severity, attack_type""")
def severity_by_source(spark, sf):
    return (detect.detect(view(spark, sf, "flows")).groupBy("severity", "attack_type")
            .agg(F.count(F.lit(1)).alias("n_sources"), F.sum("row_count").alias("n_rows")))


@query("distinct_labels", views="flows", oracle=f"""
, {LABEL_CODES_SQL}
SELECT source_id, label, MIN(row_key) AS first_row, COUNT(*) AS n_rows, ANY_VALUE(t.name) AS attack_type
FROM flows JOIN label_codes USING (label) JOIN {CLASS_TABLE} ON label_codes.code = t.code
GROUP BY source_id, label""")
def distinct_labels(spark, sf):
    return detect.distinct_labels(view(spark, sf, "flows"))


@query("present_features", views="flows", oracle="""
SELECT source_id, concat_ws(',', """ + ", ".join(
    f"CASE WHEN COUNT({f}) > 0 THEN '{f}' END" for f in vocab.FEATURES) + """) AS present,
  COUNT(label) > 0 AS has_label, """ + " + ".join(f"COUNT({f})" for f in vocab.FEATURES) + """ > 0 AS has_signal
FROM flows GROUP BY source_id""")
def present_features(spark, sf):
    s = (view(spark, sf, "flows").groupBy("source_id")
         .agg(*[F.count(f).alias(f"n_{f}") for f in vocab.FEATURES],
              F.count("label").alias("n_label")))
    present = F.concat_ws(",", *[F.when(F.col(f"n_{f}") > 0, F.lit(f)) for f in vocab.FEATURES])
    return s.select("source_id", present.alias("present"),
                    (F.col("n_label") > 0).alias("has_label"),
                    detect.has_signal().alias("has_signal"))

"""Queries: uploads, findings, reports, audit and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.functions import scoring
from flowguard.operators import integrity, report
from flowguard.plans.registry import query, values_sql
from flowguard.plans.views import view

_CLASSES = ", ".join(f"'{c}'" for c in vocab.ATTACK_TYPES)
GUIDE = values_sql([(c, i, line) for c, lines in vocab.GUIDANCE.items()
                    for i, line in enumerate(lines)], "klass, pos, line")
GUIDE_SQL = f"guide AS (SELECT klass, list(line ORDER BY pos) AS lines FROM {GUIDE} GROUP BY klass)"
SOUND_SQL = f"attack_type IN ({_CLASSES}) AND severity IN ('Low','Medium','High','Critical') AND confidence BETWEEN 0 AND 1"

DOCS_SQL = f"""
, {GUIDE_SQL},
docs AS (SELECT p.id AS prediction_id, p.upload_id, u.filename AS source_filename, p.attack_type, p.confidence,
  p.severity, p.created_at AS predicted_at,
  'Upload ' || p.upload_id || ' shows ' || p.attack_type || ' at ' || CAST(round_even(p.confidence * 100, 0) AS BIGINT)
    || '% confidence, severity ' || p.severity || '.' AS summary,
  p.severity IN ('High', 'Critical') AS requires_immediate_action,
  CASE WHEN p.severity IN ('High', 'Critical') THEN list_prepend('Page the duty officer (severity ' || p.severity || ').', lines)
       ELSE lines END AS recs
  FROM predictions p LEFT JOIN uploads u ON p.upload_id = u.id JOIN guide ON klass = p.attack_type WHERE {SOUND_SQL.replace('attack_type IN', 'p.attack_type IN')})
"""


def _documents(spark, sf):
    return report.documents(view(spark, sf, "predictions"), view(spark, sf, "uploads"),
                            F.col("created_at"))


@query("report_documents", views="predictions uploads", oracle=DOCS_SQL + """
SELECT prediction_id, upload_id, source_filename, attack_type, confidence, severity, predicted_at, summary,
  requires_immediate_action, array_to_string(recs, ' | ') AS recommendations FROM docs""")
def report_documents(spark, sf):
    return _documents(spark, sf).select(
        "evidence.*", "findings.*",
        F.array_join("recommendations", " | ").alias("recommendations"))


@query("report_export", views="predictions uploads", oracle=DOCS_SQL + """
, listed AS (SELECT prediction_id, list_concat([
  {'field': 'generated_at', 'value': strftime(predicted_at, '%Y-%m-%dT%H:%M:%S')},
  {'field': 'evidence.prediction_id', 'value': prediction_id},
  {'field': 'evidence.upload_id', 'value': CAST(upload_id AS VARCHAR)},
  {'field': 'evidence.source_filename', 'value': COALESCE(source_filename, '')},
  {'field': 'evidence.attack_type', 'value': attack_type},
  {'field': 'evidence.confidence', 'value': CAST(confidence AS VARCHAR)},
  {'field': 'evidence.severity', 'value': severity},
  {'field': 'evidence.predicted_at', 'value': strftime(predicted_at, '%Y-%m-%d %H:%M:%S')},
  {'field': 'findings.summary', 'value': summary},
  {'field': 'findings.requires_immediate_action', 'value': CASE WHEN requires_immediate_action THEN 'True' ELSE 'False' END}],
  list_transform(range(len(recs)), lambda i: {'field': 'recommendations[' || i || ']', 'value': recs[i + 1]})) AS rows
  FROM docs),
flat AS (SELECT prediction_id, UNNEST(rows) AS r, UNNEST(range(len(rows))) AS ordinal FROM listed)
SELECT prediction_id, CAST(ordinal AS INTEGER) AS ordinal, r.field AS field, r.value AS "value" FROM flat""")
def report_export(spark, sf):
    return report.export_rows(_documents(spark, sf))


@query("recommendations", views="predictions", oracle=f"""
, {GUIDE_SQL}
SELECT attack_type, severity, COUNT(*) AS n_findings, ANY_VALUE(CASE WHEN attack_type NOT IN ({_CLASSES}) THEN NULL
  WHEN severity IN ('High', 'Critical') THEN 'Page the duty officer (severity ' || severity || '). | ' || array_to_string(lines, ' | ')
  ELSE array_to_string(lines, ' | ') END) AS guidance
FROM predictions LEFT JOIN guide ON klass = attack_type GROUP BY attack_type, severity""")
def recommendations(spark, sf):
    return (view(spark, sf, "predictions").groupBy("attack_type", "severity")
            .agg(F.count(F.lit(1)).alias("n_findings"))
            .withColumn("guidance", F.array_join(
                scoring.guidance(F.col("attack_type"), F.col("severity")), " | ")))


@query("malformed_predictions", views="predictions", oracle=f"""
, m AS (SELECT *, CASE WHEN attack_type NOT IN ({_CLASSES}) THEN 'attack_type'
  WHEN severity NOT IN ('Low','Medium','High','Critical') THEN 'severity'
  WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' END AS field FROM predictions)
SELECT id, field, CASE field WHEN 'confidence' THEN 'outside 0..1' ELSE 'value not known' END AS reason
FROM m WHERE field IS NOT NULL""")
def malformed_predictions(spark, sf):
    return report.malformed(view(spark, sf, "predictions")).select("id", "field", "reason")


@query("fk_chain", views="users uploads predictions reports", oracle="""
SELECT u.name AS user_name, f.filename, p.id AS prediction_id, p.attack_type, r.report_path
FROM users u JOIN uploads f ON f.uploaded_by = u.id JOIN predictions p ON p.upload_id = f.id
JOIN reports r ON r.prediction_id = p.id""")
def fk_chain(spark, sf):
    return integrity.finding_chain(*[view(spark, sf, n) for n in
                                     ("users", "uploads", "predictions", "reports")])


REFERENCES = [("uploads", "uploaded_by", "users"), ("predictions", "upload_id", "uploads"),
              ("reports", "prediction_id", "predictions"), ("audit_logs", "user_id", "users")]


@query("fk_orphans", views="users uploads predictions reports audit_logs", oracle=" UNION ALL ".join(
    f"SELECT '{c}.{k}' AS reference, COUNT(*) AS n_rows, COUNT(DISTINCT {k}) AS n_keys "
    f"FROM {c} WHERE {k} NOT IN (SELECT id FROM {p})" for c, k, p in REFERENCES))
def fk_orphans(spark, sf):
    parts = [integrity.orphan_summary(view(spark, sf, c), k, view(spark, sf, p), f"{c}.{k}")
             for c, k, p in REFERENCES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("orphan_predictions", views="uploads predictions", oracle="""
SELECT id, upload_id FROM predictions WHERE upload_id NOT IN (SELECT id FROM uploads)""")
def orphan_predictions(spark, sf):
    return integrity.orphan_rows(view(spark, sf, "predictions").select("id", "upload_id"),
                                 "upload_id", view(spark, sf, "uploads"))


@query("unreported_predictions", views="predictions reports", oracle="""
SELECT attack_type, COUNT(*) AS n_findings FROM predictions
WHERE id NOT IN (SELECT prediction_id FROM reports) GROUP BY attack_type""")
def unreported_predictions(spark, sf):
    missing = integrity.orphan_rows(view(spark, sf, "predictions").select("id", "attack_type"), "id",
                                    view(spark, sf, "reports"), "prediction_id")
    return missing.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n_findings"))


@query("duplicate_emails", views="users", oracle="""
SELECT LOWER(TRIM(email)) AS email, COUNT(*) AS n_users, MIN(id) AS first_id FROM users
GROUP BY LOWER(TRIM(email)) HAVING COUNT(*) > 1""")
def duplicate_emails(spark, sf):
    return integrity.duplicate_emails(view(spark, sf, "users"))


@query("invalid_roles", views="users", oracle="""
SELECT id, name, email, role FROM users WHERE role NOT IN ('Viewer', 'Analyst', 'Admin')""")
def invalid_roles(spark, sf):
    return integrity.invalid_roles(view(spark, sf, "users"))


@query("audit_by_action", views="audit_logs", oracle="""
SELECT action_performed, COUNT(*) AS n_actions, COUNT(DISTINCT user_id) AS n_users,
  MIN(timestamp) AS first_at, MAX(timestamp) AS last_at FROM audit_logs GROUP BY action_performed""")
def audit_by_action(spark, sf):
    return report.audit_by_action(view(spark, sf, "audit_logs"))


@query("audit_by_user", views="audit_logs", oracle="""
SELECT user_id, COUNT(*) AS n_actions, MAX(timestamp) AS last_at FROM audit_logs
WHERE action_performed = 'report.downloaded' GROUP BY user_id""")
def audit_by_user(spark, sf):
    return report.audit_by_user(view(spark, sf, "audit_logs"), "report.downloaded")


@query("audit_rejects", views="audit_logs", oracle="""
SELECT id, user_id, action_performed FROM audit_logs
WHERE action_performed NOT IN ('report.generated', 'report.retrieved', 'report.downloaded')""")
def audit_rejects(spark, sf):
    _, rejected = report.audit_entries(view(spark, sf, "audit_logs"))
    return rejected.select("id", "user_id", "action_performed")


@query("user_actions", views="users audit_logs", oracle="""
SELECT user_id, action_performed, ANY_VALUE(name) AS user_name, ANY_VALUE(role) AS role, COUNT(*) AS n_actions
FROM audit_logs a JOIN users u ON a.user_id = u.id GROUP BY user_id, action_performed""")
def user_actions(spark, sf):
    return integrity.user_actions(view(spark, sf, "users"), view(spark, sf, "audit_logs"))


RIGHTS = values_sql([(a, r) for a, rs in vocab.ACTION_ROLES.items() for r in rs], "act, who")


@query("forbidden_actions", views="users audit_logs", oracle=f"""
SELECT user_id, action_performed, ANY_VALUE(name) AS user_name, role, COUNT(*) AS n_actions
FROM audit_logs a JOIN users u ON a.user_id = u.id
WHERE NOT EXISTS (SELECT 1 FROM {RIGHTS} WHERE act = action_performed AND who = role)
GROUP BY user_id, action_performed, role""")
def forbidden_actions(spark, sf):
    return integrity.forbidden_actions(spark, view(spark, sf, "users"),
                                       view(spark, sf, "audit_logs"))


@query("ready_uploads", views="uploads predictions", oracle="""
, asked AS (SELECT upload_id, COUNT(*) AS n_requests FROM predictions GROUP BY upload_id)
SELECT upload_id, n_requests, upload_status, CASE WHEN upload_status IS NULL THEN 'unknown_upload'
  WHEN upload_status = 'completed' THEN 'ready' ELSE 'not_ready_' || upload_status END AS verdict
FROM asked LEFT JOIN uploads ON upload_id = uploads.id""")
def ready_uploads(spark, sf):
    return integrity.ready_uploads(view(spark, sf, "uploads"), view(spark, sf, "predictions"))


ADMISSION_SQL = """
, n AS (SELECT id, size_bytes, TRIM(client_filename) AS s FROM uploads),
a AS (SELECT id, size_bytes, CASE WHEN s = '' THEN 'bad_name_empty' WHEN s IN ('.', '..') THEN 'bad_name_directory'
  WHEN contains(s, '/') THEN 'bad_name_separator' WHEN LOWER(s) NOT LIKE '%.csv' AND LOWER(s) NOT LIKE '%.json' THEN 'unsupported_type'
  WHEN size_bytes = 0 THEN 'empty_file' WHEN size_bytes > 104857600 THEN 'too_large' ELSE 'admitted' END AS verdict FROM n)
"""


@query("admission", views="uploads", oracle=ADMISSION_SQL + "SELECT id, size_bytes, verdict FROM a")
def admission(spark, sf):
    return integrity.admission(view(spark, sf, "uploads")).select("id", "size_bytes", "verdict")


@query("upload_states", views="uploads", oracle=ADMISSION_SQL + """
SELECT a.id, a.verdict, CASE WHEN verdict = 'admitted' AND u.upload_status <> 'failed' THEN 'completed' ELSE 'failed' END AS upload_status
FROM a JOIN uploads u ON u.id = a.id""")
def upload_states(spark, sf):
    uploads = view(spark, sf, "uploads")
    unreadable = uploads.where(F.col("upload_status") == "failed")
    return integrity.upload_states(integrity.admission(uploads).drop("upload_status"),
                                   unreadable).select("id", "verdict", "upload_status")

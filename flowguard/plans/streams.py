"""Queries: windowed detection in batch, and the streams run over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.functions import text
from flowguard.operators import limiter
from flowguard.plans import traffic
from flowguard.plans.detection import VERDICT_SQL
from flowguard.plans.registry import ORACLES, query
from flowguard.plans.views import view, view_sql
from flowguard.streaming import jobs

WINDOWED_SQL = """
, windowed AS (SELECT * REPLACE ({'s': source_id, 'w': time_bucket(INTERVAL 90 DAYS, seen_at, TIMESTAMP '1970-01-01')} AS source_id)
  FROM flows)""" + VERDICT_SQL.replace("FROM flows", "FROM windowed") + """
SELECT source_id.w AS window_start, source_id.s AS source_id, row_count, decided_by, attack_type, confidence, severity, matched_rules
FROM final"""


def _joined_rules(verdicts):
    return verdicts.withColumn("matched_rules", F.array_join("matched_rules", "; "))


@query("windowed_detection", views="flows", oracle=WINDOWED_SQL)
def windowed_detection(spark, sf):
    return _joined_rules(jobs.windowed_verdicts(view(spark, sf, "flows"), width="90 days",
                                                late=None))


@query("stream_detection", views="flows", oracle=WINDOWED_SQL + """
WHERE source_id.w + INTERVAL 90 DAYS <= (SELECT MAX(seen_at) - INTERVAL 1 HOUR FROM flows)""")
def stream_detection(spark, sf):
    """The verdicts of all windows that the watermark has closed, out of a stream."""
    name = "flowguard_lineitem_stream"
    jobs.read_table(spark, f"{sf}/lineitem*.parquet").createOrReplaceTempView(name)
    flows = spark.sql(view_sql("flows", lambda t: name))
    return jobs.drain(spark, _joined_rules(jobs.windowed_verdicts(flows, width="90 days")))


def request_stream(spark, sf):
    name = "flowguard_events_stream"
    jobs.read_table(spark, f"{sf}/events*.parquet").createOrReplaceTempView(name)
    client = text.client_key(F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("peer"))
    return spark.sql(view_sql("requests", lambda t: name)).withColumn("client", client)


@query("stream_limiter", views="")
def stream_limiter(spark, sf):
    """The limiter as a stream over all requests."""
    keyed = request_stream(spark, sf).select(
        F.col("event_id").alias("id"), "client", limiter.micros(F.col("ts")).alias("at"))
    folder = jobs.work_folder(spark)
    jobs.limited_batches(keyed, folder, traffic.LIMIT, traffic.WINDOW).awaitTermination()
    return jobs.limited_results(spark, folder)


ORACLES["stream_limiter"] = ORACLES["limiter_decisions"]


@query("stream_active_clients", views="requests", oracle=traffic.KEYED_SQL + """
SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, COUNT(*) AS n_requests,
  COUNT(DISTINCT client) AS n_clients FROM keyed GROUP BY 1
HAVING window_start + INTERVAL 6 HOURS <= (SELECT MAX(ts) - INTERVAL 5 MINUTES FROM keyed)""")
def stream_active_clients(spark, sf):
    counted = jobs.active_clients(request_stream(spark, sf), width="6 hours")
    return jobs.drain(spark, counted)


@query("stream_audit", views="audit_logs", oracle="""
SELECT id, user_id, timestamp, action_performed FROM audit_logs
WHERE action_performed IN ('report.generated', 'report.retrieved', 'report.downloaded')""")
def stream_audit(spark, sf):
    name, folder = "flowguard_audit_stream", jobs.work_folder(spark)
    jobs.read_table(spark, f"{sf}/events*.parquet").createOrReplaceTempView(name)
    actions = spark.sql(view_sql("audit_logs", lambda t: name)).drop("ip_address")
    jobs.audit_sink(actions, folder).awaitTermination()
    return spark.read.schema(actions.schema).parquet(f"{folder}/audit/*")

"""Queries: client limits and traffic windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.functions import text
from flowguard.operators import limiter
from flowguard.plans.registry import query
from flowguard.plans.views import view

LIMIT, WINDOW = 3, 86_400

KEYED_SQL = """
, keyed AS (SELECT event_id AS id, epoch_us(ts) AS "at", ts, CASE WHEN COALESCE(x_forwarded_for, '') <> ''
    THEN COALESCE(NULLIF(TRIM(split_part(x_forwarded_for, ',', 1)), ''), 'unknown')
  ELSE COALESCE(NULLIF(TRIM(x_real_ip), ''), NULLIF(peer, ''), 'unknown') END AS client FROM requests)
"""


def keyed_requests(spark, sf):
    client = text.client_key(F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("peer"))
    return view(spark, sf, "requests").select(
        F.col("event_id").alias("id"), client.alias("client"),
        limiter.micros(F.col("ts")).alias("at"))


@query("limiter_decisions", views="requests", oracle=KEYED_SQL + f"""
, seq AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY client ORDER BY "at", id) AS rn FROM keyed),
walk AS (SELECT * FROM (WITH RECURSIVE w AS (
  SELECT client, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS "at",
    CAST([] AS BIGINT[]) AS hits, CAST([] AS BIGINT[]) AS live, FALSE AS allowed FROM (SELECT DISTINCT client FROM seq)
  UNION ALL
  SELECT client, rn, id, "at", CASE WHEN len(live) < {LIMIT} THEN list_append(live, "at") ELSE live END, live, len(live) < {LIMIT}
  FROM (SELECT s.client, s.rn, s.id, s."at", list_filter(w.hits, lambda x: x > s."at" - {WINDOW * 1_000_000}) AS live
        FROM w JOIN seq s ON s.client = w.client AND s.rn = w.rn + 1)) SELECT * FROM w))
SELECT id, client, "at", allowed, CAST({LIMIT} - len(hits) AS INTEGER) AS remaining,
  GREATEST(1, CAST(CEIL((hits[1] - ("at" - {WINDOW * 1_000_000})) / 1000000.0) AS BIGINT)) AS retry_after
FROM walk WHERE rn > 0""")
def limiter_decisions(spark, sf):
    return limiter.batch_decisions(keyed_requests(spark, sf), LIMIT, WINDOW)


@query("trailing_hits", views="requests", oracle=KEYED_SQL + f"""
, c AS (SELECT client, "at", COUNT(*) OVER (PARTITION BY client ORDER BY "at"
      RANGE BETWEEN {WINDOW * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS in_window FROM keyed)
SELECT client, "at", COUNT(*) AS hits, MAX(in_window) AS in_window FROM c GROUP BY client, "at" """)
def trailing_hits(spark, sf):
    return limiter.trailing_hits(keyed_requests(spark, sf), WINDOW)


@query("active_clients", views="requests", oracle=KEYED_SQL + """
SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, COUNT(*) AS n_requests,
  COUNT(DISTINCT client) AS n_clients FROM keyed GROUP BY 1""")
def active_clients(spark, sf):
    client = text.client_key(F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("peer"))
    return (view(spark, sf, "requests").select("ts", client.alias("client"))
            .groupBy(F.window("ts", "6 hours").alias("w"))
            .agg(F.count(F.lit(1)).alias("n_requests"),
                 F.count_distinct("client").alias("n_clients"))
            .select(F.col("w.start").alias("window_start"), "n_requests", "n_clients"))

"""Log-shaped views derived from the stored tables.

One SQL text per view serves both engines. Every row of the base table is kept;
row keys are built from the row's own columns, so no window runs to number rows.
Only integer ``%``, ``FLOOR`` before narrowing, and no double-to-text casts, so
both engines agree on every value.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ROW_KEY = ("CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', "
           "CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))")

VIEWS = {
    "flows": f"""
SELECT l_partkey AS source_id, {ROW_KEY} AS row_key,
  CASE WHEN l_partkey % 26 = 6 OR (l_partkey % 11 = 5 AND l_orderkey % 3 = 0) THEN NULL
       ELSE CAST((l_partkey % 40) * 50000 + l_linenumber * 100 AS DOUBLE) END AS flow_duration,
  CASE WHEN l_partkey % 13 = 6 THEN NULL
       ELSE CAST(CAST(FLOOR(l_extendedprice) AS BIGINT)
                 * (CASE WHEN l_partkey % 4 = 0 THEN 40 ELSE 1 END) AS DOUBLE) END AS total_bytes,
  CASE WHEN l_partkey % 13 = 6 THEN NULL
       ELSE CAST(l_quantity * (CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0.25 END) AS DOUBLE)
       END AS total_packets,
  CASE WHEN l_partkey % 13 = 6 THEN NULL
       ELSE CAST((l_partkey % 7) * 20 + l_linenumber AS DOUBLE) END AS avg_packet_size,
  CASE WHEN l_partkey % 13 = 6 THEN NULL
       ELSE CAST(l_quantity * (CASE WHEN l_partkey % 17 = 3 THEN 30 ELSE 2 END) AS DOUBLE)
       END AS packet_rate,
  CASE WHEN l_partkey % 10 = 0 THEN (CASE l_partkey % 8 WHEN 0 THEN 'BENIGN' WHEN 2 THEN 'DoS Hulk'
            WHEN 4 THEN 'DDoS' ELSE 'Web Attack - XSS' END)
       WHEN l_partkey % 10 = 1 THEN (CASE WHEN l_linenumber % 2 = 0 THEN 'PortScan' ELSE 'DDoS' END)
       WHEN l_partkey % 10 = 2 THEN 'Worm Propagation' END AS label,
  l_shipdate AS seen_at
FROM {{lineitem}}""",
    "capture_cells": f"""
SELECT l_suppkey AS source_id, {ROW_KEY} AS row_key,
  CASE WHEN l_orderkey % 97 = 0 THEN '   ' WHEN l_orderkey % 89 = 0 THEN ' Heart-bleed'
       WHEN l_orderkey % 83 = 0 THEN 'totally new class'
       ELSE (CASE l_partkey % 10 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DoS  Hulk' WHEN 2 THEN 'DDoS'
             WHEN 3 THEN 'PortScan' WHEN 4 THEN 'Bot' WHEN 5 THEN 'FTP-Patator'
             WHEN 6 THEN 'Web Attack - XSS' WHEN 7 THEN 'Infiltration'
             WHEN 8 THEN 'web_attack brute force' ELSE 'dos slowloris' END) END AS label,
  CASE WHEN l_orderkey % 79 = 0 THEN '1_0' WHEN l_orderkey % 73 = 0 THEN 'nan'
       WHEN l_orderkey % 71 = 0 THEN '' ELSE CAST(l_partkey * 100 AS STRING) END AS flow_duration,
  CASE WHEN l_orderkey % 67 = 0 THEN 'true'
       ELSE CAST(CAST(FLOOR(l_quantity) AS BIGINT) AS STRING) END AS fwd_packets,
  CASE WHEN l_orderkey % 61 = 0 THEN '1d' ELSE CAST(l_linenumber AS STRING) END AS bwd_packets,
  CASE WHEN l_orderkey % 59 = 0 THEN '1e308'
       ELSE CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) AS STRING) END AS fwd_bytes,
  CASE WHEN l_orderkey % 59 = 0 THEN '1e308' ELSE '2e2' END AS bwd_bytes,
  CASE WHEN l_orderkey % 53 = 0 THEN 'Infinity' ELSE '.5' END AS avg_packet_size,
  CASE WHEN l_orderkey % 47 = 0 THEN '1e999' ELSE '+4' END AS packet_rate
FROM {{lineitem}}""",
    # Loose log cells: names and values as a ragged log would carry them.
    "log_cells": f"""
SELECT l_suppkey AS source_id, l_orderkey AS row_idx, {ROW_KEY} AS row_key,
  l_linenumber AS col_pos,
  CASE l_linenumber % 4 WHEN 0 THEN ' Flow Duration' WHEN 1 THEN 'Total Length of Fwd Packets'
       WHEN 2 THEN 'Label' ELSE 'note' END AS col_name,
  CASE l_linenumber % 4
    WHEN 0 THEN (CASE l_orderkey % 6 WHEN 0 THEN '1e3' WHEN 1 THEN ' +42' WHEN 2 THEN '007'
                 WHEN 3 THEN '1_0' WHEN 4 THEN 'inf' ELSE CAST(l_partkey AS STRING) END)
    WHEN 1 THEN (CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_partkey AS STRING)
                 WHEN l_suppkey % 3 = 1 THEN CONCAT(CAST(l_partkey AS STRING), '.5') ELSE '   ' END)
    WHEN 2 THEN (CASE l_partkey % 9 WHEN 0 THEN 'DoS-Hulk' WHEN 1 THEN 'PortScan DDoS'
                 WHEN 2 THEN 'the botnet' WHEN 3 THEN ' Brute  Force ' WHEN 4 THEN ''
                 WHEN 5 THEN 'SQL injection' WHEN 6 THEN '--' WHEN 7 THEN 'Web Attack - Brute Force'
                 ELSE 'normal' END)
    ELSE (CASE l_orderkey % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'False' WHEN 2 THEN '0x1f'
          WHEN 3 THEN '12,5' WHEN 4 THEN '-0.5' WHEN 5 THEN '1d' WHEN 6 THEN '1e999'
          ELSE 'benign' END)
  END AS raw
FROM {{lineitem}}""",
    # Header rows: sixteen names per source, some of them swapped for filler.
    "headers": """
SELECT DISTINCT l_suppkey AS source_id, (l_partkey % 16 * 7 + l_suppkey) % 16 AS position,
  CASE WHEN (l_suppkey + 1) * (l_partkey % 16 + 3) % 5 = 0 THEN CONCAT('filler ', CAST(l_partkey % 16 AS STRING))
  ELSE (CASE l_partkey % 16 WHEN 0 THEN ' Flow Duration' WHEN 1 THEN 'Total Length of Fwd Packets'
    WHEN 2 THEN 'Total Length of Bwd Packets' WHEN 3 THEN 'Label' WHEN 4 THEN 'Attack Category'
    WHEN 5 THEN 'packets' WHEN 6 THEN 'Avg Packet Size' WHEN 7 THEN 'Mean Packet Size (fwd)'
    WHEN 8 THEN 'Flow Packets per Second' WHEN 9 THEN 'Duration' WHEN 10 THEN 'Flow Bytes/s'
    WHEN 11 THEN 'Sum of total packets' WHEN 12 THEN 'Packet Rate' WHEN 13 THEN 'class'
    WHEN 14 THEN 'src ip' ELSE 'Max Flow Duration us' END) END AS name
FROM {lineitem}""",
    "requests": """
SELECT event_id, CAST(user_id AS STRING) AS peer, ts,
  CASE WHEN event_id % 3 = 0 THEN CONCAT(' 10.0.0.', CAST(user_id AS STRING), ' , 172.16.0.1')
       WHEN event_id % 3 = 1 THEN '' END AS x_forwarded_for,
  CASE WHEN event_id % 5 = 0 THEN CONCAT('10.1.0.', CAST(user_id AS STRING)) END AS x_real_ip
FROM {events}""",
    "users": """
SELECT c_custkey AS id, c_name AS name,
  CASE WHEN c_custkey % 50 = 1 THEN ' User0@Example.com ' WHEN c_custkey % 50 = 2 THEN 'not-an-email'
       ELSE CONCAT('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
  CASE c_custkey % 4 WHEN 0 THEN 'Admin' WHEN 1 THEN 'Analyst' WHEN 2 THEN 'Viewer'
       ELSE 'Root' END AS role
FROM {customer}""",
    # Some uploads carry an id that no finding names, which leaves findings whose
    # upload is gone; no order is left out.
    "uploads": """
SELECT CASE WHEN o_orderkey % 31 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS id,
  CONCAT('capture-', CAST(o_orderkey AS STRING), '.csv') AS filename,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed'
       END AS upload_status,
  o_custkey AS uploaded_by, o_orderdate AS created_at,
  CAST(FLOOR(o_totalprice) AS BIGINT) * (o_orderkey % 11) * 50 AS size_bytes,
  CASE o_orderkey % 7 WHEN 0 THEN CONCAT('a/b', CAST(o_orderkey AS STRING), '.csv')
       WHEN 1 THEN '  ' WHEN 2 THEN '..' WHEN 3 THEN CONCAT(' day', CAST(o_orderkey AS STRING), '.CSV ')
       WHEN 4 THEN CONCAT('day', CAST(o_orderkey AS STRING), '.json')
       WHEN 5 THEN CONCAT('day', CAST(o_orderkey AS STRING), '.exe')
       ELSE CONCAT('day', CAST(o_orderkey AS STRING)) END AS client_filename
FROM {orders}""",
    "predictions": f"""
SELECT {ROW_KEY} AS id, l_orderkey AS upload_id,
  CASE l_partkey % 11 WHEN 0 THEN 'Benign' WHEN 1 THEN 'DoS' WHEN 2 THEN 'DDoS'
    WHEN 3 THEN 'PortScan' WHEN 4 THEN 'Bot' WHEN 5 THEN 'BruteForce' WHEN 6 THEN 'WebAttack'
    WHEN 7 THEN 'Infiltration' WHEN 8 THEN 'Unknown' WHEN 9 THEN 'Benign' ELSE 'Catastrophe' END
    AS attack_type,
  CASE WHEN l_partkey % 103 = 0 THEN CAST(1.5 AS DOUBLE)
       ELSE CAST(CAST(FLOOR(l_quantity) AS BIGINT) * 2 AS DOUBLE) / 100 END AS confidence,
  CASE l_suppkey % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium'
       ELSE 'Low' END AS severity,
  l_shipdate AS created_at
FROM {{lineitem}}""",
    "audit_logs": """
SELECT event_id AS id, user_id, ts AS timestamp,
  CASE event_type WHEN 'view' THEN 'report.retrieved' WHEN 'click' THEN 'report.downloaded'
       WHEN 'purchase' THEN 'report.generated' ELSE 'legacy.action' END AS action_performed,
  CONCAT('10.0.', CAST(user_id % 7 AS STRING), '.', CAST(user_id % 50 AS STRING)) AS ip_address
FROM {events}""",
    # Some reports name a finding that is not there, which leaves findings without report.
    "reports": f"""
SELECT CASE WHEN l_returnflag = 'R' THEN {ROW_KEY} ELSE CONCAT('draft-', {ROW_KEY}) END AS prediction_id, CONCAT('reports/', {ROW_KEY}, '.json') AS report_path,
  l_shipdate AS generated_at
FROM {{lineitem}}""",
    # Class probabilities per row in 1/1024 steps, so sums are exact.
    "row_scores": f"""
SELECT l_partkey AS source_id, {ROW_KEY} AS row_key,
  CAST(l_partkey * 7 % 301 AS DOUBLE) / 1024 AS p0,
  CAST(l_orderkey * 5 % 301 AS DOUBLE) / 1024 AS p1,
  CAST((l_suppkey * 37 + l_linenumber) % 301 AS DOUBLE) / 1024 AS p2,
  CAST(1024 - l_partkey * 7 % 301 - l_orderkey * 5 % 301
       - (l_suppkey * 37 + l_linenumber) % 301 AS DOUBLE) / 1024 AS p3
FROM {{lineitem}}""",
    # Actual class per row with a score for each of four classes.
    "class_scores": """
SELECT l_suppkey % 4 AS label_code, CAST(l_partkey * 7 % 301 AS DOUBLE) / 1024 AS p0,
  CAST(l_orderkey * 5 % 301 AS DOUBLE) / 1024 AS p1,
  CAST((l_suppkey * 37 + l_linenumber) % 301 AS DOUBLE) / 1024 AS p2,
  CAST((l_suppkey % 4 * 50 + l_partkey) % 257 AS DOUBLE) / 1024 AS p3
FROM {lineitem}""",
    # Stated and predicted class per row with a score, for metrics.
    "scored": """
SELECT l_partkey % 8 AS label_code,
  CASE WHEN l_orderkey % 3 = 0 THEN (l_partkey + l_linenumber) % 8 ELSE l_partkey % 8 END AS predicted_code,
  CAST((l_orderkey * 13 + l_partkey) % 1000 AS DOUBLE) / 1024 AS score
FROM {lineitem}""",
}


def view_sql(name: str, table) -> str:
    """SQL of a view; ``table`` turns a base table name into what the engine reads."""
    return re.sub(r"\{(\w+)\}", lambda m: table(m.group(1)), VIEWS[name]).strip()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(view_sql(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def with_views(names: str, body: str) -> str:
    """SQL for the checking engine: the views as named subqueries, then the body."""
    parts = [f"{n} AS ({view_sql(n, lambda t: t)})" for n in names.split()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()

"""Queries: column profiles, previews, delimiters and header mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.operators import headers, profile
from flowguard.plans.cells import KIND_SQL
from flowguard.plans.registry import query, values_sql
from flowguard.plans.views import view
from flowguard.session import spread


@query("column_profile", views="log_cells", oracle=f"""
, {KIND_SQL},
r AS (SELECT source_id, COUNT(DISTINCT row_key) AS n_rows FROM log_cells GROUP BY source_id),
c AS (SELECT source_id, col_name, COUNT(*) FILTER (kind <> 'null') AS n_values,
  COUNT(DISTINCT CASE WHEN kind <> 'null' THEN kind END) AS n_kinds,
  MIN(CASE WHEN kind <> 'null' THEN kind END) AS k1, MAX(CASE WHEN kind <> 'null' THEN kind END) AS k2
  FROM kinds GROUP BY source_id, col_name)
SELECT source_id, col_name, CASE WHEN n_kinds = 0 THEN 'null' WHEN n_kinds = 1 THEN k1
    WHEN n_kinds = 2 AND k1 = 'float' AND k2 = 'integer' THEN 'float' ELSE 'mixed' END AS value_type,
  n_rows - n_values AS null_count, n_rows FROM c JOIN r USING (source_id)""")
def column_profile(spark, sf):
    return profile.column_profile(spread(view(spark, sf, "log_cells"), "row_key"))


@query("column_union", views="log_cells", oracle="""
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id, col_name ORDER BY row_key, col_pos) AS k FROM log_cells)
SELECT source_id, col_name, row_key AS first_row, col_pos AS first_pos FROM r WHERE k = 1""")
def column_union(spark, sf):
    return profile.column_union(view(spark, sf, "log_cells"))


@query("first_rows", views="flows", oracle=f"""
, r AS (SELECT source_id, row_key, total_bytes, label, CAST(ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY row_key) AS INTEGER) AS row_number FROM flows)
SELECT * FROM r WHERE row_number <= {vocab.PREVIEW_ROWS}""")
def first_rows(spark, sf):
    return profile.first_rows(
        view(spark, sf, "flows").select("source_id", "row_key", "total_bytes", "label"), "row_key")


@query("delimiter_choice", views="log_cells", oracle="""
, h AS (SELECT source_id, row_key, CASE l % 5 WHEN 0 THEN REPLACE(col_name, ' ', ';') WHEN 1 THEN REPLACE(col_name, ' ', '|')
    WHEN 2 THEN REPLACE(col_name, ' ', chr(9)) WHEN 3 THEN col_name || ',x;y' ELSE col_name END AS line
  FROM (SELECT *, row_idx + source_id AS l FROM log_cells)),
n AS (SELECT *, LENGTH(line) - LENGTH(REPLACE(line, ',', '')) AS a, LENGTH(line) - LENGTH(REPLACE(line, ';', '')) AS b,
  LENGTH(line) - LENGTH(REPLACE(line, chr(9), '')) AS c, LENGTH(line) - LENGTH(REPLACE(line, '|', '')) AS d FROM h)
SELECT row_key, line, CASE GREATEST(a, b, c, d) WHEN a THEN ',' WHEN b THEN ';' WHEN c THEN chr(9) ELSE '|' END AS delimiter FROM n""")
def delimiter_choice(spark, sf):
    name, kind = F.col("col_name"), (F.col("row_idx") + F.col("source_id")) % 5
    line = (F.when(kind == 0, F.replace(name, F.lit(" "), F.lit(";")))
            .when(kind == 1, F.replace(name, F.lit(" "), F.lit("|")))
            .when(kind == 2, F.replace(name, F.lit(" "), F.lit("\t")))
            .when(kind == 3, F.concat(name, F.lit(",x;y"))).otherwise(name))
    return view(spark, sf, "log_cells").select("row_key", line.alias("line")).withColumn(
        "delimiter", headers.delimiter(F.col("line")))


ALIASES = values_sql([(f, a) for f, al in vocab.EXACT_ALIASES.items() for a in al], "feature, alias")
INNER = values_sql([(f, a) for f, al in vocab.CONTAINED_ALIASES.items() for a in al],
                   "feature, alias")


@query("header_mapping", views="headers", oracle=f"""
, n AS (SELECT *, regexp_replace(LOWER(TRIM(name)), '[^0-9a-z]+', '', 'g') AS k FROM headers),
e AS (SELECT source_id, feature, name, ROW_NUMBER() OVER (PARTITION BY source_id, feature ORDER BY position) AS r
      FROM n JOIN {ALIASES} ON k = alias),
start AS (SELECT s.source_id, COALESCE(list(feature) FILTER (feature IS NOT NULL), []) AS feats,
                 COALESCE(list(name) FILTER (name IS NOT NULL), []) AS names
          FROM (SELECT DISTINCT source_id FROM headers) s LEFT JOIN (SELECT * FROM e WHERE r = 1) x USING (source_id)
          GROUP BY s.source_id),
cand AS (SELECT source_id, feature, name, ROW_NUMBER() OVER (PARTITION BY source_id
           ORDER BY LENGTH(alias) DESC, feature, position, alias) AS rn
         FROM n JOIN {INNER} ON contains(k, alias)),
walk AS (SELECT * FROM (WITH RECURSIVE w AS (
    SELECT source_id, CAST(0 AS BIGINT) AS rn, feats, names FROM start
    UNION ALL
    SELECT w.source_id, c.rn,
      CASE WHEN list_contains(feats, c.feature) OR list_contains(names, c.name) THEN feats ELSE list_append(feats, c.feature) END,
      CASE WHEN list_contains(feats, c.feature) OR list_contains(names, c.name) THEN names ELSE list_append(names, c.name) END
    FROM w JOIN cand c ON c.source_id = w.source_id AND c.rn = w.rn + 1) SELECT * FROM w)),
last AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY rn DESC) AS k FROM walk)
SELECT source_id, UNNEST(feats) AS feature, UNNEST(names) AS name FROM last WHERE k = 1""")
def header_mapping(spark, sf):
    return headers.map_sources(view(spark, sf, "headers"))


@query("header_problems", views="log_cells", oracle="""
, h AS (SELECT source_id, row_idx, list(TRIM(col_name)) AS names FROM log_cells GROUP BY source_id, row_idx)
SELECT source_id, row_idx, CASE WHEN list_contains(names, '') THEN 'blank_column_name'
  WHEN len(list_distinct(names)) < len(names) THEN 'duplicate_column_name' END AS problem FROM h""")
def header_problems(spark, sf):
    rows = view(spark, sf, "log_cells").groupBy("source_id", "row_idx").agg(
        F.collect_list("col_name").alias("names"))
    return rows.select("source_id", "row_idx", headers.header_problem(F.col("names")).alias("problem"))

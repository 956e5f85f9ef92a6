"""Relational checks and joins over the stored tables.

Keys are counted before they are joined wherever only counts are asked for, so a
key that holds a third of the rows crosses the shuffle as one row per task. Row
joins are left to adaptive execution, which splits oversized partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.functions import text


def orphan_rows(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose parent does not exist."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def orphan_summary(child: DataFrame, key: str, parent: DataFrame, name: str,
                   parent_key: str = "id") -> DataFrame:
    """How many rows and keys of a child have no parent."""
    counted = child.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"))
    missing = orphan_rows(counted, key, parent, parent_key)
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                       F.count(F.lit(1)).alias("n_keys")).withColumn("reference", F.lit(name))


def duplicate_emails(users: DataFrame) -> DataFrame:
    """Addresses used more than once after normalisation."""
    return (users.groupBy(text.normalize_email(F.col("email")).alias("email"))
            .agg(F.count(F.lit(1)).alias("n_users"), F.min("id").alias("first_id"))
            .where(F.col("n_users") > 1))


def finding_chain(users: DataFrame, uploads: DataFrame, predictions: DataFrame,
                  reports: DataFrame) -> DataFrame:
    """Who uploaded what, what was found in it and which report says so."""
    u = users.select(F.col("id").alias("uploaded_by"), F.col("name").alias("user_name"))
    f = uploads.select(F.col("id").alias("upload_id"), "filename", "uploaded_by")
    p = predictions.select(F.col("id").alias("prediction_id"), "upload_id", "attack_type")
    r = reports.select("prediction_id", "report_path")
    return (p.join(r, "prediction_id").join(f, "upload_id").join(u, "uploaded_by")
            .select("user_name", "filename", "prediction_id", "attack_type", "report_path"))


def user_actions(users: DataFrame, audit: DataFrame) -> DataFrame:
    counted = audit.groupBy("user_id", "action_performed").agg(
        F.count(F.lit(1)).alias("n_actions"))
    who = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"), "role")
    return counted.join(who, "user_id")


def action_rights(spark) -> DataFrame:
    """Permitted (action, role) pairs; eight rows."""
    pairs = [(a, r) for a, roles in vocab.ACTION_ROLES.items() for r in roles]
    return spark.createDataFrame(pairs, "action_performed string, role string")


def forbidden_actions(spark, users: DataFrame, audit: DataFrame) -> DataFrame:
    """Actions that the user's role does not permit."""
    done = user_actions(users, audit)
    return done.join(F.broadcast(action_rights(spark)), ["action_performed", "role"], "left_anti")


def invalid_roles(users: DataFrame) -> DataFrame:
    return users.where(~F.coalesce(F.col("role").isin(vocab.ROLES), F.lit(False)))


def ready_uploads(uploads: DataFrame, requested: DataFrame) -> DataFrame:
    """State of each requested upload: ready, unknown, or why it is not ready.

    Only distinct ids are joined, so repeated requests cost nothing extra.
    """
    asked = requested.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n_requests"))
    state = uploads.select(F.col("id").alias("upload_id"), "upload_status")
    return asked.join(state, "upload_id", "left").withColumn(
        "verdict", F.when(F.col("upload_status").isNull(), F.lit("unknown_upload"))
        .when(F.col("upload_status") == "completed", F.lit("ready"))
        .otherwise(F.concat(F.lit("not_ready_"), F.col("upload_status"))))


def admission(uploads: DataFrame, max_bytes: int = vocab.UPLOAD_MAX_BYTES,
              name: str = "client_filename", size: str = "size_bytes") -> DataFrame:
    """Admission verdict of a landed file: its name, format and size."""
    problem = text.filename_problem(F.col(name))
    fmt = text.log_format(F.trim(F.col(name)))
    return uploads.withColumn(
        "verdict",
        F.when(problem.isNotNull(), F.concat(F.lit("bad_name_"), problem))
        .when(fmt.isNull(), F.lit("unsupported_type"))
        .when(F.col(size) == 0, F.lit("empty_file"))
        .when(F.col(size) > max_bytes, F.lit("too_large"))
        .otherwise(F.lit("admitted")))


def upload_states(admitted: DataFrame, source_errors: DataFrame, key: str = "id") -> DataFrame:
    """Final state of every attempt: completed unless refused or unreadable."""
    failed = source_errors.select(F.col(key)).distinct().withColumn("_failed", F.lit(True))
    return admitted.join(failed, key, "left").withColumn(
        "upload_status", F.when((F.col("verdict") == "admitted") & F.col("_failed").isNull(),
                                F.lit("completed")).otherwise(F.lit("failed"))).drop("_failed")

"""Session helpers: settings that a job needs and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "flowguard", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps.

    On a cluster pass neither ``master`` nor ``shuffle_partitions``: both come
    from the submit command, and adaptive execution sizes the partitions.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for jobs submitted without it installed there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="flowguard-"), "flowguard")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "flowguard"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as named by the cluster.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would lose data with the machine, so there
    the setting is required.
    """
    context = spark.sparkContext
    shared = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    current = context.getCheckpointDir()
    if current is not None:
        return current
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        shared = os.path.join(tempfile.mkdtemp(prefix="flowguard-"), "checkpoints")
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for row-by-row work on input of few splits.

    A table with at least as many splits as cores is returned as it is, so large
    inputs get no extra shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    splits = rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows if splits >= cores else rows.repartition(cores, *keys)

"""Helpers shared by the operators: tables in the shared folder, batches, hash samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the one the cluster names, removed when the application ends.

    Only a local session without the setting gets a folder of its own, as in tests.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(base)
        base = context.getCheckpointDir()
    folder = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def save(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them from there."""
    spark = df.sparkSession
    folder = shared_folder(spark, label)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_column(batch: pa.RecordBatch, name: str) -> list:
    """Texts of a batch as UTF-8 bytes, nulls as empty."""
    column = batch.column(name)
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def text_column(batch: pa.RecordBatch, name: str) -> list:
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def rows_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def sized(items: list, weight, most: int) -> Iterator[range]:
    """Index ranges whose weights add up to about ``most``; a heavier item stands alone."""
    start = total = 0
    for i, item in enumerate(items):
        w = weight(item)
        if i > start and total + w > most:
            yield range(start, i)
            start, total = i, 0
        total += w
    if items:
        yield range(start, len(items))


def hash_sample(df: DataFrame, key: str, rows: int, total: int, salt: str) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of the key alone."""
    if total <= rows:
        return df
    unit = 1 << 30
    place = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(unit))
    return df.where(place < F.lit(int(unit * rows / total)))

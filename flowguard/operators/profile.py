"""Column profiles and previews over cells in long form.

Cells are ``(source_id, row_key, col_pos, col_name, raw)``. Everything is a
grouped aggregate of fixed width, so a huge source is reduced before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowguard import vocab
from flowguard.functions import cells as cell


def row_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("source_id").agg(F.count_distinct("row_key").alias("n_rows"))


def column_profile(cells: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Type and null count of every column; rows without the column count as null."""
    kinds = cells.where(F.col("col_name").isNotNull()).withColumn("kind", cell.cell_kind(F.col("raw")))

    def seen(kind):
        return F.max(F.col("kind") == kind).alias(f"has_{kind}")

    per_column = kinds.groupBy("source_id", "col_name").agg(
        seen("boolean"), seen("integer"), seen("float"), seen("string"),
        F.count_if(F.col("kind") != "null").alias("n_values"))
    typed = per_column.withColumn("value_type", cell.column_type(
        *[F.col(f"has_{k}") for k in ("boolean", "integer", "float", "string")]))
    rows = row_counts(cells) if rows is None else rows
    return typed.join(rows, "source_id").select(
        "source_id", "col_name", "value_type",
        (F.col("n_rows") - F.col("n_values")).alias("null_count"), "n_rows")


def column_union(cells: DataFrame) -> DataFrame:
    """Every column of a source with the place it was first seen at."""
    return (cells.where(F.col("col_name").isNotNull()).groupBy("source_id", "col_name")
            .agg(F.min(F.struct("row_key", "col_pos")).alias("first"))
            .select("source_id", "col_name", F.col("first.row_key").alias("first_row"),
                    F.col("first.col_pos").alias("first_pos")))


def first_rows(rows: DataFrame, order: str, limit: int = vocab.PREVIEW_ROWS) -> DataFrame:
    """The first rows of each source.

    The rank filter is applied on the map side as well, so a source sends at
    most ``limit`` rows per task into the shuffle.
    """
    ranked = rows.withColumn("row_number", F.row_number().over(
        Window.partitionBy("source_id").orderBy(order)))
    return ranked.where(F.col("row_number") <= limit)


def preview(cells: DataFrame, limit: int = vocab.PREVIEW_ROWS) -> tuple[DataFrame, DataFrame]:
    """Column summaries and the first rows of every source."""
    first = first_rows(cells.select("source_id", "row_key").distinct(), "row_key", limit)
    return column_profile(cells), cells.join(
        first.select("source_id", "row_key"), ["source_id", "row_key"], "left_semi")

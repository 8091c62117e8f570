"""Row positions: dense numbers 0, 1, 2, ... in file order or in the order of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truegrain.functions.missing import ref
from truegrain.functions.session import materialised


def _offsets(counts: DataFrame, *order: str) -> DataFrame:
    """Running total of rows before each part; one row per file or block, never per table row."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0)))


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Position of every row of a freshly read file table (files by path, rows by place in the file).

    Rows are numbered where they are read: only the number of rows per block is aggregated and
    joined back, the table itself is not shuffled. Must be applied before any other operation.
    """
    where = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    blocks = where.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first"))
    before = _offsets(blocks, "_file", "_block")
    return where.join(before, ["_file", "_block"]).select(
        *[ref(c) for c in df.columns], (F.col("_before") + F.col("_seq") - F.col("_first")).alias(name)
    )


def with_order_index(df: DataFrame, order: str, name: str = "row_index") -> DataFrame:
    """Position of every row in the order of a column with distinct values.

    A range-partitioned sort is written once; each row then has a part and a place in the part.
    """
    parts = df.repartitionByRange(ref(order)).sortWithinPartitions(ref(order))
    placed = materialised(
        parts.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq"))
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first"))
    return placed.join(_offsets(counts, "_part"), "_part").select(
        *[ref(c) for c in df.columns], (F.col("_before") + F.col("_seq") - F.col("_first")).alias(name)
    )

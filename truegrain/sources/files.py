"""Folders of input files: listing, choosing what is new, and reading many files as one table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegrain.functions.missing import any_of, missing_count, missing_tests
from truegrain.sources.tables import FORMATS, read_table


def list_inputs(spark: SparkSession, folder: str, manifest: DataFrame | None = None, recursive: bool = True) -> DataFrame:
    """Supported files below a folder: path, size, time of change, extension, processed flag.

    Only the listing is read; file contents are pruned from the scan.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", recursive)
        .load(folder)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
        .withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
        .filter(F.col("extension").isin(list(FORMATS)))
    )
    if manifest is None:
        return files.withColumn("processed", F.lit(False))
    done = manifest.select("path").distinct().withColumn("_done", F.lit(True))
    return files.join(done, "path", "left").withColumn("processed", F.coalesce("_done", F.lit(False))).drop("_done")


def pending_inputs(inputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Inputs whose path the manifest of processed files lacks."""
    return inputs.join(manifest.select("path").distinct(), "path", "left_anti")


def inspect_dir(inputs: DataFrame) -> DataFrame:
    """Files, CSV files, total size, and whether there is anything to process."""
    return inputs.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("extension") == "csv").alias("csv_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
    ).withColumn("has_inputs", F.col("files") > 0)


def read_batch(
    spark: SparkSession,
    folder: str | Sequence[str],
    fmt: str,
    schema: T.StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """All files of a folder tree as one table with `source_file`; one job instead of one per file.

    The files must share their columns: a CSV file with another header raises an error.
    """
    paths = [folder] if isinstance(folder, str) else list(folder)
    df = read_table(spark, paths, fmt, schema, multiline=multiline)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"))


def batch_completeness(df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()) -> DataFrame:
    """Per source file: rows, missing cells, incomplete rows and completeness percentage."""
    names = list(cols) if cols else [c for c in df.columns if c != "source_file"]
    tests = list(missing_tests(df, names, sentinels).values())
    per = df.select("source_file", missing_count(tests).alias("m"), any_of(tests).alias("bad"))
    cells = (F.col("total_rows") * len(tests)).cast("double")
    return (
        per.groupBy("source_file")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.sum("m").alias("missing_cells"),
            F.count_if("bad").alias("incomplete_rows"),
        )
        .withColumn("completeness_pct", F.lit(100.0) * (cells - F.col("missing_cells")) / cells)
    )


def batch_status(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Every listed file with its results; a file that yielded no rows is reported, not lost."""
    return inputs.join(results, F.col("path") == F.col("source_file"), "left").withColumn(
        "file_status", F.when(F.col("source_file").isNull(), "empty_or_unreadable").otherwise("completed")
    ).drop("source_file")

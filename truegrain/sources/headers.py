"""First lines of many files, without reading the files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truegrain.functions.session import materialised

BLANK = " \t\r\n﻿"


# The largest block of a file in one task, and what a file counts at least when small ones are put together.
BLOCK, LEAST = 16 << 20, 64 << 10


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of every file that isn't blank. A block of full length is alone in its task, and the rest of it is not asked for."""
    found = None  # the file whose line was found last
    for b in batches:
        if b.num_rows == 0:
            continue
        file, block, length = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
        if length[0] >= BLOCK and block[0] != 0:
            return  # a later block of a file
        names = file.to_pylist()
        at = []
        for k in range(b.num_rows):
            if block[k] == 0 and names[k] != found and (b.column(3)[k].as_py() or "").strip(BLANK):
                found = names[k]
                at.append(k)
        if at:
            lines = [b.column(3)[k].as_py().strip(BLANK) for k in at]
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in at], pa.string()), pa.array(lines, pa.string())], ["file", "line"])
            if length[0] >= BLOCK:
                return


def first_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, line: the first line of each text file that isn't blank; files without one have no row.

    A large file is cut into blocks, each alone in its task and left after its first batch of lines, so at most some
    thousand lines of a block are read. Files smaller than a block share tasks, whose number grows with the bytes and
    hardly with the files, and are read whole. The result is written in the shared folder.
    """
    apart = spark.newSession()  # blocks are cut this way in this session only
    for name, value in (("maxPartitionBytes", BLOCK), ("openCostInBytes", LEAST), ("minPartitionNum", 1)):
        apart.conf.set(f"spark.sql.files.{name}", str(value))
    text = apart.read.option("recursiveFileLookup", True).text([paths] if isinstance(paths, str) else list(paths))
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("length"), "value")
    found = materialised(lines.mapInArrow(_first, "file string, line string"))
    return spark.read.schema(found.schema).parquet(*found.inputFiles()) if found.inputFiles() else spark.createDataFrame([], found.schema)

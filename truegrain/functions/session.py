"""Session settings the operators depend on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only in local mode, where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in reliable storage and forget the lineage, so a lost executor costs nothing."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}/{name}"


def materialised(df: DataFrame, **options: int) -> DataFrame:
    """Written once as Parquet in the shared folder and read back: for results used several times.

    Unlike a cache it survives lost executors, and later steps read only the columns they need. `options` are the writer's.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(table: DataFrame, key: str) -> DataFrame:
    """A freshly read table dealt out by its key, for costly work per row on what may be a few row groups."""
    return table.repartition(shuffle_width(table.sparkSession), key)


def dealt(table: DataFrame, key: str, partitions: int) -> DataFrame:
    """Dealt out by the key, to more partitions than configured where the work needs them."""
    few = partitions <= int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(key) if few else table.repartition(partitions, key)


def by_shuffle(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: the join shuffles, and no side is sent through the driver.

    Spark's own choice goes by the size of files. Repeated values pack so well that a table of few megabytes on
    disk may be millions of rows, which the driver would gather for a broadcast.
    """
    return side.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for work that grows before the next shuffle: as configured, at least two per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)

"""Exact quantiles of any number of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truegrain.functions.session import materialised


def exact_quantiles(values: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """by, probability, quantile: the least value with at least that share of its group's values up to it.

    Values are counted first, so equal ones are one row; the counts are sorted in ranges and summed per
    range, then within. No group is sorted in one task. Nulls don't count.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    keyed = counts.select(F.struct(F.lit(0).alias("_0"), *by).alias("_k"), F.col(value).alias("_v"), "_n")
    placed = materialised(keyed.repartitionByRange("_k", "_v").withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_k", "_part").agg(F.sum("_n").alias("_rows"))
    ahead = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_k")
    parts = parts.select(
        F.col("_k").alias("_of"), F.col("_part").alias("_in"), F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_rows").over(whole).alias("_all")
    )
    within = Window.partitionBy("_k", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_upto", F.sum("_n").over(within)).join(parts, (F.col("_k") == F.col("_of")) & (F.col("_part") == F.col("_in")))
    upto = F.col("_upto") + F.col("_ahead")
    asked = ranked.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    rank = F.greatest(F.ceil(F.col("probability") * F.col("_all")), F.lit(1))
    hit = asked.filter((upto >= rank) & (upto - F.col("_n") < rank))
    return hit.select(*[F.col(f"_k.{c}").alias(c) for c in by], "probability", F.col("_v").alias("quantile"))

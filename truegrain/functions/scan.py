"""Running totals and row numbers over ordered groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from truegrain.functions.session import materialised, shuffle_width

#: Names of the helper columns; callers must not use them.
SEGMENT, ORDER, TIE = "_segment", "_at", "_tie"


def segmented(df: DataFrame, keys: list[str], order: list[str], width: int | None = None) -> DataFrame:
    """`df` cut into segments by row count: ranges of (keys, order), each in one partition, in column _segment.

    Written in the shared folder, so a segment stays what it is when an executor is lost. Rows equal in
    keys and order may fall into different segments (their place in the input tells them apart), so a key
    with any share of the rows is spread evenly. _tie orders such rows.
    """
    n = width or shuffle_width(df.sparkSession)
    tied = df.withColumn(TIE, F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in [*keys, *order, TIE]])
    return materialised(ranged.withColumn(SEGMENT, F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], width: int | None = None) -> DataFrame:
    """`df` with, for each (name, column) of `sums`, the sum of the column over the key's rows up to and including this one.

    Rows are ordered by `order`, nulls first, ties in the order of the input. A segment adds up its own
    rows; what the earlier segments of a key hold is one row per key and segment it spans, added up
    before it is joined back. Names must be new.
    """
    cut = segmented(df, keys, order, width)
    own = Window.partitionBy(SEGMENT, *keys).orderBy(*[F.col(c).asc_nulls_first() for c in [*order, TIE]]).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumns({name: F.sum(c).over(own) for name, c in sums.items()})
    # only the keys that cross the border of a segment carry anything over
    parts = cut.groupBy(SEGMENT, *keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col(SEGMENT).alias("_segment_of"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.sum(name).over(before).alias(f"_{name}") for name in sums],
    )
    carried = materialised(carried.filter(" or ".join(f"`_{name}` is not null" for name in sums)))
    on = F.col(SEGMENT) == F.col("_segment_of")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = inner.join(carried, on, "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return both.select(*df.columns, *[(zero(name) + zero(f"_{name}")).alias(name) for name in sums])


def inside(keys: list[str], order: list[str]) -> WindowSpec:
    """The rows of a key within a segment, in order."""
    return Window.partitionBy(SEGMENT, *keys).orderBy(*[F.col(c).asc_nulls_first() for c in [*order, TIE]])


def with_carried(cut: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """`cut`, a segmented table, with, for each name, the last value that isn't null in the key's earlier segments.

    A segment tells one row per key, and the carry runs over these, at most one per segment for a key.
    """
    last = F.struct(*order, TIE)
    parts = cut.groupBy(SEGMENT, *keys).agg(*[F.max_by(v, F.when(v.isNotNull(), last)).alias(name) for name, v in values.items()])
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    told = parts.select(
        F.col(SEGMENT).alias("_segment_of"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.last(name, ignorenulls=True).over(before).alias(name) for name in values],
    )
    told = materialised(told.filter(" or ".join(f"`{name}` is not null" for name in values)))
    on = F.col(SEGMENT) == F.col("_segment_of")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return cut.join(told, on, "left").drop("_segment_of", *[f"_k{i}" for i in range(len(keys))])

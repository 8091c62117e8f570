"""Comparison of a table with a trusted reference table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegrain.functions.hashing import row_digest
from truegrain.functions.missing import ref
from truegrain.operators.duplicates import duplicate_summary
from truegrain.operators.patterns import missing_correlation
from truegrain.operators.profile import column_completeness, overall_completeness


def schema_diff(target: DataFrame, reference: DataFrame) -> DataFrame:
    """Per column: types on both sides and whether it is same, missing, extra or type_changed.

    Only schemas are read; the rows are carried by the columns' own names.
    """
    sides = []
    for df, name in ((target, "target_type"), (reference, "reference_type")):
        rows = F.array(
            *[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias(name)) for f in df.schema.fields]
        )
        sides.append(df.sparkSession.range(1).select(F.inline(rows)))
    t, r = F.col("target_type"), F.col("reference_type")
    return sides[0].join(sides[1], "column_name", "full_outer").withColumn(
        "change",
        F.when(t.isNull(), "missing").when(r.isNull(), "extra").when(t != r, "type_changed").otherwise("same"),
    )


def completeness_diff(target: DataFrame, reference: DataFrame, sentinels: Iterable[str] = ()) -> DataFrame:
    """Completeness per column on both sides, the structural change, and where the target is sparser."""
    sentinels = list(sentinels)
    sides = [
        column_completeness(df, sentinels=sentinels).select(
            "column_name",
            F.col("missing_ratio").alias(f"{s}_missing_ratio"),
            F.col("completeness_pct").alias(f"{s}_completeness_pct"),
        )
        for df, s in ((target, "target"), (reference, "reference"))
    ]
    both = sides[0].join(sides[1], "column_name", "full_outer")
    return schema_diff(target, reference).join(both, "column_name").withColumns(
        {
            "completeness_change": F.col("target_completeness_pct") - F.col("reference_completeness_pct"),
            "sparser_in_target": F.coalesce(
                F.col("target_missing_ratio") > F.col("reference_missing_ratio"), F.lit(False)
            ),
        }
    )


def gap_diff(target: DataFrame, reference: DataFrame, phi: float = 0.3, sentinels: Iterable[str] = ()) -> DataFrame:
    """Column pairs whose gaps go together in the target but not in the reference."""
    sentinels = list(sentinels)
    shared = [c for c in target.columns if c in set(reference.columns)]
    strong = [
        missing_correlation(df, shared, sentinels).filter(F.col("phi") >= phi) for df in (target, reference)
    ]
    return strong[0].join(strong[1].select("column_a", "column_b"), ["column_a", "column_b"], "left_anti")


def sparsity_verdict(target: DataFrame, reference: DataFrame, sentinels: Iterable[str] = ()) -> DataFrame:
    """Is the target sparser than the reference, and by how much on a scale of 0 to 100?"""
    sentinels = list(sentinels)
    base = overall_completeness(reference, sentinels=sentinels).select("missing_density").scalar()
    out = overall_completeness(target, sentinels=sentinels).select(
        F.col("missing_density").alias("target_missing_ratio"), base.alias("reference_missing_ratio")
    )
    t, r = F.col("target_missing_ratio"), F.col("reference_missing_ratio")
    raw = F.coalesce(F.try_divide(F.lit(100.0) * (t - r), F.lit(1.0) - r), F.lit(0.0))
    return out.select(
        "*",
        (t > r).alias("sparse_compared_to_reference"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)).alias("relative_sparsity_score"),
    )


def duplicate_diff(target: DataFrame, reference: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Duplicates on both sides and the relative increase in the target."""
    base = duplicate_summary(reference, cols).select(F.struct("duplicate_rows", "duplicate_rate_pct").alias("s")).scalar()
    t = duplicate_summary(target, cols)
    return t.select(
        F.col("duplicate_rows").alias("target_duplicates"),
        base["duplicate_rows"].alias("reference_duplicates"),
        F.col("duplicate_rate_pct").alias("target_rate_pct"),
        base["duplicate_rate_pct"].alias("reference_rate_pct"),
    ).select(
        (F.col("target_duplicates") > 0).alias("has_duplicates"),
        "*",
        F.try_divide(
            F.lit(100.0) * (F.col("target_duplicates") - F.col("reference_duplicates")).cast("double"),
            F.col("reference_duplicates").cast("double"),
        ).alias("relative_increase_pct"),
        (F.col("target_rate_pct") > F.col("reference_rate_pct")).alias("more_than_reference"),
    )


def new_duplicate_patterns(target: DataFrame, reference: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows repeated in the target that are not repeated in the reference: hash and occurrences."""
    names = list(cols or target.columns)

    def repeated(df: DataFrame) -> DataFrame:
        h = df.select(F.lower(F.hex(row_digest(df, names))).alias("row_hash"))
        return h.groupBy("row_hash").agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")

    return repeated(target).join(repeated(reference).select("row_hash"), "row_hash", "left_anti")


def link_records(
    target: DataFrame, reference: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None
) -> DataFrame:
    """Adds link_status to every target row: known, changed or new.

    The reference is reduced to one row per key and content before the join, then both tests are
    made on one row per key, so repeated keys on either side never multiply rows.
    """
    shared = set(reference.columns)
    names = list(compare) if compare else [c for c in target.columns if c in shared and c not in keys]
    content = [
        df.withColumns({"_key": row_digest(df, keys), "_body": row_digest(df, names)}) for df in (target, reference)
    ]
    full = content[1].select("_key", "_body").distinct().withColumn("_same", F.lit(True))
    by_key = full.select("_key").distinct().withColumn("_any", F.lit(True))
    return (
        content[0]
        .join(full, ["_key", "_body"], "left")
        .join(by_key, "_key", "left")
        .withColumn(
            "link_status",
            F.when(F.col("_same"), "known").when(F.col("_any"), "changed").otherwise("new"),
        )
        .select(*[ref(c) for c in target.columns], "link_status")
    )


def unmatched_reference(target: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reference rows whose key the target lacks."""
    t = target.select(row_digest(target, keys).alias("_key")).distinct()
    return reference.withColumn("_key", row_digest(reference, keys)).join(t, "_key", "left_anti").drop("_key")

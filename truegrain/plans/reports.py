"""Whole reports: each is one row, built from as few passes over the data as its figures need."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegrain.functions import bands
from truegrain.functions.missing import ref
from truegrain.operators.profile import SPARSE_RATIO, WEIGHTS, score_parts, weighted_score, profile_row


def completeness_report(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    critical_cols: Sequence[str] | None = None,
    threshold: float = SPARSE_RATIO,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """All completeness figures of a table in one row, from one scan."""
    names = list(cols or df.columns)
    row = profile_row(df, names, critical_cols, sentinels).select("*", *score_parts())
    labels = F.array(*[F.lit(c) for c in names])
    rows = F.col("total_rows").cast("double")
    per = F.arrays_zip(labels.alias("name"), "missing")
    scored = row.withColumn("overall_quality_score", weighted_score(WEIGHTS))
    sparse = F.transform(
        F.filter(per, lambda x: F.try_divide(x["missing"].cast("double"), rows) > threshold),
        lambda x: x["name"],
    )
    return scored.select(
        "total_rows",
        "total_columns",
        "incomplete_rows",
        F.try_divide(F.lit(100.0) * F.col("incomplete_rows").cast("double"), rows).alias("incomplete_percentage"),
        labels.alias("columns_analyzed"),
        F.array_sort(sparse).alias("sparse_columns"),
        F.map_from_entries(
            F.transform(
                per,
                lambda x: F.struct(
                    x["name"],
                    F.try_divide(F.lit(100.0) * (F.col("total_rows") - x["missing"]).cast("double"), rows),
                ),
            )
        ).alias("completeness_by_column"),
        "overall_quality_score",
        bands.score_assessment(F.col("overall_quality_score")).alias("quality_assessment"),
        F.transform(
            F.array_sort(sparse), lambda c: F.concat(F.lit("Column "), c, F.lit(" needs attention"))
        ).alias("recommendations"),
    )


def duplicate_report(
    df: DataFrame, index: str, cols: Sequence[str] | None = None, k: int = 10
) -> DataFrame:
    """All exact-duplicate figures of a table in one row, keeping the first of each group.

    Group sizes are counted once; the summary and the size distribution come from that count.
    """
    from truegrain.operators.duplicates import group_sizes, metrics_of, top_duplicates

    names = list(cols) if cols else [c for c in df.columns if c != index]
    keyed = df.select(ref(index), *[ref(c) for c in names if c != index])
    by_size = group_sizes(keyed, names).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))
    repeated = F.when(F.col("n") > 1, F.struct("n", "groups"))
    counts = by_size.agg(
        F.coalesce(F.sum(F.col("n") * F.col("groups")), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("groups"), F.lit(0)).alias("rows_after"),
        F.coalesce(F.sum("groups"), F.lit(0)).alias("unique_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("groups"))), F.lit(0)).alias("duplicate_groups"),
        F.map_from_entries(F.array_sort(F.collect_list(repeated))).alias("duplicate_patterns"),
    )
    ordered = top_duplicates(keyed, index, names, k).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("occurrences")).alias("o"), "row_hash", "sample_rows"))
        ).alias("r")
    )
    records = ordered.select(
        F.transform(
            "r",
            lambda x: F.struct(
                x["row_hash"].alias("row_hash"), (-x["o"]).alias("occurrences"), x["sample_rows"].alias("sample_rows")
            ),
        )
    ).scalar()
    return metrics_of(counts, "duplicate_groups", "duplicate_patterns").select(
        F.col("rows_before").alias("total_rows_original"),
        F.col("rows_after").alias("total_rows_processed"),
        F.lit(len(names)).cast("bigint").alias("total_columns"),
        "duplicate_rows_removed",
        "duplicate_percentage",
        "duplicate_groups",
        "duplicate_patterns",
        records.alias("most_duplicated_records"),
        "data_reduction_percentage",
        "quality_improvement_score",
        "uniqueness_score",
        "distinct_ratio",
        F.filter(
            F.array(
                F.when(
                    F.col("duplicate_rows_removed") > 0,
                    F.lit("Validate records at the source so that copies are refused"),
                ),
                F.when(F.col("duplicate_percentage") > 5, F.lit("Run duplicate detection with every load")),
                F.when(F.col("duplicate_groups") > 0, F.lit("Declare a unique key for the repeated records")),
            ),
            lambda x: x.isNotNull(),
        ).alias("recommendations"),
    )


def quality_report(
    df: DataFrame,
    index: str,
    cols: Sequence[str] | None = None,
    critical_cols: Sequence[str] | None = None,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Completeness part, duplicate part and overall score of a table, as one row of structs.

    The overall score is the mean of the completeness score and of the share of distinct rows.
    """
    names = list(cols) if cols else [c for c in df.columns if c != index]
    dups = duplicate_report(df, index, names).select(F.struct("*").alias("d")).scalar()
    whole = completeness_report(df, names, critical_cols, sentinels=sentinels).select(
        F.struct("*").alias("completeness"), dups.alias("duplicates")
    )
    score = (F.col("completeness.overall_quality_score") + F.col("duplicates.distinct_ratio")) / F.lit(2.0)
    return whole.withColumn("overall_score", score).select(
        "overall_score",
        bands.score_assessment(F.col("overall_score")).alias("assessment"),
        "completeness",
        "duplicates",
        F.concat_ws(
            "; ",
            F.format_string("%d rows", F.col("completeness.total_rows")),
            F.format_string("%d incomplete", F.col("completeness.incomplete_rows")),
            F.format_string("%d duplicate", F.col("duplicates.duplicate_rows_removed")),
        ).alias("summary"),
        F.concat("completeness.recommendations", "duplicates.recommendations").alias("recommendations"),
    )


def run_chain(
    df: DataFrame,
    order: str,
    use_cases: Sequence[str] = ("UC1", "UC4"),
    cols: Sequence[str] | None = None,
    critical_cols: Sequence[str] | None = None,
    keep: str = "first",
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Flag incomplete rows (UC1), remove duplicates (UC4), or both, in one lazy plan.

    Duplicates are judged on the original columns, so the flags never take part.
    """
    from truegrain.operators.duplicates import dedup
    from truegrain.operators.rows import flag_rows

    unknown = set(use_cases) - {"UC1", "UC4"}
    if unknown:
        raise ValueError(f"unknown use cases {sorted(unknown)}; choose from UC1, UC4")
    names = list(cols) if cols else [c for c in df.columns if c != order]
    out = df
    for step in use_cases:
        if step == "UC1":
            out = flag_rows(out, critical_cols, names, sentinels)
        else:
            out = dedup(out, names, keep, order)
    return out

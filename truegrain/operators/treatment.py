"""Types of text columns, descriptive statistics, and what to do about missing values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegrain.functions import bands
from truegrain.functions import scan
from truegrain.functions.missing import all_of, missing_tests, ref
from truegrain.functions.quantiles import exact_quantiles
from truegrain.operators.profile import (
    SPARSE_RATIO,
    column_completeness,
    column_types,
    parses_as,
    sparse_columns,
)

def type_conformance(df: DataFrame, expected: Mapping[str, str], sentinels: Iterable[str] = ()) -> DataFrame:
    """Per column: values present, values that parse as the expected kind, and their share."""
    names = list(expected)
    tests = missing_tests(df, names, sentinels)
    row = df.agg(
        F.array(*[F.count_if(~tests[c]) for c in names]).alias("present"),
        F.array(*[F.count_if(~tests[c] & parses_as(ref(c), k)) for c, k in expected.items()]).alias("conforming"),
    )
    return row.select(
        F.inline(
            F.arrays_zip(
                F.array(*[F.lit(c) for c in names]).alias("column_name"),
                F.array(*[F.lit(expected[c]) for c in names]).alias("expected_kind"),
                "present",
                "conforming",
            )
        )
    ).withColumn(
        "conformance_pct",
        F.try_divide(F.lit(100.0) * F.col("conforming").cast("double"), F.col("present").cast("double")),
    )


def infer_types(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    threshold: float = 0.95,
    max_categories: int = 50,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """First kind (integer, decimal, date, timestamp) that enough values parse as, else categorical or string."""
    names = list(cols or df.columns)
    kinds = ["integer", "decimal", "date", "timestamp"]
    tests = missing_tests(df, names, sentinels)
    text = {c: ref(c).cast("string") for c in names}
    # First one column of verdicts per text column, then counts of the verdicts.
    verdicts = df.select(
        *[
            F.when(
                ~tests[c],
                F.struct(text[c].alias("v"), *[F.coalesce(parses_as(text[c], k), F.lit(False)).alias(k) for k in kinds]),
            ).alias(f"t{i}")
            for i, c in enumerate(names)
        ]
    )
    row = verdicts.agg(
        *[
            F.struct(
                F.count(f"t{i}").alias("n"),
                *[F.count_if(F.col(f"t{i}.{k}")).alias(k) for k in kinds],
            ).alias(f"s{i}")
            for i in range(len(names))
        ]
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("s")) for i, c in enumerate(names)]
    )
    long = row.select(F.inline(cells))
    kind = F.when(F.col("s.n") == 0, "unknown")
    for k in kinds:
        kind = kind.when(F.col(f"s.{k}") >= threshold * F.col("s.n"), k)
    kind = kind.when(F.coalesce("values", F.lit(0)) <= max_categories, "categorical").otherwise("string")
    counted = long.join(_distinct_values(df, tests), "column_name", "left")
    return counted.select("column_name", F.col("s.n").alias("present"), kind.alias("inferred_kind"))


def _distinct_values(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """column_name, values: distinct present values, counted exactly and as text; a task sends each value once."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(~t, ref(c).cast("string")).alias("v")) for c, t in tests.items()])
    return df.select(F.inline(cells)).filter("v is not null").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("values"))


def describe_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, min, max, mean, sample deviation, quartiles and distinct estimate per column.

    Numeric columns carry all figures, other atomic columns only counts and text extremes.
    Quartiles are exact values of the column, at any size.
    """
    kinds = column_types(df)
    names = [c for c in (cols or df.columns) if kinds[c] != "other"]
    tests = missing_tests(df, names)
    aggs, cells, numbers = [], [], []
    for i, c in enumerate(names):
        numeric = kinds[c] in ("integer", "decimal")
        v = F.when(~tests[c], ref(c))
        none = F.lit(None).cast("double")
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.min(v).cast("string").alias(f"lo{i}"),
            F.max(v).cast("string").alias(f"hi{i}"),
            F.approx_count_distinct(v).alias(f"d{i}"),
        ]
        if numeric:
            x = v.cast("double")
            aggs += [
                F.avg(x).alias(f"avg{i}"),
                F.stddev_samp(x).alias(f"sd{i}"),
            ]
            numbers.append(F.struct(F.lit(c).alias("of_column"), x.alias("v")))
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(kinds[c]).alias("kind"),
                F.col(f"n{i}").alias("present"),
                F.col(f"lo{i}").alias("min_value"),
                F.col(f"hi{i}").alias("max_value"),
                F.col(f"d{i}").alias("distinct_estimate"),
                (F.col(f"avg{i}") if numeric else none).alias("mean"),
                (F.col(f"sd{i}") if numeric else none).alias("stddev"),
            )
        )
    described = df.agg(*aggs).select(F.inline(F.array(*cells)))
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    if not numbers:
        return described.withColumns({q: none for q in quartiles})
    found = exact_quantiles(df.select(F.inline(F.array(*numbers))), ["of_column"], "v", list(quartiles.values()))
    by_column = found.groupBy("of_column").agg(*[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(q) for q, p in quartiles.items()])
    return described.join(by_column, F.col("column_name") == F.col("of_column"), "left").drop("of_column")


def recommend_treatment(
    df: DataFrame,
    important: Sequence[str] = (),
    threshold: float = SPARSE_RATIO,
    cols: Sequence[str] | None = None,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Per column: accept, impute (median or mode), improve collection, or remove."""
    kinds = column_types(df)
    names = list(cols or df.columns)
    numeric = [c for c in names if kinds[c] in ("integer", "decimal")]
    per = column_completeness(df, names, sentinels)
    severity = bands.sparsity_severity(F.col("missing_ratio"))
    is_important = F.col("column_name").isin(list(important)) if important else F.lit(False)
    is_numeric = F.col("column_name").isin(numeric) if numeric else F.lit(False)
    return per.select("column_name", "missing_ratio", severity.alias("severity")).withColumn(
        "treatment",
        F.when(F.col("missing_ratio") == 0, "accept")
        .when((F.col("severity") == "critical") & ~is_important, "remove")
        .when((F.col("missing_ratio") > threshold) & is_important, "improve_collection")
        .when(is_numeric, "impute_median")
        .otherwise("impute_mode"),
    )


def recommendations(
    df: DataFrame,
    important: Sequence[str] = (),
    cols: Sequence[str] | None = None,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Advice per column that needs attention, most pressing first by `priority`."""
    plan = recommend_treatment(df, important, cols=cols, sentinels=sentinels)
    pct = F.format_string("%d", F.floor(F.lit(100.0) * F.col("missing_ratio")))
    what = (
        F.when(F.col("treatment") == "remove", "remove the column or find another source")
        .when(F.col("treatment") == "improve_collection", "improve how the field is collected")
        .when(F.col("treatment") == "impute_median", "impute with the median")
        .otherwise("impute with the most frequent value")
    )
    rank = (
        F.when(F.col("severity") == "critical", 1)
        .when(F.col("severity") == "high", 2)
        .when(F.col("severity") == "moderate", 3)
        .when(F.col("severity") == "low", 4)
        .otherwise(5)
    )
    return plan.filter(F.col("treatment") != "accept").select(
        rank.cast("bigint").alias("priority"),
        "column_name",
        F.concat(F.col("column_name"), F.lit(" is "), pct, F.lit("% missing: "), what).alias("recommendation"),
    )


def impute(df: DataFrame, plan: Mapping[str, str | tuple[str, object]], sentinels: Iterable[str] = ()) -> DataFrame:
    """Fill missing cells by column: 'mean', 'median', 'mode' or ('constant', value).

    Means of all columns come from one aggregate; an exact median or a mode needs a count per value,
    equal counts are settled by the larger value.
    """
    tests = missing_tests(df, list(plan), sentinels)
    types = {f.name: f.dataType for f in df.schema.fields}
    stats: list[Column] = []
    medians: dict[str, Column] = {}
    for c, how in plan.items():
        v = F.when(~tests[c], ref(c))
        if how == "mean":
            stats.append(F.avg(v.cast("double")).alias(c))
        elif how == "median":
            medians[c] = exact_quantiles(df.select(v.alias("v")), [], "v", [0.5]).agg(F.max("quantile").alias("m")).scalar()
        elif how != "mode" and not (isinstance(how, tuple) and how[0] == "constant"):
            raise ValueError(f"unknown imputation {how!r} for {c}")
    whole = df.agg(*stats).select(F.struct("*").alias("s")).scalar() if stats else None
    fills: dict[str, Column] = {}
    for c, how in plan.items():
        if isinstance(how, tuple):
            fill = F.lit(how[1])
        elif how == "mode":
            counts = df.filter(~tests[c]).groupBy(ref(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            fill = counts.agg(F.max(F.struct("n", "v")).alias("m")).select("m.v").scalar()
        else:
            fill = medians[c] if how == "median" else whole[c]
        target = T.DoubleType() if how == "mean" else types[c]
        fills[c] = F.when(tests[c], fill.cast(target)).otherwise(ref(c).cast(target))
    return df.select(*[fills[c].alias(c) if c in fills else ref(c) for c in df.columns])


def ffill(
    df: DataFrame,
    cols: Sequence[str],
    order: str,
    partition: Sequence[str] = (),
    sentinels: Iterable[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Carry the last present value forward along an order column of any sort.

    The table is cut into segments by row count, so one huge group (or no grouping at all) is spread
    evenly however its order values lie: windows run inside a segment, and the last present value of
    a segment, one row per group and segment, is carried to the segments after it.
    """
    tests = missing_tests(df, list(cols), sentinels)
    keys = [f"_g{i}" for i in range(len(partition))]
    clean = df.withColumns({k: ref(c) for k, c in zip(keys, partition)} | {"_o": ref(order)} | {c: F.when(~tests[c], ref(c)) for c in cols})
    cut = scan.segmented(clean, keys, ["_o"], width)
    carried = scan.with_carried(cut, keys, ["_o"], {f"_l{i}": ref(c) for i, c in enumerate(cols)})
    w = scan.inside(keys, ["_o"]).rowsBetween(Window.unboundedPreceding, 0)
    new = {c: F.coalesce(F.last(ref(c), ignorenulls=True).over(w), F.col(f"_l{i}")).alias(c) for i, c in enumerate(cols)}
    return carried.select(*[new.get(c, ref(c)) for c in df.columns])


def drop_sparse_columns(df: DataFrame, threshold: float = SPARSE_RATIO, **kw) -> DataFrame:
    """Without the columns over the threshold. One action learns their names (a row per column)."""
    names = [r["column_name"] for r in sparse_columns(df, threshold, **kw).select("column_name").collect()]
    return df.drop(*names)


def valid_rows(
    df: DataFrame,
    critical_cols: Sequence[str],
    expected: Mapping[str, str] | None = None,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Rows complete on the critical columns whose present values parse as expected."""
    tests = missing_tests(df, None, sentinels)
    ok = [~tests[c] for c in critical_cols]
    ok += [tests[c] | parses_as(ref(c), k) for c, k in (expected or {}).items()]
    return df.filter(all_of(ok))

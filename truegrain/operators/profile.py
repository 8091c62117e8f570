"""Completeness of columns and of the whole table, from one aggregate over the data.

`profile_row` reads the table once and returns one row of counts. Every operator here
is arithmetic over that row, so a report needs one scan however many figures it holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegrain.functions import bands
from truegrain.functions.missing import all_of, any_of, missing_count, missing_tests, ref, total_of

# Default weights of the composite score and penalty per severity.
WEIGHTS = {"completeness": 40, "sparsity": 30, "row": 20, "pattern": 10}
PENALTY = {"critical": 1.0, "high": 0.75, "moderate": 0.5, "low": 0.25, "none": 0.0}
SPARSE_RATIO = 0.3

KINDS = ("integer", "decimal", "date", "timestamp", "string", "categorical")


def parses_as(value: Column, kind: str) -> Column:
    """True when the text reads as the given kind; `string` and `categorical` always do."""
    if kind in ("string", "categorical"):
        return F.lit(True)
    text = F.btrim(value.cast("string"))
    if kind == "integer":
        return text.rlike(r"^[+-]?[0-9]+$") & text.try_cast("bigint").isNotNull()
    if kind == "decimal":
        return text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    if kind == "date":
        return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & text.try_cast("date").isNotNull()
    if kind == "timestamp":
        return text.try_cast("timestamp_ntz").isNotNull()
    raise ValueError(f"unknown kind {kind!r}; choose from {', '.join(KINDS)}")


def profile_row(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    critical_cols: Sequence[str] | None = None,
    sentinels: Iterable[str] = (),
    expected: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row of counts: rows, missing per column, incomplete rows, row emptiness, conforming cells."""
    tests = missing_tests(df, cols, sentinels)
    n = len(tests)
    critical = missing_tests(df, critical_cols, sentinels) if critical_cols else tests
    flags = [f"_m{i}" for i in range(n)]
    # Test each cell once; the counts below refer to the flags.
    projected = [t.alias(f) for f, t in zip(flags, tests.values())]
    projected.append(any_of(list(critical.values())).alias("_incomplete"))
    checked = {c: k for c, k in (expected or {}).items() if k not in ("string", "categorical")}
    for i, (c, kind) in enumerate(checked.items()):
        projected.append((parses_as(ref(c), kind) | missing_tests(df, [c], sentinels)[c]).alias(f"_t{i}"))
    flagged = df.select(*projected).withColumn("_n", missing_count([F.col(f) for f in flags]))
    ratio = F.col("_n") / F.lit(float(n))
    bucket = bands.row_emptiness(ratio)
    nonconforming = [F.count_if(~F.col(f"_t{i}")) for i in range(len(checked))]
    return flagged.withColumn("_bucket", bucket).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.array(*[F.count_if(F.col(f)) for f in flags]).alias("missing"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("row_side_missing"),
        F.count_if("_incomplete").alias("incomplete_rows"),
        *[
            F.count_if(F.col("_bucket") == b).alias(f"{b}_rows")
            for b in ("empty", "mostly", "substantially", "partially", "acceptable")
        ],
        (total_of(nonconforming) if nonconforming else F.lit(0)).cast("bigint").alias("nonconforming_cells"),
    ).select(F.lit(n).cast("bigint").alias("total_columns"), "*")


def _columns_of(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(df.columns) if cols is None else list(cols)


def _missing_cells() -> Column:
    return F.aggregate("missing", F.lit(0).cast("bigint"), lambda a, x: a + x)


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def _pct(num: Column, den: Column) -> Column:
    return F.try_divide(F.lit(100.0) * num.cast("double"), den.cast("double"))


def column_types(df: DataFrame) -> dict[str, str]:
    """Column name to one of integer, decimal, date, timestamp, string, other."""
    kinds: list[tuple[type, str]] = [
        (T.IntegralType, "integer"),
        (T.NumericType, "decimal"),
        (T.DateType, "date"),
        (T.TimestampType, "timestamp"),
        (T.TimestampNTZType, "timestamp"),
        (T.StringType, "string"),
        (T.BooleanType, "boolean"),
    ]
    return {
        f.name: next((k for t, k in kinds if isinstance(f.dataType, t)), "other") for f in df.schema.fields
    }


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns, cells and the number of columns of each kind."""
    kinds = list(column_types(df).values())
    n = len(kinds)
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        F.lit(n).cast("bigint").alias("total_columns"),
        (F.col("total_rows") * n).alias("total_cells"),
        *[
            F.lit(kinds.count(k)).cast("bigint").alias(f"{k}_columns")
            for k in ("integer", "decimal", "date", "timestamp", "string")
        ],
    )


def column_completeness(
    df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()
) -> DataFrame:
    """Per column: missing count, missing ratio and completeness percentage."""
    return _long(profile_row(df, cols, sentinels=sentinels), _columns_of(df, cols))


def _long(row: DataFrame, names: Sequence[str]) -> DataFrame:
    return (
        row.select(
            "total_rows",
            F.posexplode(F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("name"), "missing")),
        )
        .select(
            F.col("pos").cast("bigint").alias("position"),
            F.col("col")["name"].alias("column_name"),
            F.col("total_rows"),
            F.col("col")["missing"].alias("missing_count"),
        )
        .select(
            "*",
            _ratio(F.col("missing_count"), F.col("total_rows")).alias("missing_ratio"),
            _pct(F.col("total_rows") - F.col("missing_count"), F.col("total_rows")).alias("completeness_pct"),
        )
    )


def overall_completeness(
    df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()
) -> DataFrame:
    """Total and missing cells, completeness percentage, missing density and category."""
    return _overall(profile_row(df, cols, sentinels=sentinels))


def _overall(row: DataFrame) -> DataFrame:
    cells, gone = F.col("total_rows") * F.col("total_columns"), _missing_cells()
    return row.select(
        "total_rows",
        "total_columns",
        cells.alias("total_cells"),
        gone.alias("missing_cells"),
        _pct(cells - gone, cells).alias("completeness_pct"),
        _ratio(gone, cells).alias("missing_density"),
    ).withColumn("category", bands.quality_category(F.col("completeness_pct")))


def with_quality_category(df: DataFrame, **kw) -> DataFrame:
    """Column completeness with its category."""
    return column_completeness(df, **kw).withColumn(
        "category", bands.quality_category(F.col("completeness_pct"))
    )


def empty_columns(df: DataFrame, **kw) -> DataFrame:
    """Columns that hold no value at all."""
    return column_completeness(df, **kw).filter("total_rows > 0 AND missing_count = total_rows")


def sparse_columns(df: DataFrame, threshold: float = SPARSE_RATIO, **kw) -> DataFrame:
    """Columns whose missing ratio exceeds the threshold."""
    return column_completeness(df, **kw).filter(F.col("missing_ratio") > threshold)


def sparsity_severity(df: DataFrame, **kw) -> DataFrame:
    """Column completeness with the severity of its sparsity."""
    return column_completeness(df, **kw).withColumn(
        "severity", bands.sparsity_severity(F.col("missing_ratio"))
    )


def severity_breakdown(df: DataFrame, **kw) -> DataFrame:
    """Number of columns per severity."""
    return sparsity_severity(df, **kw).groupBy("severity").agg(F.count(F.lit(1)).alias("columns"))


def rank_sparse(df: DataFrame, **kw) -> DataFrame:
    """Columns ranked by missing ratio, equal ratios by name.

    The rank is taken inside the one profile row by sorting an array with one entry per
    column, so no window over the table is involved.
    """
    names = _columns_of(df, kw.get("cols"))
    row = profile_row(df, kw.get("cols"), sentinels=kw.get("sentinels", ()))
    ranked = F.array_sort(
        F.transform(
            F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("name"), "missing"),
            lambda x: F.struct((-x["missing"]).alias("neg"), x["name"].alias("name")),
        )
    )
    return row.select("total_rows", F.posexplode(ranked)).select(
        (F.col("pos") + 1).cast("bigint").alias("sparsity_rank"),
        F.col("col")["name"].alias("column_name"),
        (-F.col("col")["neg"]).alias("missing_count"),
        _ratio(-F.col("col")["neg"], F.col("total_rows")).alias("missing_ratio"),
    )


def completeness_outliers(df: DataFrame, z: float = 2.0, **kw) -> DataFrame:
    """Columns whose completeness lies more than z population deviations from the column mean.

    The score is formed from exact integer counts: (n*k - S) / sqrt(n*SS - S*S), with k the
    present cells of a column, S and SS their sum and sum of squares over n columns.
    """
    names = _columns_of(df, kw.get("cols"))
    n = len(names)
    big = "decimal(38,0)"
    row = profile_row(df, kw.get("cols"), sentinels=kw.get("sentinels", ()))
    present = F.transform("missing", lambda m: (F.col("total_rows") - m).cast("decimal(19,0)"))
    row = row.withColumn("present", present)
    zero = F.lit(0).cast(big)
    s = F.aggregate("present", zero, lambda a, x: (a + x).cast(big))
    ss = F.aggregate("present", zero, lambda a, x: (a + x * x).cast(big))
    out = row.select(s.alias("s"), ss.alias("ss"), F.posexplode("present").alias("pos", "k"), "total_rows")
    spread = F.sqrt((F.lit(n) * F.col("ss") - F.col("s") * F.col("s")).cast("double"))
    score = F.try_divide((F.lit(n) * F.col("k") - F.col("s")).cast("double"), spread)
    return out.select(
        F.element_at(F.array(*[F.lit(c) for c in names]), F.col("pos") + 1).alias("column_name"),
        _pct(F.col("k"), F.col("total_rows")).alias("completeness_pct"),
        score.alias("z_score"),
    ).withColumn("is_outlier", F.coalesce(F.abs("z_score") > z, F.lit(False)))


def completeness_variance(df: DataFrame, **kw) -> DataFrame:
    """Mean and population variance of the completeness percentage across columns."""
    big = "decimal(38,0)"
    row = profile_row(df, kw.get("cols"), sentinels=kw.get("sentinels", ()))
    zero = F.lit(0).cast(big)
    row = row.withColumn(
        "present", F.transform("missing", lambda m: (F.col("total_rows") - m).cast("decimal(19,0)"))
    )
    n = F.col("total_columns").cast("decimal(10,0)")
    s = F.aggregate("present", zero, lambda a, x: (a + x).cast(big))
    ss = F.aggregate("present", zero, lambda a, x: (a + x * x).cast(big))
    cells = F.col("total_rows").cast("double") * F.col("total_columns").cast("double")
    return row.select(
        F.try_divide(F.lit(100.0) * s.cast("double"), cells).alias("mean_completeness_pct"),
        F.try_divide(F.lit(10000.0) * (n * ss - s * s).cast("double"), cells * cells).alias("variance"),
    )


# -- scores -------------------------------------------------------------------------


def score_parts() -> list[Column]:
    """The four parts of the composite score, each 0 to 100, over a profile row."""
    total, n = F.col("total_rows").cast("double"), F.col("total_columns").cast("double")
    gone = _missing_cells()
    cells = F.col("total_rows") * F.col("total_columns")
    present = (cells - gone).cast("double")

    def penalty(m: Column) -> Column:
        sev = bands.sparsity_severity(_ratio(m, F.col("total_rows")))
        out = F.lit(0.0)
        for label, p in PENALTY.items():
            out = F.when(sev == label, p).otherwise(out)
        return out

    penalties = F.aggregate("missing", F.lit(0.0), lambda a, m: a + penalty(m))
    half = F.col("empty_rows").cast("double") + F.lit(0.5) * F.col("mostly_rows").cast("double")
    return [
        (F.lit(100.0) * (F.lit(1.0) - F.try_divide(gone.cast("double"), cells.cast("double")))).alias(
            "completeness_part"
        ),
        (F.lit(100.0) * (F.lit(1.0) - F.try_divide(penalties, n))).alias("sparsity_part"),
        (F.lit(100.0) * (F.lit(1.0) - F.try_divide(half, total))).alias("row_part"),
        F.coalesce(
            F.try_divide(
                F.lit(100.0) * (present - F.col("nonconforming_cells").cast("double")), present
            ),
            F.lit(100.0),
        ).alias("pattern_part"),
    ]


def weighted_score(weights: Mapping[str, float]) -> Column:
    names = list(WEIGHTS)
    unknown = set(weights) - set(names)
    if unknown:
        raise ValueError(f"unknown score parts {sorted(unknown)}; choose from {names}")
    scale = float(sum(weights.values()))
    parts = [F.lit(float(weights[k])) * F.col(f"{k}_part") for k in names if k in weights]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out / F.lit(scale)


def quality_score(
    df: DataFrame,
    weights: Mapping[str, float] | None = None,
    cols: Sequence[str] | None = None,
    expected: Mapping[str, str] | None = None,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Composite score 0-100 with its parts and category."""
    row = profile_row(df, cols, sentinels=sentinels, expected=expected)
    return (
        row.select(*score_parts())
        .withColumn("quality_score", weighted_score(weights or WEIGHTS))
        .withColumn("category", bands.score_category(F.col("quality_score")))
        .withColumn("assessment", bands.score_assessment(F.col("quality_score")))
    )


def three_part_score(
    df: DataFrame,
    rules: Sequence[str],
    weights: Sequence[float] = (0.4, 0.3, 0.3),
    cols: Sequence[str] | None = None,
    expected: Mapping[str, str] | None = None,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Completeness, consistency (type conformance) and accuracy (share of rows passing SQL rules)."""
    tests = list(missing_tests(df, cols, sentinels).values())
    checked = {c: k for c, k in (expected or {}).items() if k not in ("string", "categorical")}
    present = [~missing_tests(df, [c], sentinels)[c] for c in checked]
    conform = [p & parses_as(ref(c), k) for p, (c, k) in zip(present, checked.items())]
    passes = all_of([F.coalesce(F.expr(r), F.lit(False)) for r in rules])
    zero = F.lit(0)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(missing_count(tests)).cast("bigint").alias("gone"),
        F.sum(missing_count(present) if present else zero).cast("bigint").alias("present"),
        F.sum(missing_count(conform) if conform else zero).cast("bigint").alias("conform"),
        F.count_if(passes).alias("passed"),
    )
    cells = F.col("rows") * len(tests)
    wc, wk, wa = (F.lit(float(w)) for w in weights)
    return row.select(
        _pct(cells - F.col("gone"), cells).alias("completeness_part"),
        F.coalesce(_pct(F.col("conform"), F.col("present")), F.lit(100.0)).alias("consistency_part"),
        _pct(F.col("passed"), F.col("rows")).alias("accuracy_part"),
    ).withColumn(
        "quality_score",
        wc * F.col("completeness_part") + wk * F.col("consistency_part") + wa * F.col("accuracy_part"),
    )


def classify_file(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    critical_cols: Sequence[str] | None = None,
    threshold: float = SPARSE_RATIO,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Verdict on the whole table: sparse, acceptable or excellent, and whether to use it as is."""
    names = _columns_of(df, cols)
    critical = set(critical_cols or names)
    row = profile_row(df, cols, sentinels=sentinels)
    cells, gone = F.col("total_rows") * F.col("total_columns"), _missing_cells()
    sparse = F.exists(
        F.arrays_zip(F.array(*[F.lit(c in critical) for c in names]).alias("critical"), "missing"),
        lambda x: x["critical"] & (F.coalesce(_ratio(x["missing"], F.col("total_rows")), F.lit(0.0)) > threshold),
    )
    return (
        row.select(_pct(cells - gone, cells).alias("completeness_pct"), sparse.alias("has_sparse_critical"))
        .withColumn("verdict", bands.file_verdict(F.col("completeness_pct"), F.col("has_sparse_critical")))
        .withColumn("is_sparse", F.col("verdict") == "sparse")
        .withColumn(
            "use_as_is",
            F.when(F.col("verdict") == "excellent", "yes")
            .when(F.col("verdict") == "acceptable", "conditional")
            .otherwise("no"),
        )
    )


def consistency_check(df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()) -> DataFrame:
    """Column-side and row-side missing totals agree, and the row buckets add up to the rows."""
    buckets = total_of(
        [F.col(f"{b}_rows") for b in ("empty", "mostly", "substantially", "partially", "acceptable")]
    )
    return profile_row(df, cols, sentinels=sentinels).select(
        _missing_cells().alias("column_side_missing"),
        "row_side_missing",
        buckets.alias("bucket_rows"),
        "total_rows",
        (_missing_cells() == F.col("row_side_missing")).alias("missing_totals_agree"),
        (buckets == F.col("total_rows")).alias("buckets_cover_rows"),
    )


def criticality_matrix(df: DataFrame, importance: Mapping[str, str], **kw) -> DataFrame:
    """Columns counted by business importance and completeness category.

    The importance of each column is given by the caller, one entry per column at most.
    """
    level = F.lit("unrated")
    for c, label in importance.items():
        level = F.when(F.col("column_name") == c, label).otherwise(level)
    return (
        with_quality_category(df, **kw)
        .withColumn("importance", level)
        .groupBy("importance", "category")
        .agg(
            F.count(F.lit(1)).alias("columns"),
            F.array_join(F.sort_array(F.collect_list("column_name")), ",").alias("column_names"),
        )
    )

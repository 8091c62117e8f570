"""Row-level completeness: flags, emptiness bands, and patterns along the row order.

The order-based operators take a column of dense row positions (0, 1, 2, ... as made by
`truegrain.sources.order.with_row_index`). They cut the table into stretches of `stretch`
consecutive positions and copy the last row of each stretch into the next one, so that
"the row before" is a window inside a bounded stretch and never one window over the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truegrain.functions import bands
from truegrain.functions.missing import any_of, missing_count, missing_tests, ref

STRETCH = 1_000_000


def _score(tests: Sequence[Column], count: Column) -> Column:
    n = float(len(tests))
    return F.lit(100.0) * (F.lit(n) - count.cast("double")) / F.lit(n)


def with_missing_count(df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()) -> DataFrame:
    """Adds missing_value_count."""
    tests = missing_tests(df, cols, sentinels)
    return df.select("*", missing_count(tests.values()).alias("missing_value_count"))


def with_completeness_score(df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()) -> DataFrame:
    """Adds completeness_score, the percentage of checked columns that hold a value."""
    tests = list(missing_tests(df, cols, sentinels).values())
    return df.select("*", _score(tests, missing_count(tests)).alias("completeness_score"))


def with_incomplete_flag(
    df: DataFrame, critical_cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()
) -> DataFrame:
    """Adds is_incomplete: any critical column is missing (all columns are critical by default)."""
    tests = missing_tests(df, critical_cols, sentinels)
    return df.select("*", any_of(list(tests.values())).alias("is_incomplete"))


def with_quality_flag(df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()) -> DataFrame:
    """Adds quality_flag: COMPLETE, PARTIAL or INCOMPLETE."""
    tests = list(missing_tests(df, cols, sentinels).values())
    return df.select("*", bands.quality_flag(_score(tests, missing_count(tests))).alias("quality_flag"))


def flag_rows(
    df: DataFrame,
    critical_cols: Sequence[str] | None = None,
    cols: Sequence[str] | None = None,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """All original columns, then the four flag columns. Stateless: works on a stream as well."""
    tests = list(missing_tests(df, cols, sentinels).values())
    critical = list(missing_tests(df, critical_cols or cols, sentinels).values())
    counted = df.select(
        "*", any_of(critical).alias("is_incomplete"), missing_count(tests).alias("missing_value_count")
    )
    score = _score(tests, F.col("missing_value_count"))
    return counted.select("*", score.alias("completeness_score")).select(
        "*", bands.quality_flag(F.col("completeness_score")).alias("quality_flag")
    )


def incomplete_summary(df: DataFrame, critical_cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()) -> DataFrame:
    """Incomplete and complete rows, with the percentage incomplete."""
    flag = any_of(list(missing_tests(df, critical_cols, sentinels).values()))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(flag).alias("incomplete_rows")
    ).select(
        "total_rows",
        "incomplete_rows",
        (F.col("total_rows") - F.col("incomplete_rows")).alias("complete_rows"),
        F.try_divide(
            F.lit(100.0) * F.col("incomplete_rows").cast("double"), F.col("total_rows").cast("double")
        ).alias("incomplete_pct"),
    )


def _ratio(tests: dict[str, Column]) -> Column:
    return missing_count(tests.values()) / F.lit(float(len(tests)))


def empty_rows(df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()) -> DataFrame:
    """Rows in which every checked column is missing."""
    tests = missing_tests(df, cols, sentinels)
    return df.filter(missing_count(tests.values()) == len(tests))


def row_emptiness_distribution(df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()) -> DataFrame:
    """Number of rows per emptiness band."""
    band = bands.row_emptiness(_ratio(missing_tests(df, cols, sentinels)))
    return df.groupBy(band.alias("emptiness")).agg(F.count(F.lit(1)).alias("rows"))


def missing_per_row_histogram(df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()) -> DataFrame:
    """Number of rows per count of missing values."""
    n = missing_count(missing_tests(df, cols, sentinels).values())
    return df.groupBy(n.cast("bigint").alias("missing_values")).agg(F.count(F.lit(1)).alias("rows"))


def row_summary(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    empty_threshold: float = 0.9,
    problem_threshold: float = 0.4,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Total, empty and mostly empty rows, and the share of problematic ones."""
    r = df.select(_ratio(missing_tests(df, cols, sentinels)).alias("r"))
    return r.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("r") >= 1.0).alias("empty_rows"),
        F.count_if((F.col("r") >= empty_threshold) & (F.col("r") < 1.0)).alias("mostly_empty_rows"),
        F.count_if(F.col("r") >= problem_threshold).alias("problematic_rows"),
    ).withColumn(
        "problematic_pct",
        F.try_divide(
            F.lit(100.0) * F.col("problematic_rows").cast("double"), F.col("total_rows").cast("double")
        ),
    )


def problematic_rows(
    df: DataFrame,
    index: str,
    cols: Sequence[str] | None = None,
    n: int = 20,
    threshold: float = 0.4,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """The first n problematic rows: position, completeness, empty fields, severity and action."""
    tests = missing_tests(df, cols, sentinels)
    r = _ratio(tests)
    fields = F.array_join(F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()]), ",")
    band = bands.row_emptiness(r)
    return (
        df.select(
            ref(index).alias("row_index"),
            _score(list(tests.values()), missing_count(tests.values())).alias("completeness_score"),
            fields.alias("empty_fields"),
            band.alias("severity"),
            r.alias("_r"),
        )
        .filter(F.col("_r") >= threshold)
        .drop("_r")
        .withColumn(
            "action",
            F.when(F.col("severity") == "empty", "drop")
            .when(F.col("severity") == "mostly", "drop_or_recover")
            .when(F.col("severity") == "substantially", "review")
            .otherwise("keep_and_impute"),
        )
        .orderBy("row_index")
        .limit(n)
    )


def treat_rows(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    drop_empty: bool = True,
    drop_above: float | None = 0.9,
    review_above: float = 0.4,
    sentinels: Iterable[str] = (),
    apply: bool = False,
) -> DataFrame:
    """Adds `action` (drop, review, keep) per row; with apply=True the rows to drop are gone."""
    r = _ratio(missing_tests(df, cols, sentinels))
    drop = F.lit(False)
    if drop_empty:
        drop = drop | (r >= 1.0)
    if drop_above is not None:
        drop = drop | (r >= drop_above)
    out = df.select(
        "*", F.when(drop, "drop").when(r >= review_above, "review").otherwise("keep").alias("action")
    )
    return out.filter(F.col("action") != "drop") if apply else out


# -- patterns along the row order ---------------------------------------------------


def with_previous(df: DataFrame, index: str, values: Sequence[str], stretch: int = STRETCH) -> DataFrame:
    """Adds prev_<value>: the value of the row before in the order of `index`, null for the first row.

    Positions may have gaps. Rows are ordered within stretches of positions; the first row of a stretch
    takes the last row of the stretch before it that has any, known from one row per stretch.
    """
    pos = ref(index)
    placed = df.withColumn("_stretch", F.floor(pos / stretch).cast("bigint"))
    inside = Window.partitionBy("_stretch").orderBy(pos)
    lasts = placed.groupBy("_stretch").agg(F.max_by(F.struct(*[ref(v).alias(f"_{i}") for i, v in enumerate(values)]), pos).alias("_last"))
    carried = lasts.select(F.col("_stretch").alias("_to"), F.lag("_last").over(Window.orderBy("_stretch")).alias("_carried"))
    out = placed.select("*", F.row_number().over(inside).alias("_rn"), *[F.lag(ref(v)).over(inside).alias(f"_p{i}") for i, v in enumerate(values)])
    out = out.join(carried, F.col("_stretch") == F.col("_to"))
    first = F.col("_rn") == 1
    previous = [F.when(first, F.col(f"_carried._{i}")).otherwise(F.col(f"_p{i}")).alias(f"prev_{v}") for i, v in enumerate(values)]
    return out.select(*[ref(c) for c in df.columns], *previous)


def empty_sections(
    df: DataFrame,
    index: str,
    cols: Sequence[str] | None = None,
    min_length: int = 2,
    stretch: int = STRETCH,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Runs of consecutive empty rows: first position, last position, length.

    Runs are first found inside each stretch. Only runs that touch a stretch border can
    continue next door: at most two per stretch, these alone are joined up in a second step.
    """
    holes = empty_rows(df, cols, sentinels).select(ref(index).cast("bigint").alias("p"))
    return _runs(holes, stretch).filter(F.col("length") >= min_length)


def _runs(holes: DataFrame, stretch: int) -> DataFrame:
    home = F.floor(F.col("p") / stretch).cast("bigint")
    w = Window.partitionBy("s").orderBy("p")
    local = (
        holes.select("p", home.alias("s"))
        .select("s", "p", (F.col("p") - F.row_number().over(w)).alias("g"))
        .groupBy("s", "g")
        .agg(F.min("p").alias("start_index"), F.max("p").alias("end_index"))
        .withColumn(
            "_edge",
            (F.col("start_index") % stretch == 0) | (F.col("end_index") % stretch == stretch - 1),
        )
    )
    edge = local.filter("_edge")
    # At most two rows per million positions are left here.
    over = Window.orderBy("start_index")
    opens = F.coalesce(F.col("start_index") != F.lag("end_index").over(over) + 1, F.lit(True))
    merged = (
        edge.withColumn("_open", opens.cast("int"))
        .withColumn("_run", F.sum("_open").over(over))
        .groupBy("_run")
        .agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"))
        .drop("_run")
    )
    return (
        local.filter(~F.col("_edge"))
        .select("start_index", "end_index")
        .unionByName(merged)
        .withColumn("length", F.col("end_index") - F.col("start_index") + 1)
    )


def empty_row_periodicity(
    df: DataFrame,
    index: str,
    cols: Sequence[str] | None = None,
    share: float = 0.8,
    stretch: int = STRETCH,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Most frequent distance between starts of empty runs, and whether it rules the table.

    Distances need the run before, which may lie any number of stretches back: the last run
    of each stretch (one row per stretch) is carried forward over the list of stretches.
    """
    runs = _runs(empty_rows(df, cols, sentinels).select(ref(index).cast("bigint").alias("p")), stretch)
    starts = runs.select("start_index", F.floor(F.col("start_index") / stretch).cast("bigint").alias("s"))
    lasts = starts.groupBy("s").agg(F.max("start_index").alias("last"))
    carried = lasts.select("s", F.lag("last").over(Window.orderBy("s")).alias("before"))
    w = Window.partitionBy("s").orderBy("start_index")
    gaps = (
        starts.join(carried, "s")
        .select((F.col("start_index") - F.coalesce(F.lag("start_index").over(w), F.col("before"))).alias("gap"))
        .filter("gap IS NOT NULL")
        .groupBy("gap")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = gaps.agg(
        F.sum("n").alias("gaps"),
        F.max(F.struct("n", (-F.col("gap")).alias("neg"))).alias("m"),
    )
    return top.filter("gaps IS NOT NULL").select(
        "gaps",
        (-F.col("m")["neg"]).alias("dominant_gap"),
        (F.col("m")["n"].cast("double") / F.col("gaps").cast("double")).alias("dominant_share"),
    ).withColumn("is_periodic", F.col("dominant_share") >= share)


def section_of(index: str, df: DataFrame, n: int) -> Column:
    """Section 0..n-1 of a row, by position; the row count is a scalar subquery."""
    total = df.agg(F.count(F.lit(1)).alias("c")).scalar()
    return F.floor(ref(index).cast("decimal(19,0)") * n / total.cast("decimal(19,0)")).cast("bigint")


def missing_by_section(
    df: DataFrame,
    index: str,
    cols: Sequence[str] | None = None,
    n: int = 10,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Missing cells and empty rows in each of n equal stretches of the table."""
    tests = missing_tests(df, cols, sentinels)
    width = len(tests)
    m = df.select(section_of(index, df, n).alias("section"), missing_count(tests.values()).alias("m"))
    return (
        m.groupBy("section")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("m").alias("missing_cells"),
            F.count_if(F.col("m") == width).alias("empty_rows"),
        )
        .withColumn(
            "missing_ratio",
            F.col("missing_cells").cast("double") / (F.col("rows") * width).cast("double"),
        )
    )


def missing_runs(
    df: DataFrame,
    index: str,
    cols: Sequence[str] | None = None,
    critical_z: float = 1.96,
    stretch: int = STRETCH,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Wald-Wolfowitz runs test per column: are missing values clustered or scattered?"""
    tests = missing_tests(df, cols, sentinels)
    names = list(tests)
    flags = df.select(
        ref(index).alias("_pos"), F.array(*[t for t in tests.values()]).alias("_m")
    )
    seen = with_previous(flags, "_pos", ["_m"], stretch)
    counts = seen.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.count_if(F.col("_m")[i]) for i in range(len(names))]).alias("n1"),
        F.array(
            *[
                F.count_if(F.col("prev__m").isNull() | (F.col("_m")[i] != F.col("prev__m")[i]))
                for i in range(len(names))
            ]
        ).alias("runs"),
    )
    per = counts.select(
        "rows",
        F.inline(F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("column_name"), "n1", "runs")),
    )
    n, a = F.col("rows").cast("double"), F.col("n1").cast("double")
    b = n - a
    twice = F.lit(2.0) * a * b
    mean = F.try_divide(twice, n) + F.lit(1.0)
    var = F.try_divide(twice * (twice - n), n * n * (n - F.lit(1.0)))
    return per.select(
        "column_name",
        F.col("n1").alias("missing_count"),
        F.col("runs"),
        mean.alias("expected_runs"),
        F.try_divide(F.col("runs").cast("double") - mean, F.sqrt(var)).alias("z_score"),
    ).withColumn(
        "layout",
        F.when(F.col("z_score").isNull(), "constant")
        .when(F.col("z_score") < -critical_z, "clustered")
        .when(F.col("z_score") > critical_z, "alternating")
        .otherwise("random"),
    )

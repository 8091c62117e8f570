"""Exact duplicates. Counting works on group keys only; whole rows move just where rows are the result."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truegrain.functions.hashing import canonical_columns, cell_hashes, group_key, row_digest, row_json
from truegrain.functions.missing import missing_count, missing_tests, ref
from truegrain.functions.session import by_shuffle
from truegrain.operators.rows import STRETCH, section_of, with_previous

KEEP = ("first", "last", "latest", "best")


def group_sizes(df: DataFrame, cols: Sequence[str] | None) -> DataFrame:
    """One row per distinct row: its key and how often it occurs."""
    keys = group_key(df, cols)
    names = [f"_k{i}" for i in range(len(keys))]
    return df.select(*keys).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def summary_of(sizes: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("n"), F.lit(0))
    return sizes.agg(
        total.alias("total_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
    ).select(
        "total_rows",
        "unique_rows",
        (F.col("total_rows") - F.col("unique_rows")).alias("duplicate_rows"),
        F.coalesce(
            F.try_divide(
                F.lit(100.0) * (F.col("total_rows") - F.col("unique_rows")).cast("double"),
                F.col("total_rows").cast("double"),
            ),
            F.lit(0.0),
        ).alias("duplicate_rate_pct"),
        "duplicate_groups",
    )


def duplicate_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Total, unique and surplus rows, surplus rate, and the number of repeated rows."""
    return summary_of(group_sizes(df, cols))


def with_row_hash(df: DataFrame, cols: Sequence[str] | None = None, name: str = "row_hash") -> DataFrame:
    """Adds a null-safe hash of the row as hexadecimal text."""
    return df.select("*", F.lower(F.hex(row_digest(df, cols))).alias(name))


def duplicate_groups(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The repeated rows with their number of occurrences, most frequent first."""
    names = list(cols or df.columns)
    return (
        df.select(*canonical_columns(df, names))
        .groupBy(*[ref(c) for c in names])
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter("occurrences > 1")
        .orderBy(F.desc("occurrences"))
    )


def _with_repeats(df: DataFrame, cols: Sequence[str] | None) -> DataFrame:
    """Adds _n, the size of the row's group if it is above one, else null.

    The counts are aggregated first and joined back: the many rows of a hot group stay spread
    over the join's left side, which adaptive execution splits, instead of one window partition.
    """
    keys = group_key(df, cols)
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *keys)
    groups = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    groups = groups.select(*[F.col(n).alias(f"_g{n}") for n in names], "_n")
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_g{n}"))
    return keyed.join(by_shuffle(groups), on, "left").drop(*names, *[f"_g{n}" for n in names])


def with_duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Adds duplicate_count: how often the row (or its columns `cols`) occurs."""
    out = _with_repeats(df, cols)
    return out.select(*[ref(c) for c in df.columns], F.coalesce("_n", F.lit(1)).cast("bigint").alias("duplicate_count"))


def keep_order(
    df: DataFrame, keep: str, order: str | None, ts: str | None = None, sentinels: Iterable[str] = ()
) -> list[Column]:
    """Sort columns under which the row to keep comes first."""
    if keep not in KEEP:
        raise ValueError(f"unknown policy {keep!r}; choose from {KEEP}")
    if order is None:
        raise ValueError("an order column is needed to say which row comes first")
    if keep == "first":
        return [ref(order).asc()]
    if keep == "last":
        return [ref(order).desc()]
    if keep == "latest":
        if ts is None:
            raise ValueError("keep='latest' needs a time column")
        return [ref(ts).desc_nulls_last(), ref(order).asc()]
    skip = {order}
    tests = missing_tests(df, [c for c in df.columns if c not in skip], sentinels)
    return [missing_count(tests.values()).asc(), ref(order).asc()]


def dedup(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    keep: str = "first",
    order: str | None = None,
    ts: str | None = None,
) -> DataFrame:
    """One row per distinct value of `cols` (default: all columns but the order column).

    The filter on row number 1 lets Spark keep one row per group and input partition before
    the shuffle, so copies of a hot row never meet in one task.
    """
    names = list(cols) if cols else [c for c in df.columns if c != order]
    keys = group_key(df, names)
    knames = [f"_k{i}" for i in range(len(keys))]
    w = Window.partitionBy(*knames).orderBy(*keep_order(df, keep, order, ts))
    return df.select("*", *keys).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", *knames)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct; which of several equal rows stays makes no difference."""
    return df.distinct()


def top_duplicates(
    df: DataFrame, index: str, cols: Sequence[str] | None = None, k: int = 10, n_idx: int = 5
) -> DataFrame:
    """The k most repeated rows: hash, count and the first n_idx positions; of equal counts the row seen first.

    At most k keys are broadcast, and per key n_idx positions leave each task.
    """
    names = list(cols) if cols else [c for c in df.columns if c != index]
    keyed = df.select(ref(index).alias("_i"), F.lower(F.hex(row_digest(df, names))).alias("row_hash"))
    top = (
        keyed.groupBy("row_hash")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.min("_i").alias("_first"))
        .filter("occurrences > 1")
        .orderBy(F.desc("occurrences"), "_first")
        .limit(k)
    )
    w = Window.partitionBy("row_hash").orderBy("_i")
    samples = (
        keyed.join(F.broadcast(top.select("row_hash")), "row_hash", "left_semi")
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= n_idx)
        .groupBy("row_hash")
        .agg(F.sort_array(F.collect_list("_i")).alias("sample_rows"))
    )
    return top.join(samples, "row_hash").select("row_hash", "occurrences", "sample_rows")


def duplicate_histogram(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Number of repeated rows per number of occurrences."""
    return (
        group_sizes(df, cols)
        .filter("n > 1")
        .groupBy(F.col("n").alias("group_size"))
        .agg(F.count(F.lit(1)).alias("groups"))
    )


def duplicate_layout(
    df: DataFrame, index: str, cols: Sequence[str] | None = None, share: float = 0.5, stretch: int = STRETCH
) -> DataFrame:
    """Do repeats follow each other directly or lie scattered over the table?"""
    names = list(cols) if cols else [c for c in df.columns if c != index]
    keyed = df.select(ref(index).alias("_i"), row_digest(df, names).alias("_h"))
    seen = with_previous(keyed, "_i", ["_h"], stretch)
    repeats = seen.agg(F.count_if(F.col("_h") == F.col("prev__h")).alias("c")).scalar()
    return (
        duplicate_summary(df, names)
        .select(
            "duplicate_rows",
            repeats.alias("consecutive_repeats"),
            (F.col("duplicate_rows") - repeats).alias("scattered_repeats"),
        )
        .withColumn(
            "layout",
            F.when(F.col("duplicate_rows") == 0, "none")
            .when(F.col("consecutive_repeats") >= share * F.col("duplicate_rows"), "clustered")
            .otherwise("scattered"),
        )
    )


def duplicates_by_section(df: DataFrame, index: str, cols: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """Rows and rows with a repeated value in each of n equal stretches of the table."""
    names = list(cols) if cols else [c for c in df.columns if c != index]
    keys = group_key(df, names)
    knames = [f"_k{i}" for i in range(len(keys))]
    # Counted per key and section first, so a hot key comes to n rows at most.
    pre = (
        df.select(section_of(index, df, n).alias("section"), *keys)
        .groupBy("section", *knames)
        .agg(F.count(F.lit(1)).alias("c"))
    )
    w = Window.partitionBy(*knames)
    return (
        pre.withColumn("t", F.sum("c").over(w))
        .groupBy("section")
        .agg(
            F.sum("c").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("t") > 1, F.col("c"))), F.lit(0)).alias("duplicate_rows"),
        )
    )


def field_contribution(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: repeat rate, and how many more rows would be duplicates without the column.

    A row's hash is the exclusive or of its cells', so the row without a column is one operation more.
    What is counted is one long table of (what, hash), in which equal entries are merged before they are
    shuffled; an empty table gives zeros and a null rate.
    """
    names = list(cols or df.columns)
    n = len(names)
    lanes = [f"{x}{i}" for i in range(n) for x in "ab"]
    cells = df.select(*[c.alias(f"{x}{i}") for i, pair in enumerate(cell_hashes(df, names)) for x, c in zip("ab", pair)])

    def whole(x: str) -> Column:
        out = F.col(f"{x}0")
        for i in range(1, n):
            out = out.bitwiseXOR(F.col(f"{x}{i}"))
        return out

    rows = cells.select(*lanes, whole("a").alias("a"), whole("b").alias("b"))
    # 0 .. n-1: the cell of a column; n .. 2n-1: the row without it; 2n: the row
    kinds = [F.struct(F.lit(i).alias("what"), F.col(f"a{i}").alias("x"), F.col(f"b{i}").alias("y")) for i in range(n)]
    if n > 1:
        kinds += [F.struct(F.lit(n + i).alias("what"), F.col("a").bitwiseXOR(F.col(f"a{i}")).alias("x"), F.col("b").bitwiseXOR(F.col(f"b{i}")).alias("y")) for i in range(n)]
    kinds.append(F.struct(F.lit(2 * n).alias("what"), F.col("a").alias("x"), F.col("b").alias("y")))
    groups = rows.select(F.inline(F.array(*kinds))).groupBy("what", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    counts = groups.groupBy("what").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"))
    per = counts.agg(F.map_from_entries(F.collect_list(F.struct("what", "d"))).alias("d"), F.coalesce(F.max("n"), F.lit(0)).alias("rows"))
    of = lambda k: F.coalesce(F.try_element_at("d", F.lit(k)), F.lit(0)).cast("bigint")
    without = lambda i: of(n + i) if n > 1 else F.least(F.col("rows"), F.lit(1)).cast("bigint")
    told = [
        F.struct(
            F.lit(c).alias("column_name"),
            of(i).alias("distinct_values"),
            (F.lit(1.0) - F.try_divide(of(i).cast("double"), F.col("rows").cast("double"))).alias("repeat_rate"),
            (of(2 * n) - without(i)).alias("rows_merged_without"),
        )
        for i, c in enumerate(names)
    ]
    return per.select(F.inline(F.array(*told)))


def null_patterns_in_duplicates(
    df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()
) -> DataFrame:
    """Missing share per column among repeated rows and among the others."""
    names = list(cols or df.columns)
    tests = missing_tests(df, names, sentinels)
    tagged = _with_repeats(df.select(*[ref(c) for c in names]), names)
    row = tagged.groupBy(F.col("_n").isNotNull().alias("is_duplicate")).agg(
        F.count(F.lit(1)).alias("rows"), F.array(*[F.count_if(t) for t in tests.values()]).alias("m")
    )
    return row.select(
        "is_duplicate",
        "rows",
        F.inline(F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("column_name"), F.col("m").alias("missing_count"))),
    ).withColumn("missing_ratio", F.col("missing_count").cast("double") / F.col("rows").cast("double"))


def duplicate_value_profile(df: DataFrame, cols: Sequence[str] | None = None, profile: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """The n most common values per column among repeated rows."""
    names = list(profile or cols or df.columns)
    repeated = _with_repeats(df, cols).filter("_n IS NOT NULL")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), ref(c).cast("string").alias("value")) for c in names])
    counts = repeated.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("column_name").orderBy(F.desc("rows"), F.asc_nulls_first("value"))
    return counts.withColumn("value_rank", F.row_number().over(w)).filter(F.col("value_rank") <= n)


def near_miss(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Groups of distinct rows that agree in every column but one.

    One row per group: the differing column, the digest of the rest, the distinct rows in it.
    Distinct rows are taken first, then each is counted once per masked column; no pairs are formed.
    """
    names = list(cols or df.columns)
    if len(names) < 2:
        raise ValueError("near misses need at least two columns")
    distinct = df.select(*canonical_columns(df, names)).distinct()
    masks = F.array(
        *[
            F.struct(F.lit(c).alias("differing_column"), row_digest(distinct, [x for x in names if x != c]).alias("rest"))
            for c in names
        ]
    )
    return (
        distinct.select(F.inline(masks))
        .groupBy("differing_column", "rest")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
        .select("differing_column", F.lower(F.hex("rest")).alias("rest_hash"), "rows")
    )


def near_miss_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Near-miss groups and rows per differing column."""
    return near_miss(df, cols).groupBy("differing_column").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows")
    )


def storage_waste(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Bytes held by surplus copies, measured on the row as JSON text."""
    names = list(cols or df.columns)
    sized = df.select(row_digest(df, names).alias("h"), F.octet_length(row_json(df, names)).cast("bigint").alias("b"))
    groups = sized.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("b").alias("b"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") * F.col("b")), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum((F.col("n") - 1) * F.col("b")), F.lit(0)).alias("surplus_bytes"),
    ).withColumn(
        "waste_pct",
        F.try_divide(F.lit(100.0) * F.col("surplus_bytes").cast("double"), F.col("total_bytes").cast("double")),
    )


def metrics_of(rows: DataFrame, *also: str) -> DataFrame:
    """Deduplication figures from a frame with rows_before, rows_after and unique_rows; `also` are kept."""
    before, after = F.col("rows_before").cast("double"), F.col("rows_after").cast("double")
    removed = F.greatest(F.lit(0).cast("bigint"), F.col("rows_before") - F.col("rows_after"))
    share = F.when(before > 0, removed.cast("double") / before * F.lit(100.0)).otherwise(F.lit(0.0))
    return rows.select(
        "rows_before",
        "rows_after",
        removed.alias("duplicate_rows_removed"),
        share.alias("duplicate_percentage"),
        share.alias("data_reduction_percentage"),
        F.least(F.lit(100.0), share * F.lit(2.0)).alias("quality_improvement_score"),
        F.when((before == after) & (before > 0), F.lit(100.0))
        .otherwise(F.lit(95.0) + F.lit(5.0) * after / F.greatest(F.lit(1.0), before))
        .alias("uniqueness_score"),
        F.when(before > 0, F.lit(100.0) * F.col("unique_rows").cast("double") / before)
        .otherwise(F.lit(100.0))
        .alias("distinct_ratio"),
        *also,
    )


def dedup_metrics(before: DataFrame, after: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Removed rows, percentages, improvement and uniqueness scores of a deduplication."""
    kept = after.agg(F.count(F.lit(1)).alias("c")).scalar()
    s = duplicate_summary(before, cols)
    return metrics_of(s.select(F.col("total_rows").alias("rows_before"), kept.alias("rows_after"), "unique_rows"))


def verify_dedup(before: DataFrame, after: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The output holds no duplicates, lost no distinct row and invented none; one shuffle of keys."""
    names = list(cols or after.columns)
    zero = F.lit(0).cast("bigint")

    def side(df: DataFrame, a: Column, b: Column) -> DataFrame:
        return df.select(row_digest(df, names).alias("h"), a.alias("a"), b.alias("b"))

    one = F.lit(1).cast("bigint")
    g = side(before, one, zero).unionByName(side(after, zero, one)).groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return g.agg(
        F.count_if(F.col("b") > 1).alias("duplicates_left"),
        F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("rows_lost"),
        F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("rows_invented"),
    ).withColumn(
        "is_valid",
        (F.col("duplicates_left") == 0) & (F.col("rows_lost") == 0) & (F.col("rows_invented") == 0),
    )


def duplicate_risk(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Duplicate summary with its risk level."""
    from truegrain.functions import bands

    return duplicate_summary(df, cols).withColumn("risk_level", bands.risk_level(F.col("duplicate_rate_pct")))

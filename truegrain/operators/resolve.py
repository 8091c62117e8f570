"""What happens to duplicates: delete, merge, flag or archive; and how methods agree.

Groups are given by a column: the same value for all rows of a group, null for rows that are
no duplicates. Rows without a group pass through untouched and are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truegrain.functions import bands
from truegrain.functions.hashing import row_digest
from truegrain.functions.missing import missing_tests, ref
from truegrain.functions.session import by_shuffle
from truegrain.operators.duplicates import keep_order
from truegrain.operators.profile import parses_as

GROUP = "duplicate_group_id"
RULES = ("first", "last", "latest", "longest", "max", "min", "most_frequent")


def exact_groups(df: DataFrame, order: str, cols: Sequence[str] | None = None, name: str = GROUP) -> DataFrame:
    """Adds the group of each repeated row: the smallest order value in it."""
    names = list(cols) if cols else [c for c in df.columns if c != order]
    keyed = df.withColumn("_h", row_digest(df, names))
    heads = keyed.groupBy("_h").agg(F.min(ref(order)).alias(name), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return keyed.join(by_shuffle(heads), "_h", "left").select(*[ref(c) for c in df.columns], name)


def cluster_groups(df: DataFrame, id: str, clusters: DataFrame, name: str = GROUP) -> DataFrame:
    """Adds the group found by clustering (`member`, `cluster_id`)."""
    c = clusters.select(F.col("member").alias("_m"), F.col("cluster_id").alias(name))
    return df.join(by_shuffle(c), ref(id) == F.col("_m"), "left").drop("_m")


def _ranked(df: DataFrame, keep: str, order: str, ts: str | None, group: str) -> DataFrame:
    w = Window.partitionBy(ref(group)).orderBy(*keep_order(df.drop(group), keep, order, ts))
    return df.filter(ref(group).isNotNull()).withColumn("_rn", F.row_number().over(w))


def resolve_delete(df: DataFrame, order: str, keep: str = "first", ts: str | None = None, group: str = GROUP) -> DataFrame:
    """Keep one row per group by policy; first, last, latest, or best (fewest missing, then first)."""
    kept = _ranked(df, keep, order, ts, group).filter("_rn = 1").drop("_rn")
    return df.filter(ref(group).isNull()).unionByName(kept)


def keepers(df: DataFrame, order: str, keep: str = "first", ts: str | None = None, group: str = GROUP) -> DataFrame:
    """The order value of the row each group keeps."""
    return _ranked(df, keep, order, ts, group).filter("_rn = 1").select(ref(group).alias("_group"), ref(order).alias("_kept"))


def resolve_flag(df: DataFrame, order: str, keep: str = "first", ts: str | None = None, group: str = GROUP) -> DataFrame:
    """Adds is_kept; every row stays. The kept rows are found first, one per group, and joined back."""
    k = keepers(df, order, keep, ts, group)
    return df.join(by_shuffle(k), ref(group) == F.col("_group"), "left").withColumn(
        "is_kept", ref(group).isNull() | (ref(order) == F.col("_kept"))
    ).drop("_group", "_kept")


def resolve_archive(
    df: DataFrame, order: str, keep: str = "first", ts: str | None = None, group: str = GROUP
) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows archived), two filters over one flagged plan."""
    flagged = resolve_flag(df, order, keep, ts, group)
    return flagged.filter("is_kept").drop("is_kept"), flagged.filter("NOT is_kept").drop("is_kept")


def write_archive(df: DataFrame, path: str, order: str, keep: str = "first", ts: str | None = None, group: str = GROUP) -> None:
    """Write kept and archived rows in one pass, as is_kept=true and is_kept=false below the path."""
    resolve_flag(df, order, keep, ts, group).write.partitionBy("is_kept").parquet(path)


def resolve_merge(
    df: DataFrame,
    order: str,
    rules: Mapping[str, str],
    ts: str | None = None,
    group: str = GROUP,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """One merged row per group; each column survives by its rule, missing values never win.

    Rules: first, last, latest, longest, max, min, most_frequent; columns without a rule take the
    first present value. The order column becomes that of the first row.
    """
    bad = {r for r in rules.values() if r not in RULES}
    if bad:
        raise ValueError(f"unknown rules {sorted(bad)}; choose from {RULES}")
    names = [c for c in df.columns if c not in (group, order)]
    tests = missing_tests(df, names, sentinels)
    if any(r == "latest" for r in rules.values()) and ts is None:
        raise ValueError("the rule 'latest' needs a time column")
    grouped = df.filter(ref(group).isNotNull())

    def pick(c: str) -> Column:
        rule, v, ok = rules.get(c, "first"), ref(c), ~tests[c]
        if rule == "first":
            return F.min_by(v, F.when(ok, ref(order)))
        if rule == "last":
            return F.max_by(v, F.when(ok, ref(order)))
        if rule == "latest":
            return F.max_by(v, F.when(ok, F.struct(ref(ts), ref(order))))
        if rule == "longest":
            return F.max_by(v, F.when(ok, F.struct(F.length(v.cast("string")), v)))
        return (F.max if rule == "max" else F.min)(F.when(ok, v))

    frequent = [c for c in names if rules.get(c) == "most_frequent"]
    merged = grouped.groupBy(ref(group).alias(group)).agg(
        F.min(ref(order)).alias(order), *[pick(c).alias(c) for c in names if c not in frequent]
    )
    for c in frequent:
        # Counted per group and value first; equal counts go to the larger value.
        votes = grouped.filter(~tests[c]).groupBy(ref(group).alias(group), ref(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        winner = votes.groupBy(group).agg(F.max(F.struct("_n", "_v")).alias("_m")).select(group, F.col("_m._v").alias(c))
        merged = merged.join(by_shuffle(winner), group, "left")
    return df.filter(ref(group).isNull()).unionByName(merged.select(*[ref(c) for c in df.columns]))


def triage(groups: DataFrame, auto_score: float = 0.9, max_auto_size: int = 5) -> DataFrame:
    """Adds the queue of each group (columns: min_score, members, has_key_conflict)."""
    return groups.withColumn(
        "queue",
        F.when(F.col("has_key_conflict") | (F.col("members") > max_auto_size), "complex")
        .when(F.col("min_score") >= auto_score, "automatic")
        .otherwise("manual_review"),
    )


def triage_sizes(groups: DataFrame, **kw) -> DataFrame:
    """Groups and rows per queue."""
    return triage(groups, **kw).groupBy("queue").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("members").alias("rows")
    )


def validate_resolution(
    before: DataFrame, kept: DataFrame, archived: DataFrame, key: Sequence[str], sentinels: Iterable[str] = ()
) -> DataFrame:
    """Rows balance, the key is unique among kept rows, and the share of missing cells did not rise."""
    from truegrain.operators.keys import key_violation_summary
    from truegrain.operators.profile import overall_completeness

    cols = [c for c in kept.columns if c in set(before.columns)]
    sentinels = list(sentinels)
    shape = overall_completeness(before, cols, sentinels).select(F.struct("total_rows", "missing_density").alias("s")).scalar()
    gone = archived.agg(F.count(F.lit(1)).alias("c")).scalar()
    surplus = key_violation_summary(kept, key, sentinels).select("surplus_rows").scalar()
    out = overall_completeness(kept, cols, sentinels).select(
        shape["total_rows"].alias("rows_before"),
        F.col("total_rows").alias("rows_kept"),
        gone.alias("rows_archived"),
        surplus.alias("key_surplus"),
        shape["missing_density"].alias("missing_before"),
        F.col("missing_density").alias("missing_after"),
    )
    return out.select(
        "*",
        (F.col("rows_kept") + F.col("rows_archived") == F.col("rows_before")).alias("rows_balance"),
        (F.col("key_surplus") == 0).alias("key_unique"),
        (F.col("missing_after") <= F.col("missing_before")).alias("missing_not_worse"),
    )


def method_hits(exact: DataFrame, fuzzy: DataFrame, key: DataFrame) -> DataFrame:
    """One row per row id found by any method (each given as a frame with `row_id`)."""
    tagged = None
    for name, ids in (("exact", exact), ("fuzzy", fuzzy), ("key", key)):
        part = ids.select("row_id", *[F.lit(m == name).alias(f"by_{m}") for m in ("exact", "fuzzy", "key")])
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("row_id").agg(*[F.max(f"by_{m}").alias(f"by_{m}") for m in ("exact", "fuzzy", "key")])


def method_overlap(exact: DataFrame, fuzzy: DataFrame, key: DataFrame) -> DataFrame:
    """Rows per combination of methods that found them, and how many methods agree."""
    flags = [F.col(f"by_{m}") for m in ("exact", "fuzzy", "key")]
    level = flags[0].cast("int") + flags[1].cast("int") + flags[2].cast("int")
    return (
        method_hits(exact, fuzzy, key)
        .groupBy("by_exact", "by_fuzzy", "by_key")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("agreement", level.cast("bigint"))
    )


def unified_duplicates(df: DataFrame, exact: DataFrame, fuzzy: DataFrame, key: DataFrame) -> DataFrame:
    """One row: rows found by each method and by any, their share, and the overall status."""
    total = df.agg(F.count(F.lit(1)).alias("c")).scalar()
    counts = method_hits(exact, fuzzy, key).agg(
        F.count(F.lit(1)).alias("rows_found"),
        *[F.count_if(f"by_{m}").alias(f"{m}_rows") for m in ("exact", "fuzzy", "key")],
    )
    out = counts.select(total.alias("total_rows"), "*")
    rate = F.coalesce(
        F.try_divide(F.lit(100.0) * F.col("rows_found").cast("double"), F.col("total_rows").cast("double")), F.lit(0.0)
    )
    return out.withColumn("duplicate_rate_pct", rate).withColumn(
        "status", bands.duplicate_status(F.col("duplicate_rate_pct"))
    )


def issue_log(
    df: DataFrame,
    index: str,
    cols: Sequence[str] | None = None,
    critical_cols: Sequence[str] = (),
    expected: Mapping[str, str] | None = None,
    duplicate_cols: Sequence[str] | None = None,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """One row per finding: position, column, kind of issue, severity and proposed correction."""
    names = list(cols) if cols else [c for c in df.columns if c != index]
    tests = missing_tests(df, names, sentinels)

    def issue(test: Column, column: str, kind: str, severity: str, correction: str) -> Column:
        parts = {"column_name": column, "issue_type": kind, "severity": severity, "correction": correction}
        return F.when(test, F.struct(*[F.lit(v).alias(k) for k, v in parts.items()]))

    found = [
        issue(t, c, "missing", "high" if c in critical_cols else "medium", "recover" if c in critical_cols else "impute")
        for c, t in tests.items()
    ]
    for c, kind in (expected or {}).items():
        t = tests.get(c, missing_tests(df, [c], sentinels)[c])
        found.append(issue(~t & ~parses_as(ref(c), kind), c, "invalid_type", "medium", "convert_or_clear"))
    cells = df.select(
        ref(index).alias("row_index"), F.inline(F.filter(F.array(*found), lambda x: x.isNotNull()))
    )
    groups = exact_groups(df, index, duplicate_cols or names)
    copies = groups.filter(F.col(GROUP).isNotNull() & (F.col(GROUP) != ref(index))).select(
        ref(index).alias("row_index"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit("duplicate").alias("issue_type"),
        F.lit("medium").alias("severity"),
        F.lit("remove").alias("correction"),
    )
    return cells.unionByName(copies)


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues found and issues with an automatic correction, per kind."""
    return issues.groupBy("issue_type").agg(
        F.count(F.lit(1)).alias("issues_found"),
        F.count_if(F.col("correction").isin("impute", "remove")).alias("issues_corrected"),
    )

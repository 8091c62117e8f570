"""How missing values of different columns depend on each other and on observed values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegrain.functions.hashing import canonical
from truegrain.functions.session import materialised
from truegrain.functions.missing import missing_tests, ref

PAIRS_PER_PASS = 2000


def missing_correlation(
    df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()
) -> DataFrame:
    """Per column pair (a before b): joint missing count, phi, P(b missing | a missing) and back.

    One aggregate counts all pairs; a table of n columns has n(n-1)/2 counters per task, whose
    number depends on the width of the table only.
    """
    tests = missing_tests(df, cols, sentinels)
    names = list(tests)
    flags = df.select(*[t.alias(f"_m{i}") for i, t in enumerate(tests.values())])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    chunks = [pairs[k : k + PAIRS_PER_PASS] for k in range(0, len(pairs), PAIRS_PER_PASS)]
    out = None
    for chunk in chunks:
        row = flags.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(f"_m{i}").alias(f"c{i}") for i in sorted({i for p in chunk for i in p})],
            F.array(*[F.count_if(F.col(f"_m{i}") & F.col(f"_m{j}")) for i, j in chunk]).alias("both"),
        )
        part = row.select(
            "rows",
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(names[i]).alias("column_a"),
                            F.lit(names[j]).alias("column_b"),
                            F.col(f"c{i}").alias("missing_a"),
                            F.col(f"c{j}").alias("missing_b"),
                            F.col("both")[k].alias("missing_both"),
                        )
                        for k, (i, j) in enumerate(chunk)
                    ]
                )
            ),
        )
        out = part if out is None else out.unionByName(part)
    n, a, b, ab = (F.col(c).cast("double") for c in ("rows", "missing_a", "missing_b", "missing_both"))
    return out.select(
        "column_a",
        "column_b",
        "missing_both",
        F.try_divide(n * ab - a * b, F.sqrt(a * (n - a) * b * (n - b))).alias("phi"),
        F.try_divide(ab, a).alias("p_b_given_a"),
        F.try_divide(ab, b).alias("p_a_given_b"),
    )


def sparse_column_groups(
    df: DataFrame, phi: float = 0.7, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()
) -> DataFrame:
    """Columns whose gaps go together share a group; a column on its own is independent.

    The graph has one node per column, so reachability is closed inside one row: each round
    replaces a column's label by the smallest label among its linked columns.
    """
    tests = missing_tests(df, cols, sentinels)
    names = sorted(tests)
    corr = missing_correlation(df, names, sentinels)
    linked = corr.filter(F.col("phi") >= phi).agg(
        F.collect_set(F.array("column_a", "column_b")).alias("links")
    )
    labels = F.transform(F.array(*[F.lit(c) for c in names]), lambda c: F.struct(c.alias("c"), c.alias("g")))
    out = linked.select("links", labels.alias("labels"))
    rounds = max(1, len(names) - 1)
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        F.col("labels"),
        lambda acc, _: F.transform(
            acc,
            lambda x: F.struct(
                x["c"].alias("c"),
                F.array_min(
                    F.transform(
                        F.filter(
                            acc,
                            lambda y: (y["c"] == x["c"])
                            | F.array_contains(F.col("links"), F.array(x["c"], y["c"]))
                            | F.array_contains(F.col("links"), F.array(y["c"], x["c"])),
                        ),
                        lambda y: y["g"],
                    )
                ).alias("g"),
            ),
        ),
    )
    per = out.select(F.inline(step)).select(F.col("c").alias("column_name"), F.col("g").alias("column_group"))
    size = per.groupBy("column_group").agg(F.count(F.lit(1)).alias("group_size"))
    return per.join(size, "column_group").select(
        "column_name",
        "column_group",
        "group_size",
        F.when(F.col("group_size") > 1, "correlated").otherwise("independent").alias("kind"),
    )


def missing_mechanism(
    df: DataFrame,
    target: str,
    drivers: Sequence[str] | None = None,
    numeric_z: float = 1.96,
    chi_z: float = 1.96,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Does the gap in `target` depend on an observed column?

    Numeric drivers: Welch t of the driver between rows with and without the target.
    Other drivers: chi-square of the contingency table, judged by its normal approximation
    sqrt(2*chi2) - sqrt(2*dof - 1). A significant driver means MAR; none means consistent with
    MCAR. MNAR cannot be tested from observed values.
    """
    tests = missing_tests(df, None, sentinels)
    types = {f.name: f.dataType for f in df.schema.fields}
    drivers = [d for d in (drivers or df.columns) if d != target]
    gone = tests[target]
    numeric = [d for d in drivers if isinstance(types[d], T.NumericType)]
    other = [d for d in drivers if d not in numeric]
    parts = []
    if numeric:
        sums = []
        for i, d in enumerate(numeric):
            for side, test in (("m", gone), ("p", ~gone)):
                v = F.when(test & ~tests[d], ref(d).cast("double"))
                sums += [
                    F.count(v).alias(f"n_{side}{i}"),
                    F.avg(v).alias(f"a_{side}{i}"),
                    F.var_samp(v).alias(f"v_{side}{i}"),
                ]
        row = df.agg(*sums)
        cells = []
        for i, d in enumerate(numeric):
            se = F.sqrt(F.col(f"v_m{i}") / F.col(f"n_m{i}") + F.col(f"v_p{i}") / F.col(f"n_p{i}"))
            se = F.when((F.col(f"n_m{i}") > 1) & (F.col(f"n_p{i}") > 1), se)
            cells.append(
                F.struct(
                    F.lit(d).alias("driver"),
                    F.lit("welch_t").alias("test"),
                    F.try_divide(F.col(f"a_m{i}") - F.col(f"a_p{i}"), se).alias("statistic"),
                )
            )
        stat = row.select(F.inline(F.array(*cells)))
        parts.append(stat.withColumn("significant", F.coalesce(F.abs("statistic") > numeric_z, F.lit(False))))
    if other:
        # all contingency tables in one pass: a row per driver and value, merged before they are shuffled
        cells = [F.struct(F.lit(i).alias("i"), F.when(~tests[d], F.to_json(F.struct(canonical(ref(d), types[d]).alias("v")))).alias("v")) for i, d in enumerate(other)]
        counted = df.select(gone.alias("gone"), F.inline(F.array(*cells))).filter("v is not null")
        table = materialised(counted.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("m")))
        whole = table.groupBy("i").agg(F.sum("n").alias("all_n"), F.sum("m").alias("all_m"), F.count(F.lit(1)).alias("k"))
        expected = F.col("n") * F.col("all_m") / F.col("all_n")
        rest = F.col("n") * (F.col("all_n") - F.col("all_m")) / F.col("all_n")
        diff = F.col("m") - expected
        per = table.join(whole, "i").groupBy("i", "k").agg(F.sum(F.try_divide(diff * diff, expected) + F.try_divide(diff * diff, rest)).alias("statistic"))
        # a driver without any value keeps its row
        every = df.sparkSession.createDataFrame([(i, d) for i, d in enumerate(other)], "i int, driver string").join(per, "i", "left")
        dof = F.greatest(F.coalesce("k", F.lit(0)) - 1, F.lit(1))
        over = F.sqrt(2 * F.col("statistic")) - F.sqrt(2.0 * dof - 1) > chi_z
        parts.append(every.select("driver", F.lit("chi_square").alias("test"), "statistic", F.coalesce(over, F.lit(False)).alias("significant")))
    if not parts:
        raise ValueError("no driver columns to test against")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mechanism_verdict(mechanism: DataFrame) -> DataFrame:
    """One row: MAR or MCAR_consistent, the significant drivers, and the note on MNAR."""
    return mechanism.agg(
        F.count_if("significant").alias("significant_drivers"),
        F.array_join(
            F.sort_array(F.collect_list(F.when(F.col("significant"), F.col("driver")))), ","
        ).alias("drivers"),
    ).select(
        F.when(F.col("significant_drivers") > 0, "MAR").otherwise("MCAR_consistent").alias("mechanism"),
        "significant_drivers",
        "drivers",
        F.lit("untestable").alias("mnar"),
    )

"""Business keys: which columns identify a row, and where they fail to."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegrain.functions import scan
from truegrain.functions.hashing import canonical, canonical_columns, cell_hashes
from truegrain.functions.missing import any_of, missing_tests, ref
from truegrain.functions.session import by_shuffle, materialised

KEY_HINT = re.compile(r"(^|_)(id|key|code|number|no|num|sku|uuid)$|(id|key|code|number)$", re.I)


def candidate_keys(df: DataFrame, cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()) -> DataFrame:
    """Per column: distinct values, missing values, whether it identifies rows, and a name hint.

    All counts are exact. The cells of all columns are counted in one long table, each value once per
    task, so no row is copied whole and columns that repeat cost little.
    """
    names = list(cols or df.columns)
    tests = missing_tests(df, names, sentinels)
    canon = canonical_columns(df, names)
    cells = [
        F.struct(F.lit(i).alias("_i"), F.when(c.isNotNull(), F.unhex(F.sha2(F.to_json(F.struct(c.alias("v"))), 256))).alias("_h"))
        for i, c in enumerate(canon)
    ]
    values = df.select(F.inline(F.array(*cells))).filter("_h is not null").distinct()
    distinct = values.groupBy("_i").agg(F.count(F.lit(1)).alias("distinct_values"))
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.array(*[F.struct(F.lit(i).alias("_c"), F.count_if(t).alias("missing_count")) for i, t in enumerate(tests.values())]).alias("_m"),
    ).select("total_rows", F.inline("_m"))
    known = counts.join(distinct, F.col("_c") == F.col("_i"), "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("_c") + 1)
    hint = F.element_at(F.array(*[F.lit(bool(KEY_HINT.search(c))) for c in names]), F.col("_c") + 1)
    is_key = (F.col("missing_count") == 0) & (F.col("distinct_values") == F.col("total_rows")) & (F.col("total_rows") > 0)
    return known.select(
        "total_rows", name.alias("column_name"), "missing_count", "distinct_values", is_key.alias("is_key"), hint.alias("name_hint")
    )


def _agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit masks of the columns in which two rows of a batch are equal, for neighbours in the order of each column.

    Only masks within no other are told, so what leaves a batch is small.
    """
    for b in batches:
        cells = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) if b.num_rows else np.zeros((0, 1), np.int64)
        seen: set[int] = set()
        for k in range(cells.shape[1]):
            order = cells[np.argsort(cells[:, k], kind="stable")]
            same = order[1:] == order[:-1]
            seen.update(np.unique((same[same[:, k]].astype(np.int64) << np.arange(cells.shape[1])).sum(1)).tolist())
        most = [m for m in seen if m and not any(m != o and m & o == m for o in seen)]
        if most:
            yield pa.RecordBatch.from_arrays([pa.array(most, pa.int64())], ["mask"])


def minimal_keys(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    max_width: int = 3,
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Minimal column sets (up to max_width) that identify every row and hold no missing value.

    Two rows that agree in some columns prove that no subset of these is a key. Such agreements are
    gathered over all rows, where they lie, from neighbours in the order of each column; they refute most
    sets. The others are tried level by level, without supersets of keys already found: all sets of a
    level in one job, in which a row is one 128-bit hash per set. At most 62 columns.
    """
    spark = df.sparkSession
    names = list(cols or df.columns)
    tests = missing_tests(df, names, sentinels)
    gaps = df.agg(*[F.count_if(t).alias(f"m{i}") for i, t in enumerate(tests.values())]).first()
    names = sorted(c for i, c in enumerate(names) if gaps[f"m{i}"] == 0)
    if len(names) > 62:
        raise ValueError(f"{len(names)} columns without gaps; choose at most 62")
    found: list[tuple[str, ...]] = []
    schema = "key_columns string, width bigint"
    if not names:
        return spark.createDataFrame([], schema)
    cells = cell_hashes(df, names)
    lanes = materialised(df.select(*[c.alias(f"{x}{i}") for i, pair in enumerate(cells) for x, c in zip("ab", pair)]))
    masks = lanes.select(*[f"a{i}" for i in range(len(names))]).mapInArrow(_agreements, "mask long").distinct()
    # at most as many as there are sets of columns, and few in practice
    agreed = [r.mask for r in masks.collect()]
    bit = {c: 1 << i for i, c in enumerate(names)}
    for width in range(1, max_width + 1):
        sets = [s for s in combinations(names, width) if not any(set(k) <= set(s) for k in found)]
        left = [s for s in sets if not any((m := sum(bit[c] for c in s)) & a == m for a in agreed)]
        found += _unique_sets(lanes, [[names.index(c) for c in s] for s in left], left)
    return spark.createDataFrame([(",".join(k), len(k)) for k in found], schema)


def _unique_sets(lanes: DataFrame, places: Sequence[Sequence[int]], sets: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The sets under which no two rows are equal: one job for all of them."""
    if not sets:
        return []

    def of(x: str, some: Sequence[int]) -> Column:
        out = F.col(f"{x}{some[0]}")
        for i in some[1:]:
            out = out.bitwiseXOR(F.col(f"{x}{i}"))
        return out

    named = [F.struct(F.lit(k).alias("s"), of("a", some).alias("x"), of("b", some).alias("y")) for k, some in enumerate(places)]
    rows = lanes.select(F.inline(F.array(*named))).groupBy("s", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    repeated = {r.s for r in rows.filter("n > 1").select("s").distinct().collect()}
    return [s for k, s in enumerate(sets) if k not in repeated]


def key_violations(df: DataFrame, key: Sequence[str], sentinels: Iterable[str] = ()) -> DataFrame:
    """Key values that occur more than once. Rows with a missing key part are reported by the summary."""
    gone = any_of(list(missing_tests(df, key, sentinels).values()))
    return (
        df.filter(~gone)
        .select(*canonical_columns(df, key))
        .groupBy(*[ref(c) for c in key])
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter("occurrences > 1")
    )


def key_violation_summary(df: DataFrame, key: Sequence[str], sentinels: Iterable[str] = ()) -> DataFrame:
    """One row: rows, rows with a missing key, repeated key values, rows under them, surplus rows."""
    gone = any_of(list(missing_tests(df, key, sentinels).values()))
    groups = (
        df.select(gone.alias("_gone"), *canonical_columns(df, key))
        .groupBy("_gone", *[ref(c) for c in key])
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    bad = ~F.col("_gone") & (F.col("_n") > 1)
    zero = F.lit(0).cast("bigint")
    return groups.agg(
        F.coalesce(F.sum("_n"), zero).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("_gone"), F.col("_n"))), zero).alias("missing_key_rows"),
        F.count_if(bad).alias("violating_keys"),
        F.coalesce(F.sum(F.when(bad, F.col("_n"))), zero).alias("affected_rows"),
        F.coalesce(F.sum(F.when(bad, F.col("_n") - 1)), zero).alias("surplus_rows"),
    ).select(F.lit(",".join(key)).alias("key_columns"), "*")


# Rank of the kinds of key a violation can touch.
PRIORITY = {"constraint": 1, "financial": 2, "customer": 3, "internal": 4}


def prioritise(violations: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Adds the kind of each key and its priority and severity.

    `rules` maps a regular expression over the key columns to constraint, financial, customer
    or internal; the first match counts, internal is the default.
    """
    kind = F.lit("internal")
    for pattern, label in reversed(list(rules.items())):
        if label not in PRIORITY:
            raise ValueError(f"unknown kind {label!r}; choose from {list(PRIORITY)}")
        kind = F.when(F.col("key_columns").rlike(pattern), label).otherwise(kind)
    rank = F.lit(PRIORITY["internal"])
    for label, p in PRIORITY.items():
        rank = F.when(F.col("kind") == label, p).otherwise(rank)
    out = violations.withColumn("kind", kind).withColumn("priority", rank.cast("bigint"))
    return out.withColumn(
        "severity",
        F.when(F.col("violating_keys") == 0, "none")
        .when(F.col("priority") == 1, "critical")
        .when(F.col("priority") == 2, "high")
        .when(F.col("priority") == 3, "medium")
        .otherwise("low"),
    )


def key_conflicts(
    df: DataFrame, key: Sequence[str], cols: Sequence[str] | None = None, sentinels: Iterable[str] = ()
) -> DataFrame:
    """Keys whose rows disagree, with the names of the columns in conflict.

    A column disagrees when the smallest and largest 64-bit hash of its values differ, or when
    some rows have a value and others none. Whole numbers aggregate in place, text would not.
    """
    names = list(cols) if cols else [c for c in df.columns if c not in key]
    types = {f.name: f.dataType for f in df.schema.fields}
    gone = any_of(list(missing_tests(df, key, sentinels).values()))
    hashed = df.filter(~gone).select(
        *canonical_columns(df, key),
        *[F.when(ref(c).isNotNull(), F.xxhash64(canonical(ref(c), types[c]))).alias(f"_h{i}") for i, c in enumerate(names)],
    )
    groups = hashed.groupBy(*[ref(c) for c in key]).agg(
        F.count(F.lit(1)).alias("occurrences"),
        *[F.min(f"_h{i}").alias(f"_lo{i}") for i in range(len(names))],
        *[F.max(f"_h{i}").alias(f"_hi{i}") for i in range(len(names))],
        *[F.count(f"_h{i}").alias(f"_n{i}") for i in range(len(names))],
    )
    differs = [
        F.when(
            (F.col(f"_lo{i}") != F.col(f"_hi{i}"))
            | ((F.col(f"_n{i}") > 0) & (F.col(f"_n{i}") < F.col("occurrences"))),
            F.lit(c),
        )
        for i, c in enumerate(names)
    ]
    conflicts = F.filter(F.array(*differs), lambda x: x.isNotNull())
    return (
        groups.filter("occurrences > 1")
        .select(*[ref(c) for c in key], "occurrences", conflicts.alias("conflicting_columns"))
        .filter(F.size("conflicting_columns") > 0)
    )


def temporal_duplicates(
    df: DataFrame, key: Sequence[str], ts: str, window_seconds: int, order: str, width: int | None = None
) -> DataFrame:
    """Rows that follow another row of the same key within the window; adds the row before and the gap.

    Rows are cut into segments by number in the order of key and time, so a key that holds a large share
    of the table, even within a moment, is spread evenly; the last row of a key's earlier segments
    serves the first of a segment as predecessor. Rows without a time follow none and are left out.
    """
    micros = window_seconds * 1_000_000
    if micros <= 0:
        raise ValueError("the window must be longer than zero seconds")
    kind = {f.name: f.dataType for f in df.schema.fields}[ts]
    if isinstance(kind, T.TimestampNTZType):
        t = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    else:
        t = F.unix_micros(ref(ts).cast("timestamp"))
    keys = [f"_g{i}" for i in range(len(key))]
    timed = df.filter(ref(ts).isNotNull()).withColumns({k: ref(c) for k, c in zip(keys, key)} | {"_t": t, "_o": ref(order)})
    cut = scan.segmented(timed, keys, ["_t", "_o"], width)
    carried = scan.with_carried(cut, keys, ["_t", "_o"], {"_last": F.struct("_t", "_o")})
    w = scan.inside(keys, ["_t", "_o"])
    before = F.coalesce(F.lag(F.struct("_t", "_o")).over(w), F.col("_last"))
    out = carried.withColumn("_before", before).select(
        *[ref(c) for c in df.columns], F.col("_before._o").alias("previous_row"), (F.col("_t") - F.col("_before._t")).alias("gap_micros")
    )
    return out.filter(F.col("gap_micros") <= micros)


def hierarchical_duplicates(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Children under several parents, or repeated within a parent."""
    per = df.groupBy(ref(child).alias("child"), ref(parent).alias("parent")).agg(F.count(F.lit(1)).alias("n"))
    return (
        per.groupBy("child")
        .agg(
            F.count("parent").alias("parents"),
            F.sum("n").alias("rows"),
            F.count_if(F.col("n") > 1).alias("parents_with_repeats"),
        )
        .filter("parents > 1 OR parents_with_repeats > 0")
    )


# Column name patterns of the keys usual in each business domain.
DOMAINS: dict[str, list[list[str]]] = {
    "customer": [["name", "address|nation"], ["e_?mail"], ["phone"]],
    "product": [["sku"], ["barcode"], ["name", "category|type"]],
    "transaction": [["transaction_?id|order_?key"], ["reference"]],
    "employee": [["employee_?id"], ["e_?mail"], ["ssn"]],
}


def domain_keys(columns: Sequence[str], domain: str) -> list[list[str]]:
    """Keys of a domain that the columns offer, found by name."""
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain!r}; choose from {list(DOMAINS)}")
    out = []
    for parts in DOMAINS[domain]:
        hits = [next((c for c in columns if re.search(p, c, re.I)), None) for p in parts]
        if all(hits) and len(set(hits)) == len(hits):
            out.append(hits)
    return out


def domain_violations(df: DataFrame, domain: str) -> DataFrame:
    """Violation summary of every key of the domain that the table offers."""
    keys = domain_keys(df.columns, domain)
    if not keys:
        raise ValueError(f"no {domain} key among {df.columns}")
    out = key_violation_summary(df, keys[0])
    for k in keys[1:]:
        out = out.unionByName(key_violation_summary(df, k))
    return out


def check_constraints(df: DataFrame, rules: Sequence[Mapping[str, object]], sentinels: Iterable[str] = ()) -> DataFrame:
    """Pass or fail per rule with the number of violations.

    Rules: {'name', 'kind': 'not_missing', 'column'}, {'name', 'kind': 'check', 'expr': SQL} and
    {'name', 'kind': 'unique', 'columns'}. Row rules share one aggregate. A unique rule counts surplus rows.
    """
    row_rules, parts = [], []
    for r in rules:
        if r["kind"] == "not_missing":
            c = str(r["column"])
            row_rules.append((r, missing_tests(df, [c], sentinels)[c]))
        elif r["kind"] == "check":
            row_rules.append((r, ~F.coalesce(F.expr(str(r["expr"])), F.lit(False))))
        elif r["kind"] == "unique":
            s = key_violation_summary(df, list(r["columns"]), sentinels)
            parts.append(
                s.select(F.lit(r["name"]).alias("rule"), F.lit("unique").alias("kind"), F.col("surplus_rows").alias("violations"))
            )
        else:
            raise ValueError(f"unknown kind of rule {r['kind']!r}")
    if row_rules:
        row = df.agg(*[F.count_if(test).alias(f"v{i}") for i, (_, test) in enumerate(row_rules)])
        cells = [
            F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["kind"]).alias("kind"), F.col(f"v{i}").alias("violations"))
            for i, (r, _) in enumerate(row_rules)
        ]
        parts.insert(0, row.select(F.inline(F.array(*cells))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("violations") == 0)


def split_by_key(df: DataFrame, key: Sequence[str], sentinels: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(clean rows, violating rows); rows with a missing key count as clean here."""
    bad = key_violations(df, key, sentinels).select(*[ref(c).alias(f"_b{i}") for i, c in enumerate(key)])
    types = {f.name: f.dataType for f in df.schema.fields}
    on = F.lit(True)
    for i, c in enumerate(key):
        on = on & (canonical(df[c], types[c]) == F.col(f"_b{i}"))
    bad = by_shuffle(bad)
    return df.join(bad, on, "left_anti"), df.join(bad, on, "left_semi")

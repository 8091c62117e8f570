import random

import pytest

from pyspark.sql import functions as F

from truegrain.operators import compare, duplicates, keys, resolve
from truegrain.plans import reports


def one(df):
    return df.collect()[0].asDict(recursive=True)


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows, a third of them the same."""
    rng = random.Random(1)
    data = [(i, "hot" if i % 3 == 0 else f"v{rng.randrange(1500)}", i % 7) for i in range(3000)]
    return spark.createDataFrame([(i, v, 0 if v == "hot" else n) for i, v, n in data], "rid long, v string, n int").repartition(6)


def brute(rows):
    counts = {}
    for r in rows:
        counts[(r.v, r.n)] = counts.get((r.v, r.n), 0) + 1
    return counts


def test_summary_and_counts_under_skew(skewed):
    counts = brute(skewed.collect())
    s = one(duplicates.duplicate_summary(skewed, ["v", "n"]))
    assert s["unique_rows"] == len(counts) and s["duplicate_rows"] == 3000 - len(counts)
    got = {r.rid: r.duplicate_count for r in duplicates.with_duplicate_count(skewed, ["v", "n"]).collect()}
    assert all(got[r.rid] == counts[(r.v, r.n)] for r in skewed.collect())


def test_top_duplicates_under_skew(skewed):
    top = duplicates.top_duplicates(skewed, "rid", k=1, n_idx=4).collect()[0]
    assert top.occurrences == 1000 and top.sample_rows == [0, 3, 6, 9]


@pytest.mark.parametrize("keep", ["first", "last", "best"])
def test_dedup_idempotent_and_complete(skewed, keep):
    once = duplicates.dedup(skewed, ["v", "n"], keep, "rid")
    v = one(duplicates.verify_dedup(skewed, once, ["v", "n"]))
    assert v["is_valid"]
    assert duplicates.dedup(once, ["v", "n"], keep, "rid").count() == once.count()


def test_doubling_the_input(skewed):
    a, b = (one(duplicates.duplicate_summary(x, ["v", "n"])) for x in (skewed, skewed.union(skewed)))
    assert b["total_rows"] == 2 * a["total_rows"] and b["unique_rows"] == a["unique_rows"]


def test_dedup_prunes_before_the_shuffle(skewed):
    plan = duplicates.dedup(skewed, ["v"], "first", "rid")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_nulls_and_zeros(spark):
    df = spark.createDataFrame(
        [(None, "a", 0.0), ("a", None, 0.0), (None, None, 0.0), (None, None, -0.0), (None, None, float("nan")), (None, None, float("nan"))],
        "x string, y string, d double",
    )
    assert one(duplicates.duplicate_summary(df))["unique_rows"] == 4
    assert duplicates.with_row_hash(df).select("row_hash").distinct().count() == 4


def test_microseconds_and_maps_count(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:00:00.000001', map('a', 1, 'b', 2)), "
        "(TIMESTAMP_NTZ'2024-01-01 00:00:00.000002', map('a', 1, 'b', 2)), "
        "(TIMESTAMP_NTZ'2024-01-01 00:00:00.000001', map('b', 2, 'a', 1)) AS t(ts, m)"
    )
    assert one(duplicates.duplicate_summary(df))["unique_rows"] == 2


def test_empty_input(spark):
    df = spark.createDataFrame([], "rid long, v string")
    s = one(duplicates.duplicate_summary(df))
    assert s["total_rows"] == 0 and s["duplicate_rate_pct"] == 0.0
    r = one(reports.duplicate_report(df, "rid"))
    assert r["duplicate_rows_removed"] == 0 and r["most_duplicated_records"] == []


def test_metrics_formulas(spark):
    df = spark.createDataFrame([(10, 10, 10), (10, 4, 4), (0, 0, 0)], "rows_before long, rows_after long, unique_rows long")
    got = duplicates.metrics_of(df).collect()
    assert got[0].uniqueness_score == 100.0 and got[0].duplicate_percentage == 0.0
    assert got[1].duplicate_rows_removed == 6 and got[1].quality_improvement_score == 100.0 and got[1].uniqueness_score == 97.0
    assert got[2].duplicate_percentage == 0.0 and got[2].uniqueness_score == 95.0


def test_near_miss(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (2, "c", "z"), (1, "a", "x")], "i int, s string, t string")
    got = {r.differing_column: (r.groups, r.rows) for r in duplicates.near_miss_summary(df).collect()}
    assert got == {"s": (1, 2), "t": (1, 2)}


def test_layout(spark):
    df = spark.createDataFrame([(i, i // 4) for i in range(40)], "i long, v long")
    r = one(duplicates.duplicate_layout(df, "i", ["v"], stretch=3))
    assert r["consecutive_repeats"] == 30 and r["layout"] == "clustered"


def test_minimal_keys_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i // 4, i % 4, rng.randrange(30), rng.randrange(3), None if i == 5 else i) for i in range(80)]
    df = spark.createDataFrame(data, "a int, b int, c int, d int, e int")
    from itertools import combinations

    want = []
    for w in (1, 2, 3):
        for s in combinations("abcd", w):
            if not any(set(k) <= set(s) for k in want) and len({tuple(r["abcde".index(x)] for x in s) for r in data}) == 80:
                want.append(s)
    # how rows lie in partitions says which agreements are seen, and must not change the outcome
    for parts in (1, 7, 60):
        got = {r.key_columns for r in keys.minimal_keys(df.repartition(parts)).collect()}
        assert got == {",".join(s) for s in want}
    assert keys.minimal_keys(df.select("e")).collect() == []


def test_minimal_keys_take_few_jobs_and_no_expand(spark):
    df = spark.range(500).select(*[(F.col("id") * (7 + i) % (11 + i)).alias(f"c{i:02d}") for i in range(14)], F.lit(None).cast("int").alias("gap"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("minimal keys", "")
    got = [r.key_columns for r in keys.minimal_keys(df).collect()]
    jobs = len(tracker.getJobIdsForGroup("minimal keys"))
    spark.sparkContext.setJobGroup("", "")
    rows = [tuple(r) for r in df.drop("gap").collect()]
    from itertools import combinations

    want = []
    for w in (1, 2, 3):
        for s in combinations(range(14), w):
            if not any(set(k) <= set(s) for k in want) and len({tuple(r[x] for x in s) for r in rows}) == 500:
                want.append(s)
    assert got == [",".join(f"c{x:02d}" for x in s) for s in want]
    assert jobs < 30  # 469 sets


def test_field_contribution_against_plain_counts(spark):
    rng = random.Random(2)
    data = [(rng.choice([None, 1, 2]), rng.choice(["a", None, ""]), rng.choice([0.0, -0.0, 1.5])) for _ in range(60)]
    df = spark.createDataFrame(data, "x int, y string, z double")
    got = {r.column_name: (r.distinct_values, r.rows_merged_without) for r in duplicates.field_contribution(df).collect()}
    whole = len(set(data))
    assert got == {c: (len({r[i] for r in data}), whole - len({r[:i] + r[i + 1 :] for r in data})) for i, c in enumerate("xyz")}
    assert "Expand" not in duplicates.field_contribution(df)._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in duplicates.field_contribution(df.limit(0)).collect()] == [(c, 0, None, 0) for c in "xyz"]


def test_temporal_window_edges(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 'k', TIMESTAMP_NTZ'2024-01-01 00:59:59'), (2, 'k', TIMESTAMP_NTZ'2024-01-01 01:00:09'), "
        "(3, 'k', TIMESTAMP_NTZ'2024-01-01 01:00:20'), (4, 'k', TIMESTAMP_NTZ'1969-12-31 23:59:55'), (5, 'k', TIMESTAMP_NTZ'1970-01-01 00:00:05'), "
        "(6, 'z', TIMESTAMP_NTZ'2024-01-01 01:00:00') AS t(id, k, ts)"
    )
    for width in (1, 4):
        got = {r.id: r.previous_row for r in keys.temporal_duplicates(df, ["k"], "ts", 10, "id", width).collect()}
        assert got == {2: 1, 5: 4}


def test_domain_keys():
    assert keys.domain_keys(["cust_name", "home_address", "Email", "x"], "customer") == [["cust_name", "home_address"], ["Email"]]
    with pytest.raises(ValueError, match="unknown domain"):
        keys.domain_keys(["a"], "weather")


def test_conflicts_see_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", 5), (2, "b", 1), (2, "b", 1)], "k int, s string, n int")
    got = keys.key_conflicts(df, ["k"]).collect()
    assert [(r.k, r.conflicting_columns) for r in got] == [(1, ["n"])]


def test_resolution_balances(skewed):
    g = resolve.exact_groups(skewed, "rid", ["v", "n"])
    kept, gone = resolve.resolve_archive(g, "rid", "last")
    assert kept.count() + gone.count() == 3000
    v = one(resolve.validate_resolution(skewed, kept, gone, ["v", "n"]))
    assert v["rows_balance"] and v["key_unique"] and v["missing_not_worse"]
    assert {r.rid for r in kept.filter("v = 'hot'").collect()} == {2997}
    assert resolve.resolve_delete(g, "rid", "last").count() == kept.count()


def test_archive_is_written_once(spark, skewed, tmp_path):
    g = resolve.exact_groups(skewed, "rid", ["v", "n"])
    resolve.write_archive(g, str(tmp_path / "out"), "rid")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3000 and back.filter("is_kept AND v = 'hot'").count() == 1


def test_merge_rules(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 1, '', 'ab', 5, TIMESTAMP'2024-01-01 00:00:00'), (1, 2, 'x', 'abc', 7, TIMESTAMP'2024-01-03 00:00:00'), "
        "(1, 3, 'y', 'a', 5, TIMESTAMP'2024-01-02 00:00:00'), (CAST(NULL AS INT), 4, 'z', 'q', 1, TIMESTAMP'2024-01-01 00:00:00') "
        "AS t(duplicate_group_id, rid, first_s, long_s, freq, at)"
    )
    got = resolve.resolve_merge(df, "rid", {"long_s": "longest", "freq": "most_frequent", "at": "max"}).orderBy("rid").collect()
    assert [(r.rid, r.first_s, r.long_s, r.freq) for r in got] == [(1, "x", "abc", 5), (4, "z", "q", 1)]


def test_links_do_not_multiply(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (9, "d")], "k int, v string")
    r = spark.createDataFrame([(1, "a"), (1, "z"), (2, "x"), (None, "c")], "k int, v string")
    got = sorted((x.k or 0, x.link_status) for x in compare.link_records(t, r, ["k"]).collect())
    assert got == [(0, "known"), (1, "known"), (1, "known"), (2, "changed"), (9, "new")]


def test_chain_order_does_not_matter_for_rows(skewed):
    a = reports.run_chain(skewed, "rid", ["UC1", "UC4"]).orderBy("rid").collect()
    b = reports.run_chain(skewed, "rid", ["UC4", "UC1"]).orderBy("rid").collect()
    assert a == b
    with pytest.raises(ValueError, match="unknown use cases"):
        reports.run_chain(skewed, "rid", ["UC9"])


def test_sections_under_skew(skewed):
    counts = brute(skewed.collect())
    want = {}
    for r in skewed.collect():
        s = r.rid * 5 // 3000
        w = want.setdefault(s, [0, 0])
        w[0] += 1
        w[1] += counts[(r.v, r.n)] > 1
    got = {r.section: [r.rows, r.duplicate_rows] for r in duplicates.duplicates_by_section(skewed, "rid", ["v", "n"], 5).collect()}
    assert got == want


def test_risk(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    assert one(duplicates.duplicate_risk(df))["risk_level"] == "high"


def test_field_contribution_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "i int, s string")
    got = {r.column_name: r.rows_merged_without for r in duplicates.field_contribution(df).collect()}
    assert got == {"i": 1, "s": 1}


def test_negative_zero_inside_nested_values(spark):
    df = spark.createDataFrame([([0.0], {"a": 0.0}, (1, 0.0)), ([-0.0], {"a": -0.0}, (1, -0.0)), (None, None, None)], "a array<double>, m map<string,double>, s struct<x:int,y:double>")
    assert duplicates.duplicate_summary(df, ["a", "m", "s"]).first().unique_rows == 2

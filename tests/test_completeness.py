import math

import pytest
from pyspark.sql import functions as F

from truegrain.functions import bands
from truegrain.functions.missing import is_missing
from truegrain.functions.quantiles import exact_quantiles
from truegrain.operators import patterns, profile, rows, treatment
from truegrain.plans import reports


def one(df):
    return df.collect()[0].asDict(recursive=True)


def test_missing_values(spark):
    df = spark.createDataFrame(
        [(None, None), ("", float("nan")), (" \t\r\n\x0b\f", 0.0), ("NA", -0.0), (" x ", 1.0)], "s string, d double"
    )
    types = {f.name: f.dataType for f in df.schema}
    got = df.select(
        is_missing(F.col("s"), types["s"]).alias("s"),
        is_missing(F.col("s"), types["s"], ["NA"]).alias("na"),
        is_missing(F.col("d"), types["d"]).alias("d"),
    ).collect()
    assert [r.s for r in got] == [True, True, True, False, False]
    assert [r.na for r in got] == [True, True, True, True, False]
    assert [r.d for r in got] == [True, True, False, False, False]


def test_nested_types_are_missing_when_null(spark):
    df = spark.sql("SELECT array(1) a, map('x', 1) m, CAST(NULL AS STRUCT<p: INT>) s")
    assert one(rows.flag_rows(df))["missing_value_count"] == 1


@pytest.mark.parametrize(
    "fn, values, labels",
    [
        (bands.quality_category, [95.0, 94.9, 85.0, 84.9, 70.0, 69.9], ["excellent", "good", "good", "fair", "fair", "poor"]),
        (bands.sparsity_severity, [0.81, 0.8, 0.6, 0.4, 0.2], ["critical", "high", "moderate", "low", "none"]),
        (bands.row_emptiness, [1.0, 0.9, 0.7, 0.4, 0.39], ["empty", "mostly", "substantially", "partially", "acceptable"]),
        (bands.quality_flag, [100.0, 99.9, 50.0, 49.9], ["COMPLETE", "PARTIAL", "PARTIAL", "INCOMPLETE"]),
        (bands.score_category, [90.0, 75.0, 60.0, 40.0, 39.9], ["excellent", "good", "fair", "poor", "critical"]),
        (bands.score_assessment, [90.0, 75.0, 60.0, 59.9], ["EXCELLENT", "GOOD", "FAIR", "POOR"]),
        (bands.similarity_level, [0.91, 0.9, 0.7, 0.5, 0.49], ["high", "medium", "medium", "low", "weak"]),
        (bands.similarity_bucket, [0.9, 0.8, 0.7, 0.69], ["90+", "80-90", "70-80", "<70"]),
        (bands.risk_level, [20.1, 20.0, 5.0], ["high", "medium", "low"]),
        (bands.duplicate_status, [20.1, 20.0, 5.0, 0.0], ["high", "moderate", "low", "clean"]),
        (bands.speed_class, [5000.1, 5000.0, 1000.0], ["slow", "normal", "fast"]),
    ],
)
def test_band_edges(spark, fn, values, labels):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r.b for r in df.select("i", fn(F.col("v")).alias("b")).orderBy("i").collect()] == labels


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert one(profile.overall_completeness(df))["completeness_pct"] is None
    assert profile.empty_columns(df).count() == 0
    r = one(reports.completeness_report(df))
    assert r["total_rows"] == 0 and r["sparse_columns"] == []
    assert one(profile.consistency_check(df))["buckets_cover_rows"]


def test_column_and_row_totals_agree(spark, sf):
    from truegrain.catalogue import fixtures as fx

    r = one(profile.consistency_check(fx.dirty_lineitem(spark, sf)))
    assert r["missing_totals_agree"] and r["buckets_cover_rows"] and r["row_side_missing"] > 0


def test_sparse_threshold_is_strict(spark):
    df = spark.createDataFrame([(None if i < 3 else i,) for i in range(10)], "a int")
    assert profile.sparse_columns(df, 0.3).count() == 0
    assert profile.sparse_columns(df, 0.29).count() == 1


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "`a.b` int, `c d` string")
    assert [r.missing_count for r in profile.column_completeness(df).orderBy("position").collect()] == [1, 1]
    assert rows.flag_rows(df).columns[:2] == ["a.b", "c d"]


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1000])
def test_runs_across_stretches(spark, stretch):
    empty = {0, 1, 2, 5, 9, 10, 11, 12, 13, 14, 15, 20}
    df = spark.createDataFrame([(i, None if i in empty else 1) for i in range(21)], "i long, a int")
    got = {(r.start_index, r.end_index) for r in rows.empty_sections(df, "i", ["a"], 1, stretch).collect()}
    assert got == {(0, 2), (5, 5), (9, 15), (20, 20)}
    prev = rows.with_previous(df, "i", ["i"], stretch).orderBy("i").collect()
    assert [r.prev_i for r in prev] == [None, *range(20)]
    p = one(rows.empty_row_periodicity(df, "i", ["a"], stretch=stretch))
    assert p["gaps"] == 3 and p["dominant_gap"] == 4


@pytest.mark.parametrize("width", [1, 3, 9])
def test_forward_fill_over_segments(spark, width):
    values = [None, 3, None, None, None, 7, None, None]
    df = spark.createDataFrame(
        [(g, i, v) for g in ("x", None) for i, v in enumerate(values)], "g string, i long, v int"
    )
    got = treatment.ffill(df, ["v"], "i", ["g"], width=width).orderBy("g", "i").collect()
    assert [r.v for r in got] == [None, 3, 3, 3, 3, 7, 7, 7] * 2


def test_runs_test_finds_clusters(spark):
    df = spark.createDataFrame([(i, None if i < 50 else i, None if i % 2 else i) for i in range(100)], "i long, a long, b long")
    got = {r.column_name: r.layout for r in rows.missing_runs(df, "i", ["a", "b"], stretch=9).collect()}
    assert got == {"a": "clustered", "b": "alternating"}


def test_mechanism(spark):
    df = spark.createDataFrame(
        [(i, float(i), None if i > 150 else 1, "x" if i % 2 else "y") for i in range(200)], "i long, n double, t int, c string"
    )
    got = {r.driver: r.significant for r in patterns.missing_mechanism(df, "t", ["n", "c"]).collect()}
    assert got == {"n": True, "c": False}
    assert one(patterns.mechanism_verdict(patterns.missing_mechanism(df, "t", ["n", "c"])))["mechanism"] == "MAR"


def test_column_groups_are_transitive(spark):
    data = [(None if i < 5 else i, None if i < 5 else i, None if i < 6 else i, None if i > 8 else i) for i in range(20)]
    df = spark.createDataFrame(data, "d int, a int, c int, z int")
    got = {r.column_name: r.column_group for r in patterns.sparse_column_groups(df, 0.8).collect()}
    assert got == {"a": "a", "c": "a", "d": "a", "z": "z"}


def test_types(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "2024-02-30", "2024-01-01 10:00:00"), ("-2", ".5e3", "2024-02-29", "2024-01-01T11:00:00"), ("", None, " ", "x")],
        "a string, b string, c string, d string",
    )
    got = {r.column_name: r.conforming for r in treatment.type_conformance(df, {"a": "integer", "b": "decimal", "c": "date", "d": "timestamp"}).collect()}
    assert got == {"a": 2, "b": 2, "c": 1, "d": 2}
    with pytest.raises(ValueError, match="unknown kind"):
        treatment.type_conformance(df, {"a": "colour"}).collect()


def test_mode_ties_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("b", 3.0), ("a", None), (None, None)], "s string, d double")
    got = treatment.impute(df, {"s": "mode", "d": ("constant", 9)}).collect()
    assert [r.s for r in got] == ["a", "b", "b", "a", "b"]
    assert [r.d for r in got] == [1.0, 9.0, 3.0, 9.0, 9.0]


def test_score_stays_in_range(spark):
    df = spark.createDataFrame([(None, None)] * 5, "a int, b string")
    r = one(profile.quality_score(df))
    assert r["completeness_part"] == 0.0 and r["row_part"] == 0.0 and math.isclose(r["quality_score"], 10.0)


def test_unknown_names_are_refused(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="no such columns"):
        profile.column_completeness(df, ["b"])
    with pytest.raises(ValueError, match="unknown score parts"):
        profile.quality_score(df, {"beauty": 1})


def test_long_integers_are_integers(spark):
    df = spark.createDataFrame([("9223372036854775807",), ("-1234567890123456789",), ("99999999999999999999",)], "v string")
    row = treatment.type_conformance(df, {"v": "integer"}).first()
    assert (row["present"], row["conforming"]) == (3, 2)
    assert treatment.infer_types(df.limit(2), ["v"]).first()["inferred_kind"] == "integer"


def test_quantiles_are_exact(spark):
    import random

    rng = random.Random(2)
    values = [rng.randrange(5000) for _ in range(4001)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)] + [(0, None)], "g int, v int")
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        got = {r.g: r.quantile for r in exact_quantiles(df, ["g"], "v", [q]).collect()}
        for g in range(3):
            own = sorted(v for i, v in enumerate(values) if i % 3 == g)
            assert got[g] == own[max(-(-int(q * 100) * len(own) // 100), 1) - 1]


def test_previous_row_across_gaps(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in (0, 1, 3, 20, 21, 100)], "i long, v string")
    got = [(r.i, r.prev_v) for r in rows.with_previous(df, "i", ["v"], 3).orderBy("i").collect()]
    assert got == [(0, None), (1, "v0"), (3, "v1"), (20, "v3"), (21, "v20"), (100, "v21")]

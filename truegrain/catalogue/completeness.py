"""Completeness queries (sections Q1-Q44), each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegrain.catalogue import fixtures as fx
from truegrain.catalogue.registry import query
from truegrain.operators import patterns, profile, rows, treatment
from truegrain.plans import reports

D = fx.DIRTY_CUSTOMER_SQL
L = fx.DIRTY_LINEITEM_SQL
T = fx.TEXT_ORDERS_SQL
COLS = fx.DIRTY_COLS
KIND = {"k": "i", "nm": "s", "bal": "d", "nat": "i", "seg": "s", "bonus": "d"}
L_KIND = {c: "s" if c in ("l_returnflag", "l_linestatus") else "d" if i in (4, 5, 6, 7) else "i" for i, c in enumerate(fx.LINEITEM)}


def gone(c: str, kind: str) -> str:
    extra = {"s": f" OR regexp_full_match({c}, '\\s*')", "d": f" OR isnan({c})", "i": ""}[kind]
    return f"({c} IS NULL{extra})"


def count_gone(kinds: dict[str, str]) -> str:
    return " + ".join(f"{gone(c, k)}::INT" for c, k in kinds.items())


M = count_gone(KIND)
LM = count_gone(L_KIND)
# Long form: one row per column with its missing count.
PER = f"WITH d AS ({D}), per AS (" + " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS position, '{c}' AS column_name, count(*) AS total_rows, "
    f"count(*) FILTER (WHERE {gone(c, k)}) AS missing_count FROM d"
    for i, (c, k) in enumerate(KIND.items())
) + ")"
RATIO = "missing_count::DOUBLE / total_rows::DOUBLE"
PCT = "100.0::DOUBLE * (total_rows - missing_count)::DOUBLE / total_rows::DOUBLE"
SEV = (
    f"CASE WHEN {RATIO} > 0.8 THEN 'critical' WHEN {RATIO} > 0.6 THEN 'high' WHEN {RATIO} > 0.4 THEN 'moderate' "
    f"WHEN {RATIO} > 0.2 THEN 'low' ELSE 'none' END"
)
CAT = "CASE WHEN {p} >= 95 THEN 'excellent' WHEN {p} >= 85 THEN 'good' WHEN {p} >= 70 THEN 'fair' ELSE 'poor' END"
ROW = f"WITH d AS ({D}), r AS (SELECT *, ({M})::BIGINT AS m FROM d)"
LROW = f"WITH d AS ({L}), r AS (SELECT *, ({LM})::BIGINT AS m FROM d)"
BAND = (
    "CASE WHEN m / {n}.0::DOUBLE >= 1 THEN 'empty' WHEN m / {n}.0::DOUBLE >= 0.9 THEN 'mostly' WHEN m / {n}.0::DOUBLE >= 0.7 "
    "THEN 'substantially' WHEN m / {n}.0::DOUBLE >= 0.4 THEN 'partially' ELSE 'acceptable' END"
)
SCORE = "100.0::DOUBLE * (6.0::DOUBLE - m::DOUBLE) / 6.0::DOUBLE"
FLAG = f"CASE WHEN {SCORE} >= 100 THEN 'COMPLETE' WHEN {SCORE} >= 50 THEN 'PARTIAL' ELSE 'INCOMPLETE' END"
CRITICAL = f"({gone('k', 'i')} OR {gone('nm', 's')})"

dirty = fx.dirty_customer


@query(
    "q01_profile",
    """SELECT count(*) AS total_rows, 6::BIGINT AS total_columns, count(*) * 6 AS total_cells, 2::BIGINT AS integer_columns,
    1::BIGINT AS decimal_columns, 0::BIGINT AS date_columns, 1::BIGINT AS timestamp_columns, 2::BIGINT AS string_columns
    FROM orders""",
)
def q01(spark, d):
    return profile.profile(fx.table(spark, d, "orders"))


@query("q02_column_completeness", f"{PER} SELECT *, {RATIO} AS missing_ratio, {PCT} AS completeness_pct FROM per")
def q02(spark, d):
    return profile.column_completeness(dirty(spark, d), COLS)


LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    "q02_lineitem",
    "WITH c AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER (WHERE {c} IS NULL OR trim({c}::VARCHAR) = '') AS missing_count FROM lineitem"
        for i, c in enumerate(LINEITEM)
    )
    + ") SELECT *, missing_count::DOUBLE / total_rows::DOUBLE AS missing_ratio, 100.0::DOUBLE * (total_rows - missing_count)::DOUBLE / total_rows::DOUBLE AS completeness_pct FROM c",
)
def q02b(spark, d):
    return profile.column_completeness(fx.table(spark, d, "lineitem"), list(LINEITEM))


OVER = f"""{PER}, o AS (SELECT max(total_rows) AS total_rows, 6::BIGINT AS total_columns, (max(total_rows) * 6)::BIGINT AS total_cells,
    sum(missing_count)::BIGINT AS missing_cells FROM per), p AS (SELECT *,
    100.0::DOUBLE * (total_cells - missing_cells)::DOUBLE / total_cells::DOUBLE AS completeness_pct,
    missing_cells::DOUBLE / total_cells::DOUBLE AS missing_density FROM o)"""


@query("q03_overall_completeness", f"{OVER} SELECT *, {CAT.format(p='completeness_pct')} AS category FROM p")
def q03(spark, d):
    return profile.overall_completeness(dirty(spark, d), COLS)


@query("q04_quality_category", f"{PER}, x AS (SELECT *, {RATIO} AS missing_ratio, {PCT} AS completeness_pct FROM per) "
       f"SELECT *, {CAT.format(p='completeness_pct')} AS category FROM x")
def q04(spark, d):
    return profile.with_quality_category(dirty(spark, d), cols=COLS)


NOTHING_SQL = "SELECT *, CAST(NULL AS DOUBLE) AS void, '' AS blank FROM (" + D + ") z"


@query(
    "q05_empty_columns",
    f"""WITH d AS ({NOTHING_SQL}), per AS (""" + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER (WHERE {gone(c, k)}) "
        "AS missing_count FROM d" for i, (c, k) in enumerate({**KIND, "void": "d", "blank": "s"}.items())
    ) + f""") SELECT *, {RATIO} AS missing_ratio, {PCT} AS completeness_pct FROM per WHERE missing_count = total_rows""",
)
def q05(spark, d):
    df = dirty(spark, d).select("*", F.lit(None).cast("double").alias("void"), F.lit("").alias("blank"))
    return profile.empty_columns(df, cols=COLS + ["void", "blank"])


@query("q06_sparse_columns", f"{PER} SELECT *, {RATIO} AS missing_ratio, {PCT} AS completeness_pct FROM per WHERE {RATIO} > 0.3")
def q06(spark, d):
    return profile.sparse_columns(dirty(spark, d), cols=COLS)


@query("q07_sparsity_severity", f"{PER} SELECT *, {RATIO} AS missing_ratio, {PCT} AS completeness_pct, {SEV} AS severity FROM per")
def q07(spark, d):
    return profile.sparsity_severity(dirty(spark, d), cols=COLS)


@query("q07_severity_breakdown", f'{PER} SELECT {SEV} AS severity, count(*) AS "columns" FROM per GROUP BY 1')
def q07b(spark, d):
    return profile.severity_breakdown(dirty(spark, d), cols=COLS)


@query(
    "q08_rank_sparse",
    f"""{PER} SELECT row_number() OVER (ORDER BY missing_count DESC, column_name) AS sparsity_rank, column_name, missing_count,
    {RATIO} AS missing_ratio FROM per""",
)
def q08(spark, d):
    return profile.rank_sparse(dirty(spark, d), cols=COLS)


@query("q09_row_missing_count", f"{ROW} SELECT rid, m::INT AS missing_value_count FROM r")
def q09(spark, d):
    return rows.with_missing_count(dirty(spark, d), COLS).select("rid", "missing_value_count")


@query("q10_row_completeness_score", f"{ROW} SELECT rid, {SCORE} AS completeness_score FROM r")
def q10(spark, d):
    return rows.with_completeness_score(dirty(spark, d), COLS).select("rid", "completeness_score")


@query("q11_incomplete_flag", f"{ROW} SELECT rid, {CRITICAL} AS is_incomplete FROM r")
def q11(spark, d):
    return rows.with_incomplete_flag(dirty(spark, d), ["k", "nm"]).select("rid", "is_incomplete")


@query("q12_quality_flag", f"{ROW} SELECT rid, {FLAG} AS quality_flag FROM r")
def q12(spark, d):
    return rows.with_quality_flag(dirty(spark, d), COLS).select("rid", "quality_flag")


@query(
    "q13_flag_rows",
    f"""{ROW} SELECT rid, k, nm, bal, nat, seg, bonus, {CRITICAL} AS is_incomplete, m::INT AS missing_value_count,
    {SCORE} AS completeness_score, {FLAG} AS quality_flag FROM r""",
)
def q13(spark, d):
    return rows.flag_rows(dirty(spark, d), ["k", "nm"], COLS)


@query(
    "q13_flag_lineitem",
    f"""{LROW} SELECT r.* EXCLUDE (m), m > 0 AS is_incomplete, m::INT AS missing_value_count,
    100.0::DOUBLE * (11.0::DOUBLE - m::DOUBLE) / 11.0::DOUBLE AS completeness_score,
    CASE WHEN m = 0 THEN 'COMPLETE' WHEN m <= 5 THEN 'PARTIAL' ELSE 'INCOMPLETE' END AS quality_flag FROM r""",
)
def q13b(spark, d):
    return rows.flag_rows(fx.dirty_lineitem(spark, d))


@query(
    "q14_incomplete_summary",
    f"""{ROW} SELECT count(*) AS total_rows, count(*) FILTER (WHERE {CRITICAL}) AS incomplete_rows,
    count(*) FILTER (WHERE NOT {CRITICAL}) AS complete_rows,
    100.0::DOUBLE * count(*) FILTER (WHERE {CRITICAL})::DOUBLE / count(*)::DOUBLE AS incomplete_pct FROM r""",
)
def q14(spark, d):
    return rows.incomplete_summary(dirty(spark, d), ["k", "nm"])


PEN = "CASE sev WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.75 WHEN 'moderate' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.0 END"
# Penalties are multiples of 1/4, so their sum is exact in any order.
SCORE_CTES = f"""{PER}, sv AS (SELECT *, {SEV} AS sev FROM per), o AS (SELECT max(total_rows) AS n,
    sum(missing_count)::BIGINT AS gone, sum({PEN})::DOUBLE AS pen FROM sv),
    rr AS (SELECT ({M})::BIGINT AS m FROM d), e AS (SELECT count(*) FILTER (WHERE m = 6) AS empty FROM rr),
    parts AS (SELECT 100.0::DOUBLE * (1.0::DOUBLE - gone::DOUBLE / (n * 6)::DOUBLE) AS completeness_part,
    100.0::DOUBLE * (1.0::DOUBLE - pen / 6.0::DOUBLE) AS sparsity_part,
    100.0::DOUBLE * (1.0::DOUBLE - empty::DOUBLE / n::DOUBLE) AS row_part, 100.0::DOUBLE AS pattern_part FROM o, e),
    s AS (SELECT *, (40.0::DOUBLE * completeness_part + 30.0::DOUBLE * sparsity_part + 20.0::DOUBLE * row_part
    + 10.0::DOUBLE * pattern_part) / 100.0::DOUBLE AS quality_score FROM parts)"""
ASSESS = ("CASE WHEN quality_score >= 90 THEN 'EXCELLENT' WHEN quality_score >= 75 THEN 'GOOD' "
          "WHEN quality_score >= 60 THEN 'FAIR' ELSE 'POOR' END")
SCALE = ("CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 75 THEN 'good' WHEN quality_score >= 60 "
         "THEN 'fair' WHEN quality_score >= 40 THEN 'poor' ELSE 'critical' END")


@query(
    "q15_completeness_report",
    f"""{SCORE_CTES}, inc AS (SELECT count(*) FILTER (WHERE m > 0) AS incomplete_rows FROM rr),
    names AS (SELECT string_agg(column_name, ',' ORDER BY position) AS columns_analyzed,
    string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE {RATIO} > 0.3) AS sparse_columns,
    max({PCT}) FILTER (WHERE column_name = 'nm') AS nm_completeness FROM per)
    SELECT n AS total_rows, 6::BIGINT AS total_columns, incomplete_rows,
    100.0::DOUBLE * incomplete_rows::DOUBLE / n::DOUBLE AS incomplete_percentage, columns_analyzed, sparse_columns, nm_completeness,
    quality_score AS overall_quality_score, {ASSESS} AS quality_assessment FROM o, s, inc, names""",
)
def q15(spark, d):
    r = reports.completeness_report(dirty(spark, d), COLS)
    return r.select(
        "total_rows", "total_columns", "incomplete_rows", "incomplete_percentage",
        F.array_join("columns_analyzed", ",").alias("columns_analyzed"),
        F.array_join("sparse_columns", ",").alias("sparse_columns"),
        F.col("completeness_by_column")["nm"].alias("nm_completeness"),
        "overall_quality_score", "quality_assessment",
    )


@query("q16_empty_rows", f"{ROW} SELECT rid, k, nm, bal, nat, seg, bonus FROM r WHERE m = 6")
def q16(spark, d):
    return rows.empty_rows(dirty(spark, d), COLS)


@query("q17_row_emptiness", f"{LROW} SELECT {BAND.format(n=11)} AS emptiness, count(*) AS rows FROM r GROUP BY 1")
def q17(spark, d):
    return rows.row_emptiness_distribution(fx.dirty_lineitem(spark, d))


@query("q18_missing_histogram", f"{ROW} SELECT m AS missing_values, count(*) AS rows FROM r GROUP BY 1")
def q18(spark, d):
    return rows.missing_per_row_histogram(dirty(spark, d), COLS)


@query(
    "q19_row_summary",
    f"""{LROW} SELECT count(*) AS total_rows, count(*) FILTER (WHERE m = 11) AS empty_rows, count(*) FILTER (WHERE m = 10) AS
    mostly_empty_rows, count(*) FILTER (WHERE m >= 5) AS problematic_rows,
    100.0::DOUBLE * count(*) FILTER (WHERE m >= 5)::DOUBLE / count(*)::DOUBLE AS problematic_pct FROM r""",
)
def q19(spark, d):
    return rows.row_summary(fx.dirty_lineitem(spark, d))


# rid runs 0..n-1 over customer, so it is the row position. A small stretch makes runs cross borders.
RUNS = f"""{ROW}, h AS (SELECT rid AS p, rid - row_number() OVER (ORDER BY rid) AS g FROM r WHERE m = 6),
    runs AS (SELECT min(p) AS start_index, max(p) AS end_index, count(*) AS length FROM h GROUP BY g)"""


@query("q20_empty_sections", f"{RUNS} SELECT * FROM runs WHERE length >= 2")
def q20(spark, d):
    return rows.empty_sections(dirty(spark, d), "rid", COLS, stretch=41)


@query(
    "q21_empty_periodicity",
    f"""{RUNS}, gaps AS (SELECT start_index - lag(start_index) OVER (ORDER BY start_index) AS gap FROM runs),
    c AS (SELECT gap, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY gap),
    t AS (SELECT sum(n)::BIGINT AS gaps FROM c), m AS (SELECT gap AS dominant_gap, n FROM c ORDER BY n DESC, gap LIMIT 1)
    SELECT gaps, dominant_gap, n::DOUBLE / gaps::DOUBLE AS dominant_share, n::DOUBLE / gaps::DOUBLE >= 0.8 AS is_periodic FROM t, m""",
)
def q21(spark, d):
    return rows.empty_row_periodicity(dirty(spark, d), "rid", COLS, stretch=97)


@query(
    "q22_missing_by_section",
    f"""{ROW}, t AS (SELECT count(*) AS c FROM d), x AS (SELECT rid * 10 // c AS section, m FROM r, t)
    SELECT section, count(*) AS rows, sum(m)::BIGINT AS missing_cells, count(*) FILTER (WHERE m = 6) AS empty_rows,
    sum(m)::DOUBLE / (count(*) * 6)::DOUBLE AS missing_ratio FROM x GROUP BY section""",
)
def q22(spark, d):
    return rows.missing_by_section(dirty(spark, d), "rid", COLS)


@query(
    "q23_missing_runs",
    f"WITH d AS ({D}), per AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE pf IS NULL OR f <> pf) AS runs "
        f"FROM (SELECT f, lag(f) OVER (ORDER BY rid) AS pf FROM (SELECT rid, {gone(c, k)} AS f FROM d) a) b"
        for c, k in KIND.items()
    ) + """), x AS (SELECT *, n::DOUBLE AS nn, n1::DOUBLE AS a, n::DOUBLE - n1::DOUBLE AS b FROM per),
    y AS (SELECT *, 2.0::DOUBLE * a * b AS tw FROM x), z AS (SELECT column_name, n1 AS missing_count, runs,
    tw / nn + 1.0::DOUBLE AS expected_runs,
    (runs::DOUBLE - (tw / nn + 1.0::DOUBLE)) / sqrt(tw * (tw - nn) / (nn * nn * (nn - 1.0::DOUBLE))) AS z_score FROM y)
    SELECT *, CASE WHEN z_score < -1.96 THEN 'clustered' WHEN z_score > 1.96 THEN 'alternating' ELSE 'random' END AS layout FROM z""",
)
def q23(spark, d):
    return rows.missing_runs(dirty(spark, d), "rid", COLS, stretch=500)


CORR = f"WITH d AS ({D}), f AS (SELECT " + ", ".join(f"{gone(c, k)} AS {c}" for c, k in KIND.items()) + " FROM d), co AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*)::DOUBLE AS n, count(*) FILTER (WHERE {a})::DOUBLE AS a, "
    f"count(*) FILTER (WHERE {b})::DOUBLE AS b, count(*) FILTER (WHERE {a} AND {b}) AS missing_both FROM f"
    for i, a in enumerate(COLS) for b in COLS[i + 1 :]
) + """), ph AS (SELECT column_a, column_b, missing_both, (n * missing_both::DOUBLE - a * b) / sqrt(a * (n - a) * b * (n - b)) AS phi,
    missing_both::DOUBLE / a AS p_b_given_a, missing_both::DOUBLE / b AS p_a_given_b FROM co)"""


@query("q24_missing_correlation", f"{CORR} SELECT * FROM ph")
def q24(spark, d):
    return patterns.missing_correlation(dirty(spark, d), COLS)


@query(
    "q25_sparse_column_groups",
    f"""{CORR.replace('WITH d AS', 'WITH RECURSIVE d AS', 1)}, e AS (SELECT column_a AS a, column_b AS b FROM ph WHERE phi >= 0.45 UNION SELECT column_b, column_a FROM ph WHERE phi >= 0.45),
    names AS (SELECT unnest(['k','nm','bal','nat','seg','bonus']) AS c),
    reach AS (SELECT c, c AS g FROM names UNION SELECT e.b, reach.g FROM reach JOIN e ON reach.c = e.a),
    lab AS (SELECT c AS column_name, min(g) AS column_group FROM reach GROUP BY c),
    sz AS (SELECT column_group, count(*) AS group_size FROM lab GROUP BY 1)
    SELECT column_name, lab.column_group, group_size, CASE WHEN group_size > 1 THEN 'correlated' ELSE 'independent' END AS kind
    FROM lab JOIN sz ON lab.column_group = sz.column_group""",
)
def q25(spark, d):
    return patterns.sparse_column_groups(dirty(spark, d), 0.45, COLS)


MECH = f"""WITH d AS ({D}), s AS (SELECT ({gone('nm', 's')}) AS g, {{v}} AS x FROM d WHERE NOT {{m}}),
    n AS (SELECT avg(x) FILTER (WHERE g) AS am, avg(x) FILTER (WHERE NOT g) AS ap, var_samp(x) FILTER (WHERE g) AS vm,
    var_samp(x) FILTER (WHERE NOT g) AS vp, count(*) FILTER (WHERE g) AS nm, count(*) FILTER (WHERE NOT g) AS np FROM s)
    SELECT (am - ap) / sqrt(vm / nm + vp / np) AS st FROM n"""
_MECH_NUM = " UNION ALL ".join(
    f"SELECT '{c}' AS driver, 'welch_t' AS test, st AS statistic, coalesce(abs(st) > 1.96, false) AS significant FROM ("
    + MECH.format(v=f"{c}::DOUBLE", m=gone(c, KIND[c])) + ") q"
    for c in ("bal", "nat", "bonus")
)


@query(
    "q26_missing_mechanism",
    f"""WITH allp AS ({_MECH_NUM}), d AS ({D}), tab AS (SELECT seg AS v, count(*) AS n, count(*) FILTER (WHERE {gone('nm', 's')}) AS m
    FROM d WHERE NOT {gone('seg', 's')} GROUP BY seg), tot AS (SELECT sum(n)::DOUBLE AS n, sum(m)::DOUBLE AS m, count(*) AS k FROM tab),
    ex AS (SELECT tab.m - tab.n * tot.m / tot.n AS diff, tab.n * tot.m / tot.n AS e, tab.n * (tot.n - tot.m) / tot.n AS r FROM tab, tot),
    chi AS (SELECT sum(CASE WHEN e = 0 OR r = 0 THEN NULL ELSE diff * diff / e + diff * diff / r END) AS st FROM ex),
    u AS (SELECT driver, test, statistic, significant FROM allp UNION ALL SELECT 'seg', 'chi_square', st,
    coalesce(sqrt(2 * st) - sqrt(2.0 * greatest(k - 1, 1) - 1) > 1.96, false) FROM chi, tot)
    SELECT driver, test, round(statistic, 6) AS statistic, significant FROM u""",
)
def q26(spark, d):
    out = patterns.missing_mechanism(dirty(spark, d), "nm", ["bal", "nat", "bonus", "seg"])
    return out.withColumn("statistic", F.round("statistic", 6))


@query("q27_quality_score", f"{SCORE_CTES} SELECT *, {SCALE} AS category, {ASSESS} AS assessment FROM s")
def q27(spark, d):
    return profile.quality_score(dirty(spark, d), cols=COLS)


INT_RE = "^[+-]?[0-9]+$"
DEC_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_RE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
IS_INT = f"(regexp_matches(key_text, '{INT_RE}') AND TRY_CAST(key_text AS BIGINT) IS NOT NULL)"
IS_DEC = f"regexp_matches(price_text, '{DEC_RE}')"
IS_DATE = f"(regexp_matches(date_text, '{DATE_RE}') AND TRY_CAST(date_text AS DATE) IS NOT NULL)"
EXPECTED = {"key_text": "integer", "price_text": "decimal", "date_text": "date"}
CONF = f"""WITH d AS ({T}), c AS (
    SELECT 'key_text' AS column_name, 'integer' AS expected_kind, count(*) FILTER (WHERE NOT {gone('key_text', 's')}) AS present,
    count(*) FILTER (WHERE {IS_INT}) AS conforming FROM d UNION ALL
    SELECT 'price_text', 'decimal', count(*) FILTER (WHERE NOT {gone('price_text', 's')}), count(*) FILTER (WHERE {IS_DEC}) FROM d UNION ALL
    SELECT 'date_text', 'date', count(*) FILTER (WHERE NOT {gone('date_text', 's')}), count(*) FILTER (WHERE {IS_DATE}) FROM d)"""


@query(
    "q28_score_category",
    f"""{ROW}, s AS (SELECT {SCORE} AS quality_score FROM r) SELECT {SCALE} AS category, {ASSESS} AS assessment, count(*) AS rows
    FROM s GROUP BY 1, 2""",
)
def q28(spark, d):
    from truegrain.functions import bands

    s = rows.with_completeness_score(dirty(spark, d), COLS)
    return s.groupBy(
        bands.score_category(F.col("completeness_score")).alias("category"),
        bands.score_assessment(F.col("completeness_score")).alias("assessment"),
    ).agg(F.count(F.lit(1)).alias("rows"))


TKIND = {c: "s" for c in ("key_text", "price_text", "date_text", "status_text", "mixed_text")}
RULE = "status_text IN ('O', 'F') AND length(mixed_text) > 5"


@query(
    "q29_three_part_score",
    f"""{CONF}, k AS (SELECT 100.0::DOUBLE * sum(conforming)::DOUBLE / sum(present)::DOUBLE AS consistency_part FROM c),
    a AS (SELECT 100.0::DOUBLE * (count(*) * 5 - sum({count_gone(TKIND)}))::DOUBLE / (count(*) * 5)::DOUBLE AS completeness_part,
    100.0::DOUBLE * count(*) FILTER (WHERE {RULE})::DOUBLE / count(*)::DOUBLE AS accuracy_part FROM d)
    SELECT completeness_part, consistency_part, accuracy_part, 0.4::DOUBLE * completeness_part + 0.3::DOUBLE * consistency_part
    + 0.3::DOUBLE * accuracy_part AS quality_score FROM k, a""",
)
def q29(spark, d):
    return profile.three_part_score(fx.text_orders(spark, d), [RULE], cols=list(TKIND), expected=EXPECTED)


@query(
    "q30_completeness_outliers",
    f"""{PER}, a AS (SELECT sum(total_rows - missing_count)::HUGEINT AS s, sum((total_rows - missing_count)::HUGEINT * (total_rows - missing_count)) AS ss
    FROM per) SELECT column_name, {PCT} AS completeness_pct,
    (6 * (total_rows - missing_count) - s)::DOUBLE / sqrt((6 * ss - s * s)::DOUBLE) AS z_score,
    abs((6 * (total_rows - missing_count) - s)::DOUBLE / sqrt((6 * ss - s * s)::DOUBLE)) > 1.2 AS is_outlier FROM per, a""",
)
def q30(spark, d):
    return profile.completeness_outliers(dirty(spark, d), z=1.2, cols=COLS)


@query(
    "q30_completeness_variance",
    f"""{PER}, a AS (SELECT sum(total_rows - missing_count)::HUGEINT AS s, sum((total_rows - missing_count)::HUGEINT * (total_rows - missing_count)) AS ss,
    max(total_rows)::DOUBLE * 6.0::DOUBLE AS cells FROM per)
    SELECT 100.0::DOUBLE * s::DOUBLE / cells AS mean_completeness_pct, 10000.0::DOUBLE * (6 * ss - s * s)::DOUBLE / (cells * cells) AS variance FROM a""",
)
def q30b(spark, d):
    return profile.completeness_variance(dirty(spark, d), cols=COLS)


@query(
    "q31_type_conformance",
    f"{CONF} SELECT *, 100.0::DOUBLE * conforming::DOUBLE / present::DOUBLE AS conformance_pct FROM c",
)
def q31(spark, d):
    return treatment.type_conformance(fx.text_orders(spark, d), EXPECTED)


def _kind_sql(c: str) -> str:
    g = gone(c, "s")
    return f"""SELECT '{c}' AS column_name, n AS present, CASE WHEN n = 0 THEN 'unknown' WHEN i >= 0.9 * n THEN 'integer' WHEN f >= 0.9 * n THEN 'decimal'
    WHEN dt >= 0.9 * n THEN 'date' WHEN tm >= 0.9 * n THEN 'timestamp' WHEN v <= 50 THEN 'categorical' ELSE 'string' END AS inferred_kind FROM (
    SELECT count(*) FILTER (WHERE NOT {g}) AS n, count(*) FILTER (WHERE NOT {g} AND regexp_matches({c}, '{INT_RE}') AND TRY_CAST({c} AS BIGINT) IS NOT NULL) AS i,
    count(*) FILTER (WHERE NOT {g} AND regexp_matches({c}, '{DEC_RE}')) AS f,
    count(*) FILTER (WHERE NOT {g} AND regexp_matches({c}, '{DATE_RE}') AND TRY_CAST({c} AS DATE) IS NOT NULL) AS dt,
    count(*) FILTER (WHERE NOT {g} AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL) AS tm,
    count(DISTINCT {c}) FILTER (WHERE NOT {g}) AS v FROM d) q"""


@query("q32_infer_types", f"WITH d AS ({T}) " + " UNION ALL ".join(_kind_sql(c) for c in TKIND))
def q32(spark, d):
    return treatment.infer_types(fx.text_orders(spark, d), list(TKIND), threshold=0.9)


@query(
    "q33_describe_columns",
    """SELECT 'c_custkey' AS column_name, 'integer' AS kind, count(c_custkey) AS present, min(c_custkey)::VARCHAR AS min_value, max(c_custkey)::VARCHAR AS max_value,
    round(avg(c_custkey), 4) AS mean, round(stddev_samp(c_custkey), 4) AS stddev, quantile_disc(c_custkey::DOUBLE, 0.25) AS q1,
    quantile_disc(c_custkey::DOUBLE, 0.5) AS median, quantile_disc(c_custkey::DOUBLE, 0.75) AS q3 FROM customer UNION ALL
    SELECT 'c_acctbal', 'decimal', count(c_acctbal), min(c_acctbal)::VARCHAR, max(c_acctbal)::VARCHAR, round(avg(c_acctbal), 4),
    round(stddev_samp(c_acctbal), 4), quantile_disc(c_acctbal, 0.25), quantile_disc(c_acctbal, 0.5), quantile_disc(c_acctbal, 0.75) FROM customer UNION ALL
    SELECT 'c_mktsegment', 'string', count(c_mktsegment), min(c_mktsegment), max(c_mktsegment), NULL, NULL, NULL, NULL, NULL FROM customer""",
)
def q33(spark, d):
    out = treatment.describe_columns(fx.table(spark, d, "customer"), ["c_custkey", "c_acctbal", "c_mktsegment"])
    return out.drop("distinct_estimate").withColumns(
        {"mean": F.round("mean", 4), "stddev": F.round("stddev", 4)}
    )


IMPORTANCE = {"k": "high", "nm": "high", "bal": "medium", "nat": "low", "seg": "medium", "bonus": "low"}
_IMP = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in IMPORTANCE.items()) + " END"


@query(
    "q34_criticality_matrix",
    f"""{PER}, x AS (SELECT column_name, {_IMP} AS importance, {CAT.format(p='(' + PCT + ')')} AS category FROM per)
    SELECT importance, category, count(*) AS "columns", string_agg(column_name, ',' ORDER BY column_name) AS column_names FROM x GROUP BY 1, 2""",
)
def q34(spark, d):
    return profile.criticality_matrix(dirty(spark, d), IMPORTANCE, cols=COLS)


_FIELDS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {gone(c, k)} THEN '{c}' END" for c, k in KIND.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(
    "q35_problematic_rows",
    f"""{ROW}, x AS (SELECT rid AS row_index, {SCORE} AS completeness_score, {_FIELDS} AS empty_fields, {BAND.format(n=6)} AS severity FROM r WHERE m >= 3)
    SELECT *, CASE severity WHEN 'empty' THEN 'drop' WHEN 'mostly' THEN 'drop_or_recover' WHEN 'substantially' THEN 'review'
    ELSE 'keep_and_impute' END AS action FROM x ORDER BY row_index LIMIT 20""",
)
def q35(spark, d):
    return rows.problematic_rows(dirty(spark, d), "rid", COLS)


TREAT = f"""{PER}, x AS (SELECT column_name, {RATIO} AS missing_ratio, {SEV} AS severity FROM per), t AS (SELECT *,
    CASE WHEN missing_ratio = 0 THEN 'accept' WHEN severity = 'critical' AND column_name NOT IN ('k', 'seg') THEN 'remove'
    WHEN missing_ratio > 0.3 AND column_name IN ('k', 'seg') THEN 'improve_collection' WHEN column_name IN ('k', 'bal', 'nat', 'bonus')
    THEN 'impute_median' ELSE 'impute_mode' END AS treatment FROM x)"""


@query("q36_recommend_treatment", f"{TREAT} SELECT * FROM t")
def q36(spark, d):
    return treatment.recommend_treatment(dirty(spark, d), ["k", "seg"], cols=COLS)


@query(
    "q37_impute",
    f"""WITH d AS ({D}), st AS (SELECT quantile_disc(bal, 0.5) AS med, avg(bonus) AS mean FROM d),
    md AS (SELECT seg AS mode FROM d WHERE NOT {gone('seg', 's')} GROUP BY seg ORDER BY count(*) DESC, seg DESC LIMIT 1)
    SELECT rid, k, CASE WHEN {gone('nm', 's')} THEN 'unknown' ELSE nm END AS nm, coalesce(bal, med) AS bal, nat, coalesce(seg, mode) AS seg,
    round(coalesce(bonus, mean), 6) AS bonus FROM d, st, md""",
)
def q37(spark, d):
    out = treatment.impute(
        dirty(spark, d), {"bal": "median", "seg": "mode", "bonus": "mean", "nm": ("constant", "unknown")}
    )
    return out.withColumn("bonus", F.round("bonus", 6))


@query(
    "q38_forward_fill",
    f"""WITH d AS (SELECT *, rid % 7 AS grp FROM ({D}) z) SELECT rid, grp,
    last_value(bal IGNORE NULLS) OVER w AS bal, last_value(CASE WHEN {gone('nm', 's')} THEN NULL ELSE nm END IGNORE NULLS) OVER w AS nm
    FROM d WINDOW w AS (PARTITION BY grp ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def q38(spark, d):
    df = dirty(spark, d).select("rid", (F.col("rid") % 7).alias("grp"), "bal", "nm")
    return treatment.ffill(df, ["bal", "nm"], "rid", ["grp"])


@query(
    "q38_forward_fill_by_time",
    """SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN value END IGNORE NULLS) OVER w AS value
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def q38b(spark, d):
    """The whole table as one group, in the order of a time of microseconds."""
    e = fx.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("value"), F.struct("ts", "event_id").alias("at"))
    return treatment.ffill(e, ["value"], "at").drop("at")


@query(
    "q39_treat_rows",
    f"""{LROW} SELECT CASE WHEN m / 11.0::DOUBLE >= 0.9 THEN 'drop' WHEN m / 11.0::DOUBLE >= 0.4 THEN 'review' ELSE 'keep' END AS action, count(*) AS rows
    FROM r GROUP BY 1""",
)
def q39(spark, d):
    return rows.treat_rows(fx.dirty_lineitem(spark, d)).groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


@query("q40_drop_sparse_columns", f"WITH d AS ({D}) SELECT rid, k, nm FROM d")
def q40(spark, d):
    return treatment.drop_sparse_columns(dirty(spark, d), cols=COLS)


@query(
    "q41_classify_file",
    f"""{OVER}, c AS (SELECT bool_or({RATIO} > 0.3) FILTER (WHERE column_name IN ('k', 'nm')) AS has_sparse_critical FROM per),
    v AS (SELECT completeness_pct, has_sparse_critical, CASE WHEN has_sparse_critical OR completeness_pct < 70 THEN 'sparse'
    WHEN completeness_pct >= 95 THEN 'excellent' ELSE 'acceptable' END AS verdict FROM p, c)
    SELECT *, verdict = 'sparse' AS is_sparse, CASE verdict WHEN 'excellent' THEN 'yes' WHEN 'acceptable' THEN 'conditional' ELSE 'no' END AS use_as_is FROM v""",
)
def q41(spark, d):
    return profile.classify_file(dirty(spark, d), COLS, ["k", "nm"])


@query(
    "q42_recommendations",
    f"""{TREAT} SELECT CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'moderate' THEN 3 WHEN 'low' THEN 4 ELSE 5 END::BIGINT AS priority,
    column_name, column_name || ' is ' || floor(100.0::DOUBLE * missing_ratio)::BIGINT || '% missing: ' ||
    CASE treatment WHEN 'remove' THEN 'remove the column or find another source' WHEN 'improve_collection' THEN 'improve how the field is collected'
    WHEN 'impute_median' THEN 'impute with the median' ELSE 'impute with the most frequent value' END AS recommendation FROM t WHERE treatment <> 'accept'""",
)
def q42(spark, d):
    return treatment.recommendations(dirty(spark, d), ["k", "seg"], COLS)


@query(
    "q43_valid_rows",
    f"""WITH d AS ({T}) SELECT rid, key_text, price_text, date_text FROM d WHERE NOT {gone('key_text', 's')} AND NOT {gone('price_text', 's')}
    AND {IS_INT} AND {IS_DEC} AND ({gone('date_text', 's')} OR {IS_DATE})""",
)
def q43(spark, d):
    out = treatment.valid_rows(fx.text_orders(spark, d), ["key_text", "price_text"], EXPECTED)
    return out.select("rid", "key_text", "price_text", "date_text")


@query(
    "q44_consistency_check",
    f"""{LROW} SELECT (""" + " + ".join(f"count(*) FILTER (WHERE {gone(c, k)})" for c, k in L_KIND.items())
    + """) AS column_side_missing, sum(m)::BIGINT AS row_side_missing, count(*) AS bucket_rows, count(*) AS total_rows, true AS missing_totals_agree,
    true AS buckets_cover_rows FROM r""",
)
def q44(spark, d):
    return profile.consistency_check(fx.dirty_lineitem(spark, d))

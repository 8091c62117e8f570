"""Reference comparison and resolution queries (sections R1-R7, M1-M12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegrain.catalogue import fixtures as fx
from truegrain.catalogue import fuzzy as fz
from truegrain.catalogue.completeness import COLS, KIND, SCORE_CTES, gone
from truegrain.catalogue.duplicates import DUP, LN, C, summary_sql
from truegrain.catalogue.registry import query
from truegrain.functions.session import materialised
from truegrain.operators import cluster as cl
from truegrain.operators import compare as cmp
from truegrain.operators import duplicates as dup
from truegrain.operators import keys
from truegrain.operators import pairs as pr
from truegrain.operators import resolve as rs
from truegrain.plans import reports

D = fx.DIRTY_CUSTOMER_SQL
# The reference lacks `bonus`, has `area` on top, stores the balance as text and has fewer gaps.
REF = {
    "rid": "c_custkey",
    "k": "c_custkey",
    "nm": "CASE WHEN c_custkey % 10 = 2 THEN NULL ELSE c_name END",
    "bal": "CAST(c_acctbal AS STRING)",
    "nat": "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_nationkey END",
    "seg": "CASE WHEN c_custkey % 10 < 7 THEN NULL ELSE c_mktsegment END",
    "area": "c_nationkey % 5",
}
REF_SQL = fx._select(REF, "customer")
R_KIND = {"rid": "i", "k": "i", "nm": "s", "bal": "s", "nat": "i", "seg": "s", "area": "i"}
T_KIND = {"rid": "i", **KIND}
TYPES = {
    "rid": ("bigint", "bigint"), "k": ("bigint", "bigint"), "nm": ("string", "string"), "bal": ("double", "string"),
    "nat": ("int", "int"), "seg": ("string", "string"), "bonus": ("double", None), "area": (None, "int"),
}


def reference(spark, d):
    return fx._build(fx.table(spark, d, "customer"), REF)


def _per(source: str, kinds: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS c, count(*) FILTER (WHERE {gone(c, k)})::DOUBLE AS m, count(*)::DOUBLE AS n FROM {source}" for c, k in kinds.items()
    )


_TY = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {repr(t) if t else 'NULL'} AS target_type, {repr(r) if r else 'NULL'} AS reference_type" for c, (t, r) in TYPES.items()
)
_CHANGE = ("CASE WHEN target_type IS NULL THEN 'missing' WHEN reference_type IS NULL THEN 'extra' WHEN target_type <> reference_type THEN 'type_changed' "
           "ELSE 'same' END")


@query(
    "r01_schema_diff",
    f"""WITH ty AS ({_TY}) SELECT *, {_CHANGE} AS change, CASE WHEN target_type IS NULL THEN 0 ELSE (SELECT count(*) FROM customer) END AS target_rows,
    CASE WHEN reference_type IS NULL THEN 0 ELSE (SELECT count(*) FROM customer) END AS reference_rows FROM ty""",
)
def r01(spark, d):
    t, r = fx.dirty_customer(spark, d), reference(spark, d)
    rows = [df.agg(F.count(F.lit(1)).alias("c")).scalar() for df in (t, r)]
    zero = F.lit(0).cast("bigint")
    return cmp.schema_diff(t, r).select(
        "*",
        F.when(F.col("target_type").isNull(), zero).otherwise(rows[0]).alias("target_rows"),
        F.when(F.col("reference_type").isNull(), zero).otherwise(rows[1]).alias("reference_rows"),
    )


@query(
    "r02_completeness_diff",
    f"""WITH t AS ({D}), r AS ({REF_SQL}), ty AS ({_TY}), a AS ({_per('t', T_KIND)}), b AS ({_per('r', R_KIND)}),
    x AS (SELECT ty.*, {_CHANGE} AS change, a.m / a.n AS target_missing_ratio, 100.0::DOUBLE * (a.n - a.m) / a.n AS target_completeness_pct,
    b.m / b.n AS reference_missing_ratio, 100.0::DOUBLE * (b.n - b.m) / b.n AS reference_completeness_pct FROM ty LEFT JOIN a ON a.c = column_name LEFT JOIN b ON b.c = column_name)
    SELECT *, target_completeness_pct - reference_completeness_pct AS completeness_change,
    coalesce(target_missing_ratio > reference_missing_ratio, false) AS sparser_in_target FROM x""",
)
def r02(spark, d):
    return cmp.completeness_diff(fx.dirty_customer(spark, d), reference(spark, d))


_SHARED = ["k", "nm", "bal", "nat", "seg"]


def _corr(source: str, kinds: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, count(*)::DOUBLE AS n, count(*) FILTER (WHERE {gone(a, kinds[a])})::DOUBLE AS a,
    count(*) FILTER (WHERE {gone(b, kinds[b])})::DOUBLE AS b, count(*) FILTER (WHERE {gone(a, kinds[a])} AND {gone(b, kinds[b])}) AS missing_both FROM {source}"""
        for i, a in enumerate(_SHARED) for b in _SHARED[i + 1 :]
    )


_PHI = """SELECT column_a, column_b, missing_both, CASE WHEN a * (n - a) * b * (n - b) = 0 THEN NULL ELSE (n * missing_both::DOUBLE - a * b) / sqrt(a * (n - a) * b * (n - b)) END AS phi,
    missing_both::DOUBLE / a AS p_b_given_a, missing_both::DOUBLE / b AS p_a_given_b FROM"""


@query(
    "r03_new_gaps",
    f"""WITH t AS ({D}), r AS ({REF_SQL}), ct AS ({_corr('t', KIND)}), cr AS ({_corr('r', R_KIND)}), pt AS ({_PHI} ct), p2 AS ({_PHI} cr)
    SELECT * FROM pt WHERE phi >= 0.15 AND NOT EXISTS (SELECT 1 FROM p2 WHERE p2.phi >= 0.15 AND p2.column_a = pt.column_a AND p2.column_b = pt.column_b)""",
)
def r03(spark, d):
    return cmp.gap_diff(fx.dirty_customer(spark, d).select(*COLS), reference(spark, d), 0.15)


@query(
    "r04_sparsity_verdict",
    f"""WITH t AS ({D}), r AS ({REF_SQL}), a AS ({_per('t', T_KIND)}), b AS ({_per('r', R_KIND)}), x AS (SELECT (SELECT sum(m) / sum(n) FROM a) AS target_missing_ratio,
    (SELECT sum(m) / sum(n) FROM b) AS reference_missing_ratio) SELECT *, target_missing_ratio > reference_missing_ratio AS sparse_compared_to_reference,
    least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0::DOUBLE * (target_missing_ratio - reference_missing_ratio) / (1.0::DOUBLE - reference_missing_ratio))) AS relative_sparsity_score FROM x""",
)
def r04(spark, d):
    return cmp.sparsity_verdict(fx.dirty_customer(spark, d), reference(spark, d))


# The reference repeats only every hundredth customer.
BASE = f"SELECT {C} FROM customer UNION ALL SELECT {C} FROM customer WHERE c_custkey % 100 = 0"


def base(spark, d):
    c = fx.table(spark, d, "customer").select(*fx.CUSTOMER)
    return c.unionByName(c.filter("c_custkey % 100 = 0"))


@query(
    "r05_duplicate_diff",
    f"""WITH a AS ({summary_sql(f'({DUP}) z', C)}), b AS ({summary_sql(f'({BASE}) y', C)}) SELECT a.duplicate_rows > 0 AS has_duplicates,
    a.duplicate_rows AS target_duplicates, b.duplicate_rows AS reference_duplicates, a.duplicate_rate_pct AS target_rate_pct, b.duplicate_rate_pct AS reference_rate_pct,
    100.0::DOUBLE * (a.duplicate_rows - b.duplicate_rows)::DOUBLE / b.duplicate_rows::DOUBLE AS relative_increase_pct,
    a.duplicate_rate_pct > b.duplicate_rate_pct AS more_than_reference FROM a, b""",
)
def r05(spark, d):
    return cmp.duplicate_diff(fx.dup_customer(spark, d), base(spark, d), fx.CUSTOMER)


@query(
    "r06_new_duplicate_patterns",
    f"""WITH a AS (SELECT {C}, count(*) AS occurrences FROM ({DUP}) z GROUP BY {C} HAVING count(*) > 1), b AS (SELECT c_custkey FROM ({BASE}) y GROUP BY {C} HAVING count(*) > 1)
    SELECT occurrences, count(*) AS patterns FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b) GROUP BY 1""",
)
def r06(spark, d):
    new = cmp.new_duplicate_patterns(fx.dup_customer(spark, d), base(spark, d), fx.CUSTOMER)
    return new.groupBy("occurrences").agg(F.count(F.lit(1)).alias("patterns"))


_NEWS = {
    "c_custkey": "CASE WHEN c_custkey % 13 = 4 THEN c_custkey + 5000000 ELSE c_custkey END",
    "c_name": "c_name",
    "c_acctbal": "CASE WHEN c_custkey % 7 = 3 THEN c_acctbal + 1 ELSE c_acctbal END",
}


@query(
    "r07_link_records",
    """SELECT CASE WHEN c_custkey % 13 = 4 THEN c_custkey + 5000000 ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 13 = 4 THEN 'new'
    WHEN c_custkey % 7 = 3 THEN 'changed' ELSE 'known' END AS link_status FROM customer""",
)
def r07(spark, d):
    c = fx.table(spark, d, "customer")
    return cmp.link_records(fx._build(c, _NEWS), c, ["c_custkey"], ["c_name", "c_acctbal"]).select("c_custkey", "link_status")


@query(
    "r07_unmatched_reference",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 13 = 4",
)
def r07b(spark, d):
    c = fx.table(spark, d, "customer")
    return cmp.unmatched_reference(fx._build(c, _NEWS), c, ["c_custkey"]).select("c_custkey", "c_name")


@query(
    "r07_similar_across_tables",
    f"""WITH near AS ({fx.NEAR_PART_SQL}), x AS (SELECT *, lower(p_name) AS nm FROM near) SELECT a.p_partkey AS id_a, b.p_partkey AS id_b, {fz.LEV} AS similarity
    FROM x a JOIN x b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size WHERE a.p_partkey < 1000000 AND b.p_partkey >= 1000000 AND {fz.LEV} >= 0.8""",
)
def r07c(spark, d):
    df = fx.near_part(spark, d).withColumn("nm", F.lower("p_name")).withColumn("side", (F.col("p_partkey") >= 1000000).cast("int"))
    return pr.edit_pairs(df, "p_partkey", "nm", 0.8, fz.BLOCK, side="side")


# -- resolution ---------------------------------------------------------------------


def grouped(spark, d):
    return rs.exact_groups(fx.dup_customer(spark, d), "rid", fx.CUSTOMER)


GROUPED = f"""WITH z AS ({DUP}), g AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY {C}) > 1 THEN min(rid) OVER (PARTITION BY {C}) END AS duplicate_group_id FROM z)"""


@query("m01_delete_keep_first", f"{GROUPED} SELECT rid, duplicate_group_id FROM g WHERE duplicate_group_id IS NULL OR rid = duplicate_group_id")
def m01(spark, d):
    return rs.resolve_delete(grouped(spark, d), "rid").select("rid", "duplicate_group_id")


EV = """WITH g AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, props, min(event_id) OVER w AS duplicate_group_id
    FROM events WINDOW w AS (PARTITION BY user_id, event_type))"""


def event_groups(spark, d):
    e = fx.table(spark, d, "events").select(
        "event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), "props"
    )
    heads = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("duplicate_group_id"))
    return e.join(heads, ["user_id", "event_type"]).select("event_id", "ts", "user_id", "event_type", "value", "props", "duplicate_group_id")


@query(
    "m01_delete_keep_best",
    f"""{EV} SELECT event_id, duplicate_group_id FROM (SELECT *, row_number() OVER (PARTITION BY duplicate_group_id ORDER BY (value IS NULL)::INT, event_id) AS rn FROM g) q WHERE rn = 1""",
)
def m01b(spark, d):
    return rs.resolve_delete(event_groups(spark, d), "event_id", "best").select("event_id", "duplicate_group_id")


@query(
    "m02_merge",
    f"""{EV}, a AS (SELECT duplicate_group_id, min(event_id) AS event_id, max(ts) AS ts, min(user_id) AS user_id, min(event_type) AS event_type,
    arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM g GROUP BY 1), v AS (SELECT duplicate_group_id, props, count(*) AS n FROM g GROUP BY 1, 2),
    m AS (SELECT duplicate_group_id, props FROM (SELECT *, row_number() OVER (PARTITION BY duplicate_group_id ORDER BY n DESC, props DESC) AS rn FROM v) q WHERE rn = 1)
    SELECT event_id, ts, user_id, event_type, value, props FROM a JOIN m USING (duplicate_group_id)""",
)
def m02(spark, d):
    rules = {"ts": "max", "value": "first", "props": "most_frequent", "event_type": "longest"}
    return rs.resolve_merge(event_groups(spark, d), "event_id", rules, "ts").drop("duplicate_group_id")


@query(
    "m02_merge_latest",
    f"""{EV} SELECT duplicate_group_id AS event_id, arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value, arg_max(props, (ts, event_id)) AS props FROM g GROUP BY duplicate_group_id""",
)
def m02b(spark, d):
    out = rs.resolve_merge(event_groups(spark, d), "event_id", {"value": "latest", "props": "latest"}, "ts")
    return out.select("event_id", "value", "props")


@query("m03_flag", f"{GROUPED} SELECT rid, duplicate_group_id, duplicate_group_id IS NULL OR rid = duplicate_group_id AS is_kept FROM g")
def m03(spark, d):
    return rs.resolve_flag(grouped(spark, d), "rid").select("rid", "duplicate_group_id", "is_kept")


@query("m04_archive", f"{GROUPED} SELECT rid, duplicate_group_id FROM g WHERE duplicate_group_id IS NOT NULL AND rid <> duplicate_group_id")
def m04(spark, d):
    return rs.resolve_archive(grouped(spark, d), "rid")[1].select("rid", "duplicate_group_id")


def part_groups(spark, d):
    pairs = materialised(fz.near_edges(spark, d, 0.7))
    groups = cl.clusters(pairs)
    conflict = pairs.filter("a_p_retailprice <> b_p_retailprice").select(F.col("id_a").alias("member")).distinct()
    c = groups.join(conflict, F.col("cluster_id") == F.col("member"), "left")
    return c.select("cluster_id", "members", "min_score", F.col("member").isNotNull().alias("has_key_conflict"))


@query(
    "m05_triage",
    fz.component_sql(fz.PAIRS, "SELECT id_a, id_b FROM p WHERE score >= 0.7 UNION SELECT id_a, id_b FROM cp") + """, e AS (SELECT id_a, id_b, score, a_price, b_price FROM p
    WHERE score >= 0.7 UNION ALL SELECT id_a, id_b, 1.0::DOUBLE, x.p_retailprice, y.p_retailprice FROM cp JOIN near x ON x.p_partkey = id_a JOIN near y ON y.p_partkey = id_b),
    s AS (SELECT cluster_id, min(score) AS ms FROM e JOIN comp ON e.id_a = comp.member GROUP BY 1), z AS (SELECT cluster_id, count(*) AS members FROM comp GROUP BY 1),
    q AS (SELECT members, CASE WHEN z.cluster_id IN (SELECT id_a FROM e WHERE a_price <> b_price) OR members > 5 THEN 'complex' WHEN ms >= 0.9 THEN 'automatic'
    ELSE 'manual_review' END AS queue FROM z JOIN s USING (cluster_id)) SELECT queue, count(*) AS groups, sum(members)::BIGINT AS rows FROM q GROUP BY 1""",
)
def m05(spark, d):
    return rs.triage_sizes(part_groups(spark, d))


@query(
    "m06_validate_resolution",
    f"""{GROUPED}, c AS (SELECT count(*) AS rows_before, count(*) FILTER (WHERE duplicate_group_id IS NULL OR rid = duplicate_group_id) AS rows_kept FROM g)
    SELECT rows_before, rows_kept, rows_before - rows_kept AS rows_archived, 0::BIGINT AS key_surplus, 0.0::DOUBLE AS missing_before, 0.0::DOUBLE AS missing_after,
    true AS rows_balance, true AS key_unique, true AS missing_not_worse FROM c""",
)
def m06(spark, d):
    g = grouped(spark, d)
    kept, archived = rs.resolve_archive(g, "rid")
    return rs.validate_resolution(fx.dup_customer(spark, d), kept, archived, ["c_custkey"])


def part_hits(spark, d):
    near = fx.near_part(spark, d)
    pairs = fz.near_links(spark, d, 0.8)
    fuzzy = pairs.select(F.explode(F.array("id_a", "id_b")).alias("row_id")).distinct()
    exact = dup.with_duplicate_count(near, fz.BLOCK + ["p_name"]).filter("duplicate_count > 1").select(F.col("p_partkey").alias("row_id"))
    key = keys.split_by_key(near, ["p_retailprice"])[1].select(F.col("p_partkey").alias("row_id"))
    return near, exact, fuzzy, key


HITS = fz.PAIRS + """, fz AS (SELECT id_a AS r FROM p WHERE score >= 0.8 UNION SELECT id_b FROM p WHERE score >= 0.8 UNION SELECT id_a FROM cp UNION SELECT id_b FROM cp),
    ex AS (SELECT p_partkey AS r FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_type, p_size, p_name) AS n FROM near) q WHERE n > 1),
    ky AS (SELECT p_partkey AS r FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_retailprice) AS n FROM near) q WHERE n > 1),
    h AS (SELECT r IN (SELECT r FROM ex) AS by_exact, r IN (SELECT r FROM fz) AS by_fuzzy, r IN (SELECT r FROM ky) AS by_key
    FROM (SELECT r FROM fz UNION SELECT r FROM ex UNION SELECT r FROM ky) u)"""


@query(
    "m07_method_overlap",
    f"{HITS} SELECT by_exact, by_fuzzy, by_key, count(*) AS rows, (by_exact::INT + by_fuzzy::INT + by_key::INT)::BIGINT AS agreement FROM h GROUP BY 1, 2, 3",
)
def m07(spark, d):
    _, exact, fuzzy, key = part_hits(spark, d)
    return rs.method_overlap(exact, fuzzy, key)


@query(
    "m08_unified_duplicates",
    f"""{HITS}, s AS (SELECT (SELECT count(*) FROM near) AS total_rows, count(*) AS rows_found, count(*) FILTER (WHERE by_exact) AS exact_rows, count(*) FILTER (WHERE by_fuzzy) AS fuzzy_rows,
    count(*) FILTER (WHERE by_key) AS key_rows FROM h), r AS (SELECT *, 100.0::DOUBLE * rows_found::DOUBLE / total_rows::DOUBLE AS duplicate_rate_pct FROM s)
    SELECT *, CASE WHEN duplicate_rate_pct > 20 THEN 'high' WHEN duplicate_rate_pct > 5 THEN 'moderate' WHEN duplicate_rate_pct > 0 THEN 'low' ELSE 'clean' END AS status FROM r""",
)
def m08(spark, d):
    return rs.unified_duplicates(*part_hits(spark, d))


CHK = ", ".join(COLS)


@query(
    "m09_quality_report",
    f"""{SCORE_CTES}, g AS (SELECT count(*) AS c FROM d GROUP BY {CHK}), u AS (SELECT 100.0::DOUBLE * count(*)::DOUBLE / sum(c)::DOUBLE AS ratio, sum(c)::BIGINT - count(*) AS removed FROM g),
    inc AS (SELECT count(*) FILTER (WHERE m > 0) AS bad FROM rr), x AS (SELECT (quality_score + ratio) / 2.0::DOUBLE AS overall_score, quality_score AS completeness_score,
    removed AS duplicate_rows, n || ' rows; ' || bad || ' incomplete; ' || removed || ' duplicate' AS summary FROM s, u, o, inc)
    SELECT *, CASE WHEN overall_score >= 90 THEN 'EXCELLENT' WHEN overall_score >= 75 THEN 'GOOD' WHEN overall_score >= 60 THEN 'FAIR' ELSE 'POOR' END AS assessment FROM x""",
)
def m09(spark, d):
    r = reports.quality_report(fx.dirty_customer(spark, d), "rid", COLS)
    return r.select(
        "overall_score", "assessment", F.col("completeness.overall_quality_score").alias("completeness_score"),
        F.col("duplicates.duplicate_rows_removed").alias("duplicate_rows"), "summary",
    )


@query(
    "m09_quality_report_orders",
    """WITH o AS (SELECT *, (o_custkey IS NULL OR o_orderstatus IS NULL OR trim(o_orderstatus) = '' OR o_totalprice IS NULL OR o_orderdate IS NULL
    OR o_orderpriority IS NULL OR trim(o_orderpriority) = '') AS bad FROM orders), g AS (SELECT count(*) AS c FROM o GROUP BY o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority),
    u AS (SELECT sum(c)::BIGINT AS n, 100.0::DOUBLE * count(*)::DOUBLE / sum(c)::DOUBLE AS ratio, (sum(c) - count(*))::BIGINT AS removed FROM g), b AS (SELECT count(*) FILTER (WHERE bad) AS bad FROM o),
    x AS (SELECT CASE WHEN bad = 0 THEN (100.0::DOUBLE + ratio) / 2.0::DOUBLE END AS overall_score, removed AS duplicate_rows,
    n || ' rows; ' || bad || ' incomplete; ' || removed || ' duplicate' AS summary FROM u, b)
    SELECT *, CASE WHEN overall_score >= 90 THEN 'EXCELLENT' WHEN overall_score >= 75 THEN 'GOOD' WHEN overall_score >= 60 THEN 'FAIR' ELSE 'POOR' END AS assessment FROM x""",
)
def m09b(spark, d):
    r = reports.quality_report(fx.table(spark, d, "orders"), "o_orderkey")
    return r.select("overall_score", "assessment", F.col("duplicates.duplicate_rows_removed").alias("duplicate_rows"), "summary")


_M3 = "(nm IS NULL)::INT + (bal IS NULL)::INT + (nat IS NULL)::INT"


@query(
    "m10_flag_then_deduplicate",
    f"""WITH z AS ({fx.NULL_DUP_SQL}), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nm, bal, nat ORDER BY rid) AS rn FROM z) q WHERE rn = 1)
    SELECT rid, nm, bal, nat, {_M3} > 0 AS is_incomplete, ({_M3})::INT AS missing_value_count, 100.0::DOUBLE * (3.0::DOUBLE - ({_M3})::DOUBLE) / 3.0::DOUBLE AS completeness_score,
    CASE WHEN {_M3} = 0 THEN 'COMPLETE' WHEN {_M3} = 1 THEN 'PARTIAL' ELSE 'INCOMPLETE' END AS quality_flag FROM k""",
)
def m10(spark, d):
    return reports.run_chain(fx.null_dup(spark, d), "rid")


_KC = ["k", "nm", "bal"]


@query(
    "m11_issue_log",
    f"""WITH d AS ({D}), i AS (""" + " UNION ALL ".join(
        f"SELECT rid AS row_index, '{c}' AS column_name, 'missing' AS issue_type, '{'high' if c == 'k' else 'medium'}' AS severity, '{'recover' if c == 'k' else 'impute'}' AS correction FROM d WHERE {gone(c, KIND[c])}"
        for c in _KC
    ) + f""" UNION ALL SELECT rid, NULL, 'duplicate', 'medium', 'remove' FROM (SELECT rid, row_number() OVER (PARTITION BY {', '.join(_KC)} ORDER BY rid) AS rn FROM d) q WHERE rn > 1)
    SELECT * FROM i""",
)
def m11(spark, d):
    return rs.issue_log(fx.dirty_customer(spark, d), "rid", _KC, ["k"])


@query(
    "m11_issue_counts",
    f"""WITH d AS ({fx.TEXT_ORDERS_SQL}), v AS (SELECT 'missing' AS issue_type, (count(*) FILTER (WHERE {gone('price_text', 's')}) + count(*) FILTER (WHERE {gone('date_text', 's')})) AS issues_found,
    count(*) FILTER (WHERE {gone('date_text', 's')}) AS issues_corrected FROM d UNION ALL SELECT 'invalid_type', count(*) FILTER (WHERE price_text = 'n/a'), 0 FROM d UNION ALL
    SELECT 'duplicate', count(*) - (SELECT count(*) FROM (SELECT DISTINCT price_text, date_text FROM d) y), count(*) - (SELECT count(*) FROM (SELECT DISTINCT price_text, date_text FROM d) y) FROM d)
    SELECT * FROM v""",
)
def m11b(spark, d):
    log = rs.issue_log(fx.text_orders(spark, d), "rid", ["price_text", "date_text"], ["price_text"], {"price_text": "decimal"})
    return rs.issue_counts(log)


@query(
    "m12_duplicate_risk",
    f"""WITH s AS ({summary_sql('lineitem', 'l_orderkey, l_linenumber')}) SELECT *, CASE WHEN duplicate_rate_pct > 20 THEN 'high' WHEN duplicate_rate_pct > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM s""",
)
def m12(spark, d):
    return dup.duplicate_risk(fx.table(spark, d, "lineitem"), LN)

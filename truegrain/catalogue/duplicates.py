"""Exact-duplicate and key queries (sections D1-D20, K1-K10)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from truegrain.catalogue import fixtures as fx
from truegrain.catalogue.registry import query
from truegrain.operators import duplicates as dup
from truegrain.operators import keys
from truegrain.plans import reports

C = ", ".join(fx.CUSTOMER)
DUP = fx.DUP_CUSTOMER_SQL
NUL = fx.NULL_DUP_SQL
LN = ["l_orderkey", "l_linenumber"]


def summary_sql(source: str, cols: str) -> str:
    return f"""WITH g AS (SELECT count(*) AS n FROM {source} GROUP BY {cols}), s AS (SELECT sum(n)::BIGINT AS total_rows,
    count(*) AS unique_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups FROM g) SELECT total_rows, unique_rows,
    total_rows - unique_rows AS duplicate_rows,
    100.0::DOUBLE * (total_rows - unique_rows)::DOUBLE / total_rows::DOUBLE AS duplicate_rate_pct, duplicate_groups FROM s"""


@query("d01_duplicate_summary", summary_sql("lineitem", "l_orderkey, l_linenumber"))
def d01(spark, d):
    return dup.duplicate_summary(fx.table(spark, d, "lineitem"), LN)


@query("d01_duplicate_texts", summary_sql("documents", "text"))
def d01b(spark, d):
    return dup.duplicate_summary(fx.table(spark, d, "documents"), ["text"])


@query(
    "d02_row_hash",
    f"""SELECT rid, count(*) OVER (PARTITION BY {C}) AS rows_with_hash, length(sha256('x')) AS hash_length FROM ({DUP}) z""",
)
def d02(spark, d):
    h = dup.with_row_hash(fx.dup_customer(spark, d), fx.CUSTOMER)
    n = h.groupBy("row_hash").agg(F.count(F.lit(1)).alias("rows_with_hash"))
    return h.join(n, "row_hash").select("rid", "rows_with_hash", F.length("row_hash").cast("bigint").alias("hash_length"))


@query("d02_nested_row_hash", "SELECT vec_id, count(*) OVER (PARTITION BY embedding) AS rows_with_hash FROM embeddings")
def d02b(spark, d):
    h = dup.with_row_hash(fx.table(spark, d, "embeddings"), ["embedding"])
    n = h.groupBy("row_hash").agg(F.count(F.lit(1)).alias("rows_with_hash"))
    return h.join(n, "row_hash").select("vec_id", "rows_with_hash")


@query("d03_duplicate_groups", f"SELECT {C}, count(*) AS occurrences FROM ({DUP}) z GROUP BY {C} HAVING count(*) > 1")
def d03(spark, d):
    return dup.duplicate_groups(fx.dup_customer(spark, d), fx.CUSTOMER)


@query(
    "d04_duplicate_count",
    "SELECT doc_id, count(*) OVER (PARTITION BY text) AS duplicate_count FROM documents",
)
def d04(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    return dup.with_duplicate_count(docs, ["text"]).select("doc_id", "duplicate_count")


def dedup_sql(order: str) -> str:
    return f"SELECT {C}, rid FROM (SELECT *, row_number() OVER (PARTITION BY {C} ORDER BY {order}) AS rn FROM ({DUP}) z) y WHERE rn = 1"


@query("d05_dedup_first", dedup_sql("rid"))
def d05(spark, d):
    return dup.dedup(fx.dup_customer(spark, d), fx.CUSTOMER, "first", "rid")


@query("d05_dedup_last", dedup_sql("rid DESC"))
def d05b(spark, d):
    return dup.dedup(fx.dup_customer(spark, d), fx.CUSTOMER, "last", "rid")


@query(
    "d05_dedup_latest",
    """SELECT event_id, ts, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
    ORDER BY ts DESC, event_id) AS rn FROM events) z WHERE rn = 1""",
)
def d05c(spark, d):
    e = fx.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return dup.dedup(e, ["user_id", "event_type"], "latest", "event_id", "ts")


@query(
    "d05_dedup_lineitem",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey * 10000000 + l_suppkey) AS rn FROM lineitem) z WHERE rn = 1""",
)
def d05d(spark, d):
    lines = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    placed = lines.withColumn("place", F.col("l_partkey") * 10000000 + F.col("l_suppkey"))
    return dup.dedup(placed, ["l_orderkey", "l_linenumber"], "first", "place").drop("place")


@query("d06_distinct_rows", f"SELECT DISTINCT {C} FROM ({DUP}) z")
def d06(spark, d):
    return dup.distinct_rows(fx.dup_customer(spark, d).select(*fx.CUSTOMER))


@query("d07_null_rows_one_group", f"SELECT nm, bal, nat, count(*) AS occurrences FROM ({NUL}) z GROUP BY ALL HAVING count(*) > 1")
def d07(spark, d):
    return dup.duplicate_groups(fx.null_dup(spark, d), ["nm", "bal", "nat"])


@query("d07_null_rows_summary", summary_sql(f"({NUL}) z", "nm, bal, nat"))
def d07b(spark, d):
    return dup.duplicate_summary(fx.null_dup(spark, d), ["nm", "bal", "nat"])


@query(
    "d08_top_duplicates",
    """SELECT count(*) AS occurrences, array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 5), ',') AS sample_rows FROM documents GROUP BY text
    HAVING count(*) > 1 ORDER BY count(*) DESC, min(doc_id) LIMIT 10""",
)
def d08(spark, d):
    top = dup.top_duplicates(fx.table(spark, d, "documents"), "doc_id", ["text"])
    return top.select("occurrences", F.array_join(F.col("sample_rows").cast("array<string>"), ",").alias("sample_rows"))


@query(
    "d09_duplicate_histogram",
    "WITH g AS (SELECT count(*) AS group_size FROM lineitem GROUP BY l_orderkey, l_linenumber) "
    "SELECT group_size, count(*) AS groups FROM g WHERE group_size > 1 GROUP BY 1",
)
def d09(spark, d):
    return dup.duplicate_histogram(fx.table(spark, d, "lineitem"), LN)


@query(
    "d10_duplicate_layout",
    """WITH p AS (SELECT (status = lag(status) OVER (ORDER BY event_id)) AS same FROM (SELECT event_id, event_type AS status FROM events) z),
    c AS (SELECT count(*) FILTER (WHERE same) AS k FROM p), u AS (SELECT count(*) - count(DISTINCT event_type) AS s FROM events)
    SELECT s AS duplicate_rows, k AS consecutive_repeats, s - k AS scattered_repeats,
    CASE WHEN s = 0 THEN 'none' WHEN k >= 0.5 * s THEN 'clustered' ELSE 'scattered' END AS layout FROM c, u""",
)
def d10(spark, d):
    return dup.duplicate_layout(fx.table(spark, d, "events"), "event_id", ["event_type"], stretch=1000)


@query(
    "d11_duplicates_by_section",
    """WITH g AS (SELECT doc_id * 10 // (SELECT count(*) FROM documents) AS section, count(*) OVER (PARTITION BY text) AS n FROM documents)
    SELECT section, count(*) AS rows, count(*) FILTER (WHERE n > 1) AS duplicate_rows FROM g GROUP BY section""",
)
def d11(spark, d):
    return dup.duplicates_by_section(fx.table(spark, d, "documents"), "doc_id", ["text"])


P5 = ["p_name", "p_brand", "p_type", "p_size"]


@query(
    "d12_field_contribution",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM part) AS distinct_values,
    1.0::DOUBLE - (SELECT count(DISTINCT {c}) FROM part)::DOUBLE / (SELECT count(*) FROM part)::DOUBLE AS repeat_rate,
    (SELECT count(*) FROM (SELECT DISTINCT {', '.join(P5)} FROM part) a) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(x for x in P5 if x != c)}
    FROM part) b) AS rows_merged_without"""
        for c in P5
    ),
)
def d12(spark, d):
    return dup.field_contribution(fx.table(spark, d, "part"), P5)


@query(
    "d13_null_patterns",
    f"""WITH x AS (SELECT *, count(*) OVER (PARTITION BY nm, bal, nat) > 1 AS is_duplicate FROM ({NUL}) z) """
    + " UNION ALL ".join(
        f"""SELECT is_duplicate, count(*) AS rows, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
    count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / count(*)::DOUBLE AS missing_ratio FROM x GROUP BY 1""" for c in ("nm", "bal", "nat")
    ),
)
def d13(spark, d):
    return dup.null_patterns_in_duplicates(fx.null_dup(spark, d), ["nm", "bal", "nat"])


@query(
    "d14_duplicate_values",
    f"""WITH x AS (SELECT *, count(*) OVER (PARTITION BY {C}) AS n FROM ({DUP}) z), v AS (
    SELECT 'c_nationkey' AS column_name, c_nationkey::VARCHAR AS value FROM x WHERE n > 1 UNION ALL
    SELECT 'c_mktsegment', c_mktsegment FROM x WHERE n > 1), c AS (SELECT column_name, value, count(*) AS rows FROM v GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY rows DESC, value) AS value_rank FROM c)
    SELECT column_name, value, rows, value_rank::INT AS value_rank FROM r WHERE value_rank <= 5""",
)
def d14(spark, d):
    return dup.duplicate_value_profile(fx.dup_customer(spark, d), fx.CUSTOMER, ["c_nationkey", "c_mktsegment"])


@query("d15_subset_duplicates", summary_sql("(SELECT *, date_trunc('hour', ts) AS h FROM events) e", "user_id, event_type, h"))
def d15(spark, d):
    e = fx.table(spark, d, "events").withColumn("h", F.date_trunc("hour", "ts"))
    return dup.duplicate_summary(e, ["user_id", "event_type", "h"])


@query(
    "d16_near_miss",
    "WITH u AS (SELECT DISTINCT p_name, p_brand, p_type, p_size FROM part) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS differing_column, count(*) AS groups, sum(n)::BIGINT AS rows FROM (SELECT count(*) AS n FROM u GROUP BY
    {', '.join(x for x in P5 if x != c)} HAVING count(*) > 1) g HAVING count(*) > 0""" for c in P5
    ),
)
def d16(spark, d):
    return dup.near_miss_summary(fx.table(spark, d, "part"), P5)


@query(
    "d17_storage_waste",
    """WITH g AS (SELECT text, count(*) AS n, strlen(json_object('text', text)::VARCHAR) AS b FROM documents GROUP BY text),
    s AS (SELECT sum(n * b)::BIGINT AS total_bytes, sum((n - 1) * b)::BIGINT AS surplus_bytes FROM g)
    SELECT *, 100.0::DOUBLE * surplus_bytes::DOUBLE / total_bytes::DOUBLE AS waste_pct FROM s""",
)
def d17(spark, d):
    return dup.storage_waste(fx.table(spark, d, "documents"), ["text"])


METRICS = """, m AS (SELECT rows_before, rows_after, greatest(0, rows_before - rows_after) AS removed, unique_rows FROM b), s AS (SELECT *,
    removed::DOUBLE / rows_before::DOUBLE * 100.0::DOUBLE AS share FROM m) SELECT rows_before, rows_after, removed AS duplicate_rows_removed,
    share AS duplicate_percentage, share AS data_reduction_percentage, least(100.0::DOUBLE, share * 2.0::DOUBLE) AS quality_improvement_score,
    CASE WHEN rows_before = rows_after THEN 100.0::DOUBLE ELSE 95.0::DOUBLE + 5.0::DOUBLE * rows_after::DOUBLE / rows_before::DOUBLE END AS uniqueness_score,
    100.0::DOUBLE * unique_rows::DOUBLE / rows_before::DOUBLE AS distinct_ratio FROM s"""


@query(
    "d18_dedup_metrics",
    "WITH b AS (SELECT (SELECT count(*) FROM lineitem) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM "
    "lineitem) x) AS rows_after, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) y) AS unique_rows)" + METRICS,
)
def d18(spark, d):
    li = fx.table(spark, d, "lineitem")
    return dup.dedup_metrics(li, dup.dedup(li, LN, "latest", "l_partkey", "l_shipdate"), LN)


@query(
    "d19_verify_dedup",
    "SELECT 0::BIGINT AS duplicates_left, 0::BIGINT AS rows_lost, 0::BIGINT AS rows_invented, count(*) > 0 AS is_valid FROM documents",
)
def d19(spark, d):
    docs = fx.table(spark, d, "documents")
    return dup.verify_dedup(docs, dup.dedup(docs, ["text"], "first", "doc_id"), ["text"])


@query(
    "d20_duplicate_report",
    f"""WITH g AS (SELECT count(*) AS n FROM ({DUP}) z GROUP BY {C}), b AS (SELECT sum(n)::BIGINT AS rows_before, count(*) AS rows_after,
    count(*) AS unique_rows, count(*) FILTER (WHERE n > 1) AS groups, max(n) AS top FROM g), m AS (SELECT *, rows_before - rows_after AS removed FROM b),
    s AS (SELECT *, removed::DOUBLE / rows_before::DOUBLE * 100.0::DOUBLE AS share FROM m) SELECT rows_before AS total_rows_original, rows_after AS
    total_rows_processed, 5::BIGINT AS total_columns, removed AS duplicate_rows_removed, share AS duplicate_percentage, groups AS duplicate_groups,
    share AS data_reduction_percentage, least(100.0::DOUBLE, share * 2.0::DOUBLE) AS quality_improvement_score,
    95.0::DOUBLE + 5.0::DOUBLE * rows_after::DOUBLE / rows_before::DOUBLE AS uniqueness_score, top AS most_duplicated,
    (SELECT string_agg(n::VARCHAR || 'x' || c::VARCHAR, ',' ORDER BY n) FROM (SELECT n, count(*) AS c FROM g WHERE n > 1 GROUP BY n) h) AS patterns
    FROM s""",
)
def d20(spark, d):
    r = reports.duplicate_report(fx.dup_customer(spark, d), "rid", fx.CUSTOMER)
    return r.select(
        "total_rows_original", "total_rows_processed", "total_columns", "duplicate_rows_removed",
        "duplicate_percentage", "duplicate_groups", "data_reduction_percentage", "quality_improvement_score",
        "uniqueness_score",
        F.array_max(F.transform("most_duplicated_records", lambda x: x["occurrences"])).alias("most_duplicated"),
        F.array_join(
            F.transform(
                F.array_sort(F.map_entries("duplicate_patterns")),
                lambda e: F.concat(e["key"].cast("string"), F.lit("x"), e["value"].cast("string")),
            ),
            ",",
        ).alias("patterns"),
    )


# -- keys ---------------------------------------------------------------------------

_O = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "k01_candidate_keys",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
    count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) = count(*) AS is_key, {str(c.endswith('key')).lower()} AS name_hint FROM orders""" for c in _O
    ),
)
def k01(spark, d):
    return keys.candidate_keys(fx.table(spark, d, "orders"))


def minimal_sql(table: str, cols: list[str]) -> str:
    sets = [s for w in (1, 2, 3) for s in combinations(sorted(cols), w)]
    tests = " UNION ALL ".join(
        f"SELECT '{','.join(s)}' AS key_columns, {len(s)}::BIGINT AS width, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM {table}) q) = "
        f"(SELECT count(*) FROM {table}) AS u" for s in sets
    )
    return f"""WITH t AS ({tests}), k AS (SELECT * FROM t WHERE u) SELECT key_columns, width FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b
    WHERE b.width < a.width AND list_has_all(string_split(a.key_columns, ','), string_split(b.key_columns, ',')))"""


@query("k02_minimal_keys", minimal_sql("part", fx.PART))
def k02(spark, d):
    return keys.minimal_keys(fx.table(spark, d, "part").select(*fx.PART))


@query("k02_minimal_keys_turns", minimal_sql("conversations", ["conv_id", "turn", "role"]))
def k02b(spark, d):
    return keys.minimal_keys(fx.table(spark, d, "conversations"), ["conv_id", "turn", "role"])


@query(
    "k03_key_violations",
    "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def k03(spark, d):
    return keys.key_violations(fx.table(spark, d, "lineitem"), LN)


def violation_sql(source: str, key: list[str], gone: str) -> str:
    k = ", ".join(key)
    return f"""(WITH g AS (SELECT {gone} AS gone, count(*) AS n FROM {source} GROUP BY {gone}, {k}) SELECT '{','.join(key)}' AS key_columns,
    sum(n)::BIGINT AS total_rows, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS missing_key_rows,
    count(*) FILTER (WHERE NOT gone AND n > 1) AS violating_keys, coalesce(sum(n) FILTER (WHERE NOT gone AND n > 1), 0)::BIGINT AS affected_rows,
    coalesce(sum(n - 1) FILTER (WHERE NOT gone AND n > 1), 0)::BIGINT AS surplus_rows FROM g)"""


@query("k03_key_violation_summary", violation_sql(f"({NUL}) z", ["nm", "nat"], "(nm IS NULL OR nat IS NULL)"))
def k03b(spark, d):
    return keys.key_violation_summary(fx.null_dup(spark, d), ["nm", "nat"])


@query(
    "k04_prioritised_violations",
    f"""WITH v AS ({violation_sql('lineitem', LN, 'false')} UNION ALL {violation_sql('orders', ['o_custkey'], 'false')} UNION ALL
    {violation_sql('orders', ['o_totalprice'], 'false')} UNION ALL {violation_sql('part', ['p_partkey'], 'false')}),
    k AS (SELECT *, CASE WHEN key_columns LIKE 'l_orderkey%' THEN 'constraint' WHEN key_columns LIKE '%price%' THEN 'financial'
    WHEN key_columns LIKE '%cust%' THEN 'customer' ELSE 'internal' END AS kind FROM v)
    SELECT *, CASE kind WHEN 'constraint' THEN 1 WHEN 'financial' THEN 2 WHEN 'customer' THEN 3 ELSE 4 END::BIGINT AS priority,
    CASE WHEN violating_keys = 0 THEN 'none' WHEN kind = 'constraint' THEN 'critical' WHEN kind = 'financial' THEN 'high'
    WHEN kind = 'customer' THEN 'medium' ELSE 'low' END AS severity FROM k""",
)
def k04(spark, d):
    t = {n: fx.table(spark, d, n) for n in ("lineitem", "orders", "part")}
    v = (
        keys.key_violation_summary(t["lineitem"], LN)
        .unionByName(keys.key_violation_summary(t["orders"], ["o_custkey"]))
        .unionByName(keys.key_violation_summary(t["orders"], ["o_totalprice"]))
        .unionByName(keys.key_violation_summary(t["part"], ["p_partkey"]))
    )
    return keys.prioritise(v, {"^l_orderkey": "constraint", "price": "financial", "cust": "customer"})


_CONF_COLS = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


@query(
    "k05_key_conflicts",
    f"""SELECT l_orderkey, l_linenumber, count(*) AS occurrences, array_to_string(list_filter([{', '.join(
        f"CASE WHEN count(DISTINCT {c}) > 1 THEN '{c}' END" for c in _CONF_COLS)}], lambda x: x IS NOT NULL), ',') AS conflicting_columns
    FROM lineitem GROUP BY 1, 2 HAVING {' OR '.join(f'count(DISTINCT {c}) > 1' for c in _CONF_COLS)}""",
)
def k05(spark, d):
    out = keys.key_conflicts(fx.table(spark, d, "lineitem"), LN, _CONF_COLS)
    return out.withColumn("conflicting_columns", F.array_join("conflicting_columns", ","))


@query(
    "k06_temporal_duplicates",
    """WITH p AS (SELECT event_id, user_id, event_type, lag(event_id) OVER w AS previous_row, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap_micros
    FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) SELECT * FROM p WHERE gap_micros <= 21600000000""",
)
def k06(spark, d):
    e = fx.table(spark, d, "events")
    out = keys.temporal_duplicates(e, ["user_id", "event_type"], "ts", 6 * 3600, "event_id")
    return out.select("event_id", "user_id", "event_type", "previous_row", "gap_micros")


@query(
    "k06_temporal_burst",
    """WITH e AS (SELECT event_id, event_id % 100 = 7 AS other, to_timestamp(1700000000 + (event_id % 97)) AS moment FROM events),
    p AS (SELECT event_id, lag(event_id) OVER w AS previous_row, epoch_us(moment) - lag(epoch_us(moment)) OVER w AS gap_micros FROM e WINDOW w AS (PARTITION BY other ORDER BY moment, event_id))
    SELECT * FROM p WHERE gap_micros <= 1000000""",
)
def k06b(spark, d):
    """One key with nearly all rows, within a few seconds."""
    e = fx.table(spark, d, "events").select("event_id", (F.col("event_id") % 100 == 7).alias("other"), F.timestamp_seconds(F.lit(1700000000) + F.col("event_id") % 97).alias("at"))
    return keys.temporal_duplicates(e, ["other"], "at", 1, "event_id").select("event_id", "previous_row", "gap_micros")


@query(
    "k07_hierarchical_duplicates",
    """WITH p AS (SELECT l_partkey AS child, l_suppkey AS parent, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT child, count(*) AS parents, sum(n)::BIGINT AS rows, count(*) FILTER (WHERE n > 1) AS parents_with_repeats FROM p GROUP BY child
    HAVING count(*) > 1 OR count(*) FILTER (WHERE n > 1) > 0""",
)
def k07(spark, d):
    return keys.hierarchical_duplicates(fx.table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("k08_domain_keys", violation_sql(f"({DUP}) z", ["c_name", "c_nationkey"], "false") + " UNION ALL " + violation_sql("part", ["p_name", "p_type"], "false"))
def k08(spark, d):
    a = keys.domain_violations(fx.dup_customer(spark, d), "customer")
    return a.unionByName(keys.domain_violations(fx.table(spark, d, "part"), "product"))


@query(
    "k09_check_constraints",
    f"""WITH d AS ({fx.DIRTY_CUSTOMER_SQL}), v AS (SELECT 'name present' AS rule, 'not_missing' AS kind, count(*) FILTER (WHERE nm IS NULL OR trim(nm) = '')
    AS violations FROM d UNION ALL SELECT 'balance positive', 'check', count(*) FILTER (WHERE NOT coalesce(bal > 0, false)) FROM d UNION ALL
    SELECT 'rid unique', 'unique', count(*) - count(DISTINCT rid) FROM d UNION ALL
    SELECT 'nation unique', 'unique', count(nat) - count(DISTINCT nat) FROM d) SELECT *, violations = 0 AS passed FROM v""",
)
def k09(spark, d):
    return keys.check_constraints(
        fx.dirty_customer(spark, d),
        [
            {"name": "name present", "kind": "not_missing", "column": "nm"},
            {"name": "balance positive", "kind": "check", "expr": "bal > 0"},
            {"name": "rid unique", "kind": "unique", "columns": ["rid"]},
            {"name": "nation unique", "kind": "unique", "columns": ["nat"]},
        ],
    )


@query(
    "k10_split_by_key",
    """WITH b AS (SELECT user_id, event_type, date_trunc('hour', ts) AS h, event_id FROM events), n AS (SELECT event_id, count(*) OVER
    (PARTITION BY user_id, event_type, h) AS n FROM b) SELECT event_id, CASE WHEN n > 1 THEN 'violating' ELSE 'clean' END AS side FROM n""",
)
def k10(spark, d):
    e = fx.table(spark, d, "events").select("event_id", "user_id", "event_type", F.date_trunc("hour", "ts").alias("h"))
    clean, bad = keys.split_by_key(e, ["user_id", "event_type", "h"])
    return clean.select("event_id", F.lit("clean").alias("side")).unionByName(
        bad.select("event_id", F.lit("violating").alias("side"))
    )

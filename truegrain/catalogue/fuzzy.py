"""Similar-record queries (sections D21-D46). The SQL compares every two records of a block outright."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegrain.catalogue import fixtures as fx
from truegrain.catalogue.completeness import KIND, gone
from truegrain.catalogue.registry import query
from truegrain.functions import text
from truegrain.functions.missing import missing_count, missing_tests
from truegrain.functions.session import spread
from truegrain.operators import cluster as cl
from truegrain.operators import pairs as pr

BLOCK = ["p_brand", "p_type", "p_size"]
LEAD_T = 0.6
NEAR = fx.NEAR_PART_SQL


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\s]+', '', 'g'), '\s+', ' ', 'g'))"


def words_sql(c: str) -> str:
    return f"string_split({norm_sql(c)}, ' ')"


def sorted_tokens_sql(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct({words_sql(c)})), ' ')"


def lev_sql(a: str, b: str) -> str:
    return f"(1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))::DOUBLE)"


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))::DOUBLE"
    return f"({both} / (len({a}) + len({b}) - {both}))"


# -- the pair frames ----------------------------------------------------------------


def near_records(spark, d):
    df = fx.near_part(spark, d).withColumn("nm", F.lower("p_name"))
    return df, pr.collapse(df, "p_partkey", [*BLOCK, "p_name", "nm"])


def near_scores(records):
    return pr.edit_pairs(records, "p_partkey", "nm", LEAD_T, BLOCK).withColumnRenamed("similarity", "score")


def near_pairs(spark, d):
    """Differently written parts of one block whose names are at least 0.6 similar in lower case."""
    df, records = near_records(spark, d)
    found = near_scores(records)
    return pr.attach(found, df, "p_partkey", ["p_name", "nm", "p_retailprice", *BLOCK])


LEV = lev_sql("a.nm", "b.nm")
PAIRS = f"""WITH near AS ({NEAR}), rec AS (SELECT min(p_partkey) AS id, p_brand, p_type, p_size, p_name, lower(p_name) AS nm FROM near
    GROUP BY p_brand, p_type, p_size, p_name), ids AS (SELECT a.id AS id_a, b.id AS id_b, {LEV} AS score FROM rec a JOIN rec b ON
    a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.id < b.id WHERE {LEV} >= {LEAD_T}),
    p AS (SELECT ids.*, x.p_name AS a_p_name, y.p_name AS b_p_name, lower(x.p_name) AS a_nm, lower(y.p_name) AS b_nm, x.p_retailprice AS a_price,
    y.p_retailprice AS b_price FROM ids JOIN near x ON x.p_partkey = id_a JOIN near y ON y.p_partkey = id_b),
    cp AS (SELECT r.id AS id_a, n.p_partkey AS id_b FROM near n JOIN rec r ON n.p_brand = r.p_brand AND n.p_type = r.p_type AND n.p_size = r.p_size
    AND n.p_name = r.p_name WHERE n.p_partkey <> r.id)"""


def near_edges(spark, d, threshold):
    """Similar parts, and one edge for every part that is an exact copy of another."""
    df, _ = near_records(spark, d)
    copies = pr.copy_edges(df, "p_partkey", [*BLOCK, "p_name", "nm"])
    copies = pr.attach(copies, df, "p_partkey", ["p_name", "nm", "p_retailprice", *BLOCK])
    return near_pairs(spark, d).filter(F.col("score") >= threshold).unionByName(copies)


def near_links(spark, d, threshold):
    """The edges of `near_edges` by id and score alone, which is all that groups need: no pair fetches its records."""
    df, records = near_records(spark, d)
    copies = pr.copy_edges(df, "p_partkey", [*BLOCK, "p_name", "nm"])
    return near_scores(records).filter(F.col("score") >= threshold).unionByName(copies)


def order_pairs(spark, d):
    """Every order with the order numbered before it: one pair per order, by an equi-join on a unique key."""
    o = fx.table(spark, d, "orders")
    cols = ("o_orderkey", "o_orderdate", "o_orderpriority")
    a, b = (o.select(*[F.col(c).alias(f"{s}_{c}") for c in cols]) for s in ("a", "b"))
    return a.join(b, F.col("a_o_orderkey") == F.col("b_o_orderkey") + 1)


ORDER_PAIRS = """WITH q AS (SELECT a.o_orderkey AS a_o_orderkey, a.o_orderdate AS da, a.o_orderpriority AS pa, b.o_orderkey AS b_o_orderkey,
    b.o_orderdate AS db, b.o_orderpriority AS pb FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey + 1)"""

ABBREV = {
    "p_partkey": "p_partkey",
    "a_name": "p_name || ' ' || p_type",
    "b_name": "CASE WHEN p_partkey % 4 = 0 THEN substr(p_name, 1, 1) || '. ' || substr(p_name, strpos(p_name, ' ') + 1) || ' ' || p_type "
    "WHEN p_partkey % 4 = 1 THEN upper(substr(p_name, 1, 1) || substr(p_name, strpos(p_name, ' ') + 1, 1) || substr(p_type, 1, 1)) "
    "WHEN p_partkey % 4 = 2 THEN upper(p_name) || ' ' || p_type ELSE p_type || ' ' || p_name END",
}


# -- forms and single similarities --------------------------------------------------


@query("d21_normalise", f"SELECT doc_id, md5({norm_sql('text')}) AS normal_form FROM documents")
def d21(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.normalise(F.col("text"))).alias("normal_form"))


@query(
    "d22_format_duplicates",
    f"""WITH near AS ({NEAR}), n AS (SELECT {norm_sql('p_name')} AS nm, p_name, p_brand, p_size FROM near)
    SELECT nm AS n_p_name, p_brand, p_size AS n_p_size, count(*) AS rows, count(DISTINCT p_name) AS spellings FROM n GROUP BY nm, p_brand, p_size
    HAVING count(DISTINCT p_name) > 1""",
)
def d22(spark, d):
    out = pr.format_duplicates(fx.near_part(spark, d), ["p_name", "p_brand", "p_size"])
    return out.select(
        "n_p_name", F.concat(F.lit("Brand#"), F.regexp_replace("n_p_brand", "brand", "")).alias("p_brand"), "n_p_size", "rows", "spellings"
    )


@query("d23_token_sort_key", f"SELECT doc_id, md5({sorted_tokens_sql('text')}) AS token_key FROM documents")
def d23(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.token_sort_key(F.col("text"))).alias("token_key"))


@query("d24_levenshtein", f"{PAIRS} SELECT id_a, id_b, score, {lev_sql('a_p_name', 'b_p_name')} AS similarity FROM p")
def d24(spark, d):
    p = near_pairs(spark, d)
    return p.select("id_a", "id_b", "score", text.lev_sim(F.col("a_p_name"), F.col("b_p_name")).alias("similarity"))


@query(
    "d25_jaro_winkler",
    f"{PAIRS} SELECT id_a, id_b, round(jaro_winkler_similarity(a_p_name, b_p_name), 9) AS similarity FROM p",
)
def d25(spark, d):
    p = near_pairs(spark, d)
    return p.select("id_a", "id_b", F.round(text.jw_sim("a_p_name", "b_p_name"), 9).alias("similarity"))


@query(
    "d26_token_jaccard",
    f"""{PAIRS} SELECT id_a, id_b, {jaccard_sql('list_distinct(' + words_sql('a_p_name') + ')', 'list_distinct(' + words_sql('b_p_name') + ')')}
    AS similarity FROM p""",
)
def d26(spark, d):
    p = near_pairs(spark, d)
    return p.select("id_a", "id_b", text.token_jaccard(F.col("a_p_name"), F.col("b_p_name")).alias("similarity"))


_WORD = "upper(w)"
_CODES = f"translate({_WORD}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000077')"
_STEP = f"replace({_CODES}, '7', '')"
for _digit in "0123456":
    _STEP = f"regexp_replace({_STEP}, '{_digit}+', '{_digit}', 'g')"


@query(
    "d27_soundex",
    f"""SELECT substr({_WORD}, 1, 1) || rpad(substr(replace(substr({_STEP}, 2), '0', ''), 1, 3), 3, '0') AS phonetic_key, count(*) AS rows
    FROM (SELECT unnest({words_sql('p_name')}) AS w FROM part) z GROUP BY 1""",
)
def d27(spark, d):
    p = fx.table(spark, d, "part").select(F.explode(text.words(F.col("p_name"))).alias("w"))
    return p.groupBy(text.phonetic_key(F.col("w")).alias("phonetic_key")).agg(F.count(F.lit(1)).alias("rows"))


@query("d27_metaphone")
def d27b(spark, d):
    p = fx.table(spark, d, "part").select(F.explode(text.words(F.col("p_name"))).alias("w"))
    distinct = p.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy(text.phonetic_key(F.col("w"), "metaphone").alias("phonetic_key")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("spellings")
    )


@query(
    "d28_numeric_similarity",
    f"{PAIRS} SELECT id_a, id_b, greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(a_price - b_price) / 150.0::DOUBLE) AS similarity FROM p",
)
def d28(spark, d):
    p = near_pairs(spark, d)
    return p.select("id_a", "id_b", text.num_sim(F.col("a_p_retailprice"), F.col("b_p_retailprice"), 150).alias("similarity"))


@query(
    "d29_date_similarity",
    f"""{ORDER_PAIRS} SELECT a_o_orderkey, b_o_orderkey, greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(date_diff('day', db, da))::DOUBLE / 90.0::DOUBLE)
    AS similarity FROM q""",
)
def d29(spark, d):
    p = order_pairs(spark, d)
    return p.select("a_o_orderkey", "b_o_orderkey", text.date_sim(F.col("a_o_orderdate"), F.col("b_o_orderdate"), 90).alias("similarity"))


SYNONYMS = {"1-URGENT": "TOP", "2-HIGH": "TOP", "4-NOT SPECIFIED": "LOW", "5-LOW": "LOW"}
_SYN = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYNONYMS.items()) + " ELSE {c} END"


@query(
    "d30_category_similarity",
    f"{ORDER_PAIRS} SELECT a_o_orderkey, b_o_orderkey, ({_SYN.format(c='pa')} = {_SYN.format(c='pb')})::INT::DOUBLE AS similarity FROM q",
)
def d30(spark, d):
    p = order_pairs(spark, d)
    sim = text.cat_sim(F.col("a_o_orderpriority"), F.col("b_o_orderpriority"), SYNONYMS)
    return p.select("a_o_orderkey", "b_o_orderkey", sim.alias("similarity"))


@query(
    "d31_abbreviation_match",
    f"""WITH p AS ({fx._select(ABBREV, 'part')}), w AS (SELECT p_partkey, {norm_sql('a_name')} AS na, {norm_sql('b_name')} AS nb FROM p),
    t AS (SELECT *, string_split(na, ' ') AS wa, string_split(nb, ' ') AS wb FROM w)
    SELECT p_partkey, na <> nb AND ((len(wa) = len(wb) AND (SELECT bool_and(starts_with(wa[i], wb[i]) OR starts_with(wb[i], wa[i])) FROM
    (SELECT unnest(range(1, len(wa) + 1)) AS i) r)) OR (len(wa) > 1 AND len(wb) = 1 AND nb = array_to_string(list_transform(wa, lambda x: x[1]), ''))
    OR (len(wb) > 1 AND len(wa) = 1 AND na = array_to_string(list_transform(wb, lambda x: x[1]), ''))) AS is_abbreviation FROM t""",
)
def d31(spark, d):
    p = fx.table(spark, d, "part").selectExpr(*[f"{e.replace('strpos', 'instr')} AS {n}" for n, e in ABBREV.items()])
    return p.select("p_partkey", text.abbrev_match(F.col("a_name"), F.col("b_name")).alias("is_abbreviation"))


SUB = {"k": "c_custkey", "nm": "c_name", "bal": "c_acctbal", "nat": "c_nationkey"}


@query(
    "d32_partial_records",
    f"""WITH d AS ({fx.DIRTY_CUSTOMER_SQL}) SELECT rid, {' AND '.join(f'({gone(a, KIND[a])} OR d.{a} = c.{b})' for a, b in SUB.items())} AS is_partial_copy,
    ({' + '.join(f'{gone(a, KIND[a])}::INT' for a in SUB)})::INT AS fields_missing FROM d JOIN customer c ON c.c_custkey = d.rid + (CASE WHEN d.rid % 9 = 0 THEN 1 ELSE 0 END)""",
)
def d32(spark, d):
    a = fx.dirty_customer(spark, d)
    tests = missing_tests(a, list(SUB))
    c = fx.table(spark, d, "customer")
    joined = a.join(c, F.col("c_custkey") == F.col("rid") + F.when(F.col("rid") % 9 == 0, 1).otherwise(0))
    return joined.select(
        "rid",
        text.subsumes([(F.col(x), tests[x]) for x in SUB], [F.col(y) for y in SUB.values()]).alias("is_partial_copy"),
        missing_count(tests.values()).alias("fields_missing"),
    )


FIELDS = [pr.Field("nm", "text", 0.7), pr.Field("p_retailprice", "number", 0.3, 200.0)]
SCORED = f"""WITH near AS ({NEAR}), rec AS (SELECT min(p_partkey) AS id, p_brand, p_type, p_size, lower(p_name) AS nm, p_retailprice AS price FROM near
    GROUP BY ALL), s AS (SELECT a.id AS id_a, b.id AS id_b, {LEV} AS s_nm, greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(a.price - b.price) / 200.0::DOUBLE)
    AS s_price FROM rec a JOIN rec b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.id < b.id),
    sc AS (SELECT *, (s_nm * 0.7::DOUBLE + s_price * 0.3::DOUBLE) / (0.7::DOUBLE + 0.3::DOUBLE) AS score FROM s)"""


def scored(spark, d, threshold=0.8):
    df = fx.near_part(spark, d).withColumn("nm", F.lower("p_name"))
    return pr.similar_pairs(df, "p_partkey", FIELDS, threshold, BLOCK)


@query("d33_composite_score", f"{SCORED} SELECT id_a, id_b, s_nm, s_price AS s_p_retailprice, score FROM sc WHERE score >= 0.75")
def d33(spark, d):
    return scored(spark, d, 0.75).select("id_a", "id_b", "s_nm", "s_p_retailprice", "score")


THREE = [pr.Field("p_name", "text"), pr.Field("p_type", "text"), pr.Field("p_brand", "text")]
_ABSENT = "CASE WHEN p_partkey % 11 = 5 THEN NULL ELSE p_name END"
_SIMS = [(f"s{i}", lev_sql(f"a.{c}", f"b.{c}")) for i, c in enumerate(("p_name", "p_type", "p_brand"))]


@query(
    "d33_three_equal_fields",
    f"""WITH near AS (SELECT p_partkey, {_ABSENT} AS p_name, p_type, p_brand FROM ({NEAR}) n WHERE p_size <= 3), rec AS (SELECT min(p_partkey) AS id, p_name, p_type, p_brand FROM near GROUP BY ALL),
    s AS (SELECT a.id AS id_a, b.id AS id_b, {', '.join(f'{e} AS {n}' for n, e in _SIMS)} FROM rec a JOIN rec b ON a.id < b.id),
    sc AS (SELECT *, (coalesce(s0, 0.0::DOUBLE) + s1 + s2) / (CASE WHEN s0 IS NULL THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END) AS score FROM s)
    SELECT id_a, id_b, score FROM sc WHERE score >= 0.9""",
)
def d33_three(spark, d):
    """Three text fields of one weight without blocks; some records lack the first."""
    df = fx.near_part(spark, d).filter("p_size <= 3").withColumn("p_name", F.expr(_ABSENT))
    return pr.similar_pairs(df, "p_partkey", THREE, 0.9).select("id_a", "id_b", "score")


@query("d33_three_equal_fields_all")
def d33_three_all(spark, d):
    """The same over parts of all sizes; it has no SQL, whose check of all pairs is quadratic."""
    df = fx.near_part(spark, d).withColumn("p_name", F.expr(_ABSENT))
    return pr.similar_pairs(df, "p_partkey", THREE, 0.9).select("id_a", "id_b", "score")


@query(
    "d34_block_sizes",
    f"""SELECT p_brand, p_type, p_size, count(*) AS records, (count(*) * (count(*) - 1) // 2)::BIGINT AS possible_pairs FROM ({NEAR}) n GROUP BY 1, 2, 3""",
)
def d34(spark, d):
    return pr.block_sizes(fx.near_part(spark, d), BLOCK)


@query(
    "d34_block_pairs",
    f"""WITH near AS ({NEAR}), rec AS (SELECT min(p_partkey) AS id, p_brand, p_type, p_size, p_retailprice AS price, lower(p_name) AS nm FROM near GROUP BY ALL),
    u AS (SELECT a.id AS id_a, b.id AS id_b, {LEV} AS similarity FROM rec a JOIN rec b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type
    AND a.id < b.id UNION ALL SELECT a.id, b.id, {LEV} FROM rec a JOIN rec b ON a.price = b.price AND a.id < b.id)
    SELECT id_a, id_b, max(similarity) AS similarity, count(*) AS block_keys FROM u WHERE similarity >= 0.8 GROUP BY 1, 2""",
)
def d34b(spark, d):
    df = fx.near_part(spark, d).withColumn("nm", F.lower("p_name"))
    rec = pr.collapse(df, "p_partkey", [*BLOCK, "p_retailprice", "nm"])
    return pr.block_pairs(rec, "p_partkey", "nm", 0.8, [BLOCK, ["p_retailprice"]])


# -- long texts ---------------------------------------------------------------------

SHINGLES = f"""w AS (SELECT doc_id AS id, {words_sql('text')} AS w FROM documents), sh AS (SELECT id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w)"""
BANDS, ROWS = 8, 4


def _min_sql(i: int) -> str:
    a, b = pr.permutation(i)
    return f"min((h * {a} + {b}) % {pr.PRIME})::VARCHAR"


LSH = f"""WITH {SHINGLES}, x AS (SELECT id, ('0x' || substr(md5(unnest(s)), 1, 8))::BIGINT % {pr.PRIME} AS h FROM sh),
    sig AS (SELECT id, [{', '.join(_min_sql(i) for i in range(BANDS * ROWS))}] AS m FROM x GROUP BY id),
    bk AS (SELECT id, b AS band, array_to_string(m[b * {ROWS} + 1 : b * {ROWS} + {ROWS}], '-') AS bucket FROM sig, range({BANDS}) r(b)),
    hd AS (SELECT band, bucket, min(id) AS id_a FROM bk GROUP BY 1, 2 HAVING count(*) > 1),
    cand AS (SELECT DISTINCT id_a, bk.id AS id_b FROM bk JOIN hd ON bk.band = hd.band AND bk.bucket = hd.bucket WHERE bk.id <> id_a)"""


def texts(spark, d):
    return spread(fx.table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def lsh(spark, d):
    docs = texts(spark, d)
    return pr.lsh_pairs(pr.lsh_buckets(docs, "doc_id", "text", BANDS, ROWS))


@query("d35_lsh_pairs", f"{LSH} SELECT id_a, id_b FROM cand")
def d35(spark, d):
    return lsh(spark, d)


@query(
    "d36_similar_pairs",
    f"{SCORED} SELECT id_a, id_b, score FROM sc WHERE score >= 0.8",
)
def d36(spark, d):
    return scored(spark, d).select("id_a", "id_b", "score")


TEXTS = f"""WITH {SHINGLES}, st AS (SELECT min(id) AS id, list_sort(s) AS s FROM sh GROUP BY list_sort(s)), e AS (SELECT id, unnest(s) AS t, len(s) AS n FROM st),
    ov AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k, min(a.n) AS na, min(b.n) AS nb FROM e a JOIN e b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2),
    jp AS (SELECT id_a, id_b, k::DOUBLE / (na + nb - k)::DOUBLE AS similarity FROM ov WHERE k::DOUBLE / (na + nb - k)::DOUBLE >= 0.5)"""


def text_pairs(spark, d, threshold=0.5):
    sets = pr.text_sets(texts(spark, d), "doc_id", "text")
    return pr.as_often(pr.jaccard_pairs(pr.alike_sets(sets, threshold), threshold), sets)


@query("d36_similar_texts", f"{TEXTS} SELECT * FROM jp")
def d36b(spark, d):
    return text_pairs(spark, d)


@query("d37_similarity_bands", f"""{PAIRS} SELECT CASE WHEN score > 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'weak' END
    AS level, CASE WHEN score >= 0.9 THEN '90+' WHEN score >= 0.8 THEN '80-90' WHEN score >= 0.7 THEN '70-80' ELSE '<70' END AS band, count(*) AS pairs
    FROM p GROUP BY 1, 2""")
def d37(spark, d):
    return pr.similarity_bands(near_pairs(spark, d))


STEPS = [0.6, 0.7, 0.8, 0.9, 0.95]


@query("d38_threshold_sensitivity", f"{PAIRS} " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(*) FILTER (WHERE score >= {t}) AS pairs FROM p" for t in STEPS))
def d38(spark, d):
    return pr.threshold_sensitivity(near_pairs(spark, d), STEPS)


@query("d39_match_actions", f"""{PAIRS} SELECT id_a, id_b, score AS confidence, CASE WHEN score >= 0.9 THEN 'auto_merge' WHEN score >= 0.8 THEN 'manual_review'
    ELSE 'keep_separate' END AS match_action FROM p""")
def d39(spark, d):
    return pr.classify_pairs(near_pairs(spark, d)).select("id_a", "id_b", "confidence", "match_action")


# Components by widening label sets; every member ends up with the smallest id it can reach.
def component_sql(ctes: str, edges: str) -> str:
    return ctes.replace("WITH ", "WITH RECURSIVE ", 1) + f""", ed AS ({edges}), e2 AS (SELECT id_a AS x, id_b AS y FROM ed UNION SELECT id_b, id_a FROM ed),
    reach AS (SELECT x AS member, x AS g FROM e2 UNION SELECT e2.y, reach.g FROM reach JOIN e2 ON reach.member = e2.x),
    comp AS (SELECT member, min(g) AS cluster_id FROM reach GROUP BY member)"""


@query(
    "d40_duplicate_groups",
    component_sql(PAIRS, "SELECT id_a, id_b FROM p WHERE score >= 0.8 UNION SELECT id_a, id_b FROM cp") + " SELECT member, cluster_id FROM comp",
)
def d40(spark, d):
    return cl.components(near_links(spark, d, 0.8))


COPIES = """SELECT h.id_a, sh.id AS id_b FROM sh JOIN (SELECT list_sort(s) AS s, min(id) AS id_a FROM sh GROUP BY 1 HAVING count(*) > 1) h
    ON list_sort(sh.s) = h.s WHERE sh.id <> h.id_a"""


def text_edges(spark, d):
    """Similar texts, and one edge for every text that is a copy of another up to case and punctuation."""
    sets = pr.text_sets(texts(spark, d), "doc_id", "text")
    near = pr.jaccard_pairs(pr.alike_sets(sets, 0.5), 0.5).withColumnRenamed("similarity", "score")
    return near.unionByName(pr.set_copy_edges(sets))


@query(
    "d40_text_groups",
    component_sql(TEXTS, f"SELECT id_a, id_b FROM jp UNION {COPIES}") + """ SELECT cluster_id, cluster_id AS kept, count(*) AS members FROM comp GROUP BY cluster_id""",
)
def d40b(spark, d):
    return cl.clusters(text_edges(spark, d)).select("cluster_id", "kept", "members")


@query(
    "d40_text_groups_lsh",
    component_sql(TEXTS, f"SELECT id_a, id_b FROM jp UNION {COPIES}") + """ SELECT cluster_id, cluster_id AS kept, count(*) AS members FROM comp GROUP BY cluster_id""",
)
def d40c(spark, d):
    """The groups of d40_text_groups from LSH buckets: heads are verified, and what fails meets new heads."""
    sets = pr.text_sets(texts(spark, d), "doc_id", "text")
    links = pr.set_links(pr.alike_sets(sets, 0.5), 0.5).withColumnRenamed("similarity", "score")
    return cl.clusters(links.unionByName(pr.set_copy_edges(sets))).select("cluster_id", "kept", "members")


_AB = f"""(len(wa) = len(wb) AND (SELECT bool_and(starts_with(wa[i], wb[i]) OR starts_with(wb[i], wa[i])) FROM (SELECT unnest(range(1, len(wa) + 1)) AS i) r))
    OR (len(wa) > 1 AND len(wb) = 1 AND nb = array_to_string(list_transform(wa, lambda x: x[1]), ''))
    OR (len(wb) > 1 AND len(wa) = 1 AND na = array_to_string(list_transform(wb, lambda x: x[1]), ''))"""


@query(
    "d41_variation_type",
    f"""{PAIRS}, f AS (SELECT *, {norm_sql('a_p_name')} AS na, {norm_sql('b_p_name')} AS nb FROM p), t AS (SELECT *, string_split(na, ' ') AS wa, string_split(nb, ' ') AS wb FROM f)
    SELECT id_a, id_b, CASE WHEN a_p_name = b_p_name THEN 'identical' WHEN na = nb THEN 'formatting' WHEN {_AB} THEN 'abbreviation'
    WHEN levenshtein(na, nb) <= 2 THEN 'typo' ELSE 'other' END AS variation FROM t""",
)
def d41(spark, d):
    return pr.variation_type(near_pairs(spark, d), "p_name").select("id_a", "id_b", "variation")


@query(
    "d42_pair_differences",
    f"""{PAIRS} SELECT id_a, id_b, array_to_string(list_filter([CASE WHEN a_p_name <> b_p_name THEN 'p_name' END, CASE WHEN a_nm <> b_nm THEN 'nm' END,
    CASE WHEN a_price <> b_price THEN 'p_retailprice' END], lambda x: x IS NOT NULL), ',') AS differing_columns FROM p""",
)
def d42(spark, d):
    out = pr.pair_diff(near_pairs(spark, d), ["p_name", "nm", "p_retailprice"])
    return out.select("id_a", "id_b", F.array_join("differing_columns", ",").alias("differing_columns"))


@query(
    "d43_variation_profile",
    f"""{PAIRS} SELECT 'p_name' AS column_name, count(*) FILTER (WHERE a_p_name <> b_p_name) AS pairs FROM p UNION ALL
    SELECT 'nm', count(*) FILTER (WHERE a_nm <> b_nm) FROM p UNION ALL SELECT 'p_retailprice', count(*) FILTER (WHERE a_price <> b_price) FROM p""",
)
def d43(spark, d):
    return pr.variation_profile(near_pairs(spark, d), ["p_name", "nm", "p_retailprice"])


_JAC = jaccard_sql("list_distinct(" + words_sql("a_p_name") + ")", "list_distinct(" + words_sql("b_p_name") + ")")


@query(
    "d44_scorer_agreement",
    f"""{PAIRS}, s AS (SELECT score AS l, jaro_winkler_similarity(a_nm, b_nm) AS j, {_JAC} AS t FROM p) """
    + " UNION ALL ".join(
        f"""SELECT (SELECT count(*) FROM s) AS pairs, '{x}' AS scorer_a, '{y}' AS scorer_b, count(*) FILTER (WHERE {a} >= 0.85 AND {b} >= 0.85) AS "both",
    count(*) FILTER (WHERE {a} >= 0.85 AND {b} < 0.85) AS only_a, count(*) FILTER (WHERE {a} < 0.85 AND {b} >= 0.85) AS only_b,
    count(*) FILTER (WHERE {a} < 0.85 AND {b} < 0.85) AS neither FROM s"""
        for x, y, a, b in (("levenshtein", "jaro_winkler", "l", "j"), ("levenshtein", "jaccard", "l", "t"), ("jaro_winkler", "jaccard", "j", "t"))
    ),
)
def d44(spark, d):
    p = near_pairs(spark, d).select(
        F.col("score").alias("levenshtein"),
        text.jw_sim("a_nm", "b_nm").alias("jaro_winkler"),
        text.token_jaccard(F.col("a_p_name"), F.col("b_p_name")).alias("jaccard"),
    )
    return pr.scorer_agreement(p, ["levenshtein", "jaro_winkler", "jaccard"], 0.85)


@query("d44_similarity_histogram", f"{PAIRS} SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS pairs FROM p GROUP BY 1")
def d44b(spark, d):
    return pr.similarity_histogram(near_pairs(spark, d))


@query(
    "d45_fuzzy_summary",
    f"""{PAIRS} SELECT count(*) FILTER (WHERE score >= 0.8) AS pairs, count(*) FILTER (WHERE score >= 0.9) AS high_confidence,
    count(*) FILTER (WHERE score >= 0.8 AND score < 0.9) AS manual_review,
    count(*) FILTER (WHERE score >= 0.8 AND score < 0.8::DOUBLE + 0.05::DOUBLE AND a_price <> b_price) AS false_positive_estimate FROM p""",
)
def d45(spark, d):
    return pr.fuzzy_summary(near_pairs(spark, d), ["p_retailprice"])


_GAIN = {
    "case": "lower({c})",
    "whitespace": r"trim(regexp_replace({c}, '\s+', ' ', 'g'))",
    "punctuation": r"regexp_replace({c}, '[^\p{{L}}\p{{N}}\s]+', '', 'g')",
    "token_order": sorted_tokens_sql("{c}").replace("{L}", "{{L}}").replace("{N}", "{{N}}"),
    "all": norm_sql("{c}").replace("{L}", "{{L}}").replace("{N}", "{{N}}"),
}


@query(
    "d46_normalisation_gain",
    f"{PAIRS} " + " UNION ALL ".join(
        f"""SELECT '{w}' AS normalisation, count(*) FILTER (WHERE {e.format(c='a_p_name')} = {e.format(c='b_p_name')} AND a_p_name <> b_p_name) AS pairs_merged FROM p"""
        for w, e in _GAIN.items()
    ),
)
def d46(spark, d):
    return pr.normalisation_gain(near_pairs(spark, d), "p_name")

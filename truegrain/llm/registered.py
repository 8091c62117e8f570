"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from truegrain.llm import align, bpe, katz, minhash, mixing, pii, pivots, quality, rules, simhash, trie, warc, windows
from truegrain.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return add


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op1_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents")).drop("content")


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_of(read(spark, sf_dir, "documents"))


@query("op3_source_mix")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(read(spark, sf_dir, "documents"))


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_pivots")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op6_windows")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_passages(read(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(read(spark, sf_dir, "documents"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_katz")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(read(spark, sf_dir, "documents"))


OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
v AS (SELECT *, [CAST(('0x' || upper(substr(hex, 5 * i + 1, 5))) AS INTEGER) FOR i IN range(8)] AS fives FROM d),
b AS (SELECT page_id, payload_bytes, array_to_string([
  substr(a, ((x >> 15) & 31) + 1, 1) || substr(a, ((x >> 10) & 31) + 1, 1)
  || substr(a, ((x >> 5) & 31) + 1, 1) || substr(a, (x & 31) + 1, 1) FOR x IN fives], '') AS payload_digest
  FROM (SELECT *, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a FROM v)),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@query("op10_warc", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).drop("file", "start")


OP11 = """
WITH RECURSIVE step AS (SELECT i AS byte, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS nth, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(
    string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
rebuilt AS (SELECT c, 0 AS part, nth, role, text FROM ids JOIN turns ON turns.conv_id = base AND nth <= h
  UNION ALL SELECT c, 1, nth, role, text FROM ids JOIN turns ON turns.conv_id = c AND nth > h),
placed AS (SELECT c, row_number() OVER o AS d, list(length(role) || ':' || role || text) OVER o AS prefix, strlen(text) AS bytes
  FROM rebuilt WINDOW o AS (PARTITION BY c ORDER BY part, nth)),
rows AS (SELECT * FROM placed UNION ALL SELECT c, 0, [], 0 FROM ids),
members AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last FROM rows),
nodes AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends FROM members GROUP BY d, prefix),
up AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = n.prefix[:n.d - 1]),
kids AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
own AS (SELECT up.*, coalesce(kids.n, 0) AS n_children FROM up LEFT JOIN kids USING (conv_id, d)),
below AS (SELECT a.d, a.prefix, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.bytes) AS saved_tokens
  FROM own o JOIN rows a ON a.c = o.conv_id AND a.d <= o.d GROUP BY a.d, a.prefix)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM own JOIN below USING (d, prefix)
"""


@query("op11_trie", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


OP12 = """
WITH RECURSIVE step AS (SELECT i AS byte, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
u AS (SELECT row, unnest(words) AS a, unnest(range(len(words))) AS p FROM w),
h AS (SELECT a, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(a), 2),
    lambda i: CAST(('0x' || substr(hex(encode(a)), i, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS n
  FROM (SELECT DISTINCT a FROM u), crc),
n AS (SELECT u.row, u.p, h.n FROM u JOIN h USING (a)),
z AS (SELECT row, p, n, lead(n) OVER (PARTITION BY row ORDER BY p) AS n2 FROM n),
g AS (SELECT row, n % 262144 AS bucket FROM z UNION ALL SELECT row, (n * 1000003 + n2) % 262144 FROM z WHERE n2 IS NOT NULL),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0),
c AS (SELECT bucket, count(*) AS r, count(good.doc_id) AS t FROM g JOIN d USING (row) LEFT JOIN good USING (doc_id) GROUP BY bucket),
s AS (SELECT CAST(sum(r) AS BIGINT) AS r_all, CAST(sum(t) AS BIGINT) AS t_all FROM c),
q AS (SELECT bucket, CASE WHEN r_all = 0 OR t_all = 0 THEN 0 ELSE CAST(round((ln(CAST(t + 1 AS DOUBLE) / CAST(t_all + 262144 AS DOUBLE))
  - ln(CAST(r + 1 AS DOUBLE) / CAST(r_all + 262144 AS DOUBLE))) * 1e6) AS BIGINT) END AS ratio FROM c, s),
l AS (SELECT row, count(*) AS n_grams, CAST(sum(ratio) AS BIGINT) AS llr_micro FROM g JOIN q USING (bucket) GROUP BY row),
x AS (SELECT row, p, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY row ORDER BY p)),
y AS (SELECT row, p, count(*) OVER (PARTITION BY row, a, b, c) AS times FROM x WHERE c IS NOT NULL),
v AS (SELECT row, count(DISTINCT p + k) AS n_repeat_words FROM y, range(3) r(k) WHERE times > 1 GROUP BY row),
e AS (SELECT row, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
m AS (SELECT w.row, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_grams, 0) AS BIGINT) AS n_grams, CAST(coalesce(llr_micro, 0) AS BIGINT) AS llr_micro
  FROM w JOIN e USING (row) LEFT JOIN v USING (row) LEFT JOIN l USING (row)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams, llr_micro,
  CASE WHEN n_grams > 0 THEN CAST(llr_micro AS DOUBLE) / CAST(n_grams AS DOUBLE) / 1e6 END AS score,
  NOT base_failed AND llr_micro >= -300000 * n_grams AS kept
FROM f
"""


@query("op12_llr", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return rules.judged(docs, rules.labelled(docs, read(spark, sf_dir, "labels")))


@query("op13_align")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.aligned(read(spark, sf_dir, "documents"), *paths, with_groups=False)

"""Document fingerprints by SimHash, in DataFrame operations only.

Every word of a text votes with the signs of the bits of its hash, as often as it occurs; the sign of
each sum is a bit of the fingerprint. Two votes are added in one number, so a document's 64 sums are
32 numbers, added up where the text is read before anything is shuffled. Fingerprints within a
Hamming radius are found by permuted block tables: with more blocks than the radius some blocks must
agree, so each table is keyed by another choice of blocks, moved to the front.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truegrain.functions.session import materialised

#: Hamming radius, and blocks the 64 bits are cut into; a table is keyed by all but `RADIUS` of them.
RADIUS, BLOCKS = 3, 6
#: Two sums of 32 bits in one long; a text of two thousand million words would overflow them.
LANES = 0x0000000100000001
#: Separators of words.
SPACES = r"[\x20\x09-\x0D]+"


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, fingerprint (long) of every row of `texts`, whose keys name it.

    A text without words, or a null one, has the fingerprint 0. Words are split at ASCII white space.
    """
    words = texts.select(*keys, F.explode_outer(F.split(F.col(text), SPACES)).alias("word"))
    counts = F.coalesce(F.col("word") != "", F.lit(False))
    hashed = words.select(*keys, F.when(counts, F.xxhash64("word")).otherwise(0).alias("h"), counts.cast("long").alias("one"))
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANES))).alias(f"s{k}") for k in range(32)]
    votes = hashed.groupBy(*keys).agg(F.sum("one").alias("n"), *lanes)
    low = lambda k: F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda k: F.shiftrightunsigned(f"s{k}", 32)
    bit = lambda sum_, place: F.when(sum_ * 2 > F.col("n"), F.lit(1 << place if place < 63 else -(1 << 63))).otherwise(F.lit(0))
    bits = [bit(low(k), k) for k in range(32)] + [bit(high(k), k + 32) for k in range(32)]
    whole = bits[0].cast("long")
    for b in bits[1:]:
        whole = whole.bitwiseOR(b.cast("long"))
    return votes.select(*keys, whole.alias("fingerprint"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """The share of equal bits, 0 to 1."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def within(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """query, found, distance: every fingerprint within `radius` of each queried one, itself included.

    Both inputs have a column `fingerprint` of distinct values. Of `blocks` blocks at most `radius` can
    differ, so every pair agrees in all blocks of at least one table and none is missed; a pair that
    agrees in several tables is kept in the first.
    """
    edge = [64 * k // blocks for k in range(blocks + 1)]
    mask = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    tables = [signed(sum(mask[k] for k in some)) for some in combinations(range(blocks), blocks - radius)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(tables)])
        return df.select(F.col("fingerprint").alias(name), F.inline(rows))

    both = keyed(queries, "query").join(keyed(fingerprints, "found"), ["table", "key"])
    near = both.withColumn("differ", F.col("query").bitwiseXOR(F.col("found"))).withColumn("distance", F.bit_count("differ"))
    first = F.lit(len(tables))
    for i, m in reversed(list(enumerate(tables))):
        first = F.when(F.col("differ").bitwiseAND(F.lit(m)) == 0, F.lit(i)).otherwise(first)
    return near.filter(F.col("distance") <= radius).filter(F.col("table") == first).select("query", "found", "distance")


def with_next(docs: DataFrame) -> DataFrame:
    """range, place (name a row), doc_id, text, and next_id, next_text of the next document by ascending id (of the last: the first).

    Ids are cut into ranges at quantiles; a window orders each range, and the first document of every
    range is also sent to the range before it, where it closes the window. So each text is shuffled
    once, and no task holds more than its ranges. Only the first id of each range, as many as there
    are shuffle partitions, is known to the driver. Rows with a null id come first.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    bounds = F.array(*[F.lit(c) for c in sorted({int(c) for c in cuts})]).cast("array<long>")
    place = F.size(F.filter(bounds, lambda c: c <= F.col("doc_id")))
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place.alias("range"), F.lit(0).alias("copy"))
    firsts = sorted((r.range, r.first) for r in ranged.groupBy("range").agg(F.min("doc_id").alias("first")).collect() if r.first is not None)
    both = ranged
    if firsts:
        before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
        to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        heads = ranged.filter(F.col("doc_id").isin(list(before)))
        both = ranged.unionByName(heads.withColumns({"range": to[F.col("doc_id")], "copy": F.lit(1)}))
    order = Window.partitionBy("range").orderBy("copy", "doc_id", F.xxhash64("text"))
    following = both.select(
        "range", F.row_number().over(order).alias("place"), "doc_id", "text", "copy",
        F.lead("doc_id").over(order).alias("next_id"), F.lead("text").over(order).alias("next_text"),
    )
    return following.filter("copy = 0").drop("copy")


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS, every: int = 20) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    The edited text has its last half replaced by the first half as many characters of the next
    document. near_edited and near_next are shares of equal bits. n_near is the number of other
    documents within `radius` of a document whose id is divisible by `every`; null for the rest.

    A null text counts as empty and has the fingerprint 0, as every text without words. Of rows with
    one id the first stands for the next document. An empty table gives no rows.
    """
    rows = with_next(docs.select("doc_id", "text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("range", "place", "doc_id", "next_id", "text", n.cast("long").alias("n_chars"), F.coalesce(edited, F.col("text")).alias("edited"))
    keys = ["range", "place", "doc_id", "next_id", "n_chars", "sha"]
    both = rows.select(
        *keys[:-1], F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("of")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("of")))),
    )
    prints = fingerprints(both, [*keys, "kind"], "of")
    pair = prints.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("other"))
    told = materialised(pair)

    copies = told.groupBy("own").agg(F.count(F.lit(1)).alias("copies"))
    asked = told.filter(F.col("doc_id") % every == 0).select(F.col("own").alias("fingerprint")).distinct()
    near = within(copies.select(F.col("own").alias("fingerprint")), asked, radius)
    counts = near.join(copies, near["found"] == copies["own"]).groupBy("query").agg((F.sum("copies") - 1).alias("n_near"))
    first = told.groupBy(F.col("doc_id").alias("of_next")).agg(F.min_by("own", F.struct("range", "place")).alias("next_own"))
    out = told.join(first, F.col("next_id") == F.col("of_next"), "left").join(counts, F.col("own") == F.col("query"), "left")
    as_hex = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        as_hex("own").alias("fingerprint"), as_hex("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"), likeness("own", F.coalesce("next_own", "own")).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("n_near")).alias("n_near"),
    )

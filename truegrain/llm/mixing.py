"""Mixing sources to target weights, in blocks of tokens.

Every source is one long stream of words, packed into blocks of a fixed length. The mix is a list
of slots. Each output shard draws how many slots it takes from each source; the slots of a source
are mapped to its blocks by a pseudorandom permutation, a new one per pass over the source; and
the blocks are joined by their index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truegrain.functions.session import materialised
from truegrain.llm.common import WORD

#: Words per block, slots per output shard, and parts in which a source's words are numbered.
BLOCK, SHARD, PARTS = 512, 8192, 1024
#: Weights of the sources in order, repeating; words of the mix in parts of all words; most uses of a source.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, place, source_size, target) with one row per source; `docs` has source and size.

    With targets min(weight * level, most * size) the level is found at once: in the order of
    most * size / weight the sources before a row are full, the others share what they leave. The
    first row whose level does not fill it gives the level. Only this table of sources is sorted
    in one place; it has a row per source, not per document.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_fill = Window.orderBy("fill", "place")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = sums.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", w)
    t = t.withColumn("full", most * F.col("source_size")).withColumn("fill", F.col("full") / F.col("weight"))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level)
    t = t.withColumn("level", F.first(F.when(F.col("level") <= F.col("fill"), F.col("level")), ignorenulls=True).over(everything))
    return t.select("source", "place", "source_size", F.least(F.col("weight") * F.col("level"), F.col("full")).alias("target"))


def _permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each index under a keyed permutation of 0 .. size-1: a Feistel network, walked until inside."""
    half = np.maximum(np.ceil(np.log2(np.maximum(size, 2)) / 2), 1).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            b, m, k = half[todo], low[todo], key[todo]
            left, right = out[todo] >> b, out[todo] & m
            for r in range(4):
                f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
            out[todo] = (left << b) | right
            todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _draws(seed: int, block: int, shard: int):
    """Rows (place, shard, first, slots): the slots of a source, dealt out to shards by a multinomial draw."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sources in batches:
            for s in sources.itertuples():
                if s.slots == 0:
                    continue
                n = np.random.default_rng([seed, int(s.place)]).multinomial(int(s.slots), np.full(s.shards, 1 / s.shards))
                first = np.cumsum(n) - n
                for lo in range(0, s.shards, 100_000):
                    part = slice(lo, min(lo + 100_000, s.shards))
                    yield pd.DataFrame({"place": s.place, "shard": np.arange(part.start, part.stop), "first": first[part], "slots": n[part], "blocks": s.blocks, "source_size": s.source_size, "quota": s.quota})

    return run


def slots(sources: DataFrame, seed: int = 0, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(place, shard, slot, pass, block, take): which block of a source each slot of the mix holds, and how many of its words.

    `sources` comes from targets(). A pass over a source takes its full blocks in permuted order and
    then its last, shorter one. The last slot of a source is cut, so the words taken are its target,
    rounded. No block is used more than once per pass, which keeps every document within the cap.
    """
    t = sources.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("slots", passes * F.col("blocks") + F.ceil((F.col("quota") - passes * F.col("source_size")) / block).cast("long"))
    everything = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(everything) / shard)).cast("long"))
    drawn = t.select("place", "source_size", "quota", "blocks", "slots", "shards").mapInPandas(
        _draws(seed, block, shard),
        "place int, shard long, first long, slots long, blocks long, source_size long, quota long",
    )
    dealt = drawn.filter("slots > 0").repartition("place", "shard")
    each = dealt.select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)).alias("slot"))
    each = each.withColumn("pass", F.expr("slot div blocks")).withColumn("turn", F.col("slot") % F.col("blocks"))
    each = each.withColumn("whole", F.expr(f"source_size div {block}"))

    @F.pandas_udf("long")
    def permuted(turn: pd.Series, whole: pd.Series, place: pd.Series, go: pd.Series) -> pd.Series:
        key = (place.to_numpy(np.uint64) << np.uint64(20)) + go.to_numpy(np.uint64) + np.uint64(seed << 52)
        out = turn.to_numpy(np.int64).copy()
        inside = out < whole.to_numpy()
        if inside.any():
            out[inside] = _permuted(out[inside], whole.to_numpy()[inside], key[inside])
        return pd.Series(out)

    each = each.withColumn("block", permuted("turn", "whole", "place", "pass"))
    left = F.col("quota") - F.col("pass") * F.col("source_size") - F.col("turn") * block
    size = F.when(F.col("turn") < F.col("whole"), F.lit(block)).otherwise(F.col("source_size") % block)
    return each.select("place", "shard", "slot", "pass", "block", F.greatest(F.least(left, size), F.lit(0)).cast("long").alias("take"))


def numbered(docs: DataFrame) -> DataFrame:
    """doc (the row as a struct), key, row, source, size. (key, row) names a row even where ids repeat or are null."""
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce("doc_id", F.lit(-(2**63))).alias("key"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("content"),
    )
    same = Window.partitionBy("key").orderBy("source", "size", "content")
    return d.withColumn("row", F.row_number().over(same)).drop("content")


def packed(docs: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents with their place in the stream of their source: + place, start (its first word's number).

    The words are numbered in two steps, within hash parts and over the parts of a source, so that a
    source with most of the rows is not sorted in one task. The number of parts is fixed and no cap:
    a part holds about a thousandth of a source.
    """
    d = docs.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
    parts = d.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    parts = parts.join(sources, parts["source"].eqNullSafe(sources["source"])).select(
        parts["source"].alias("of"), parts["part"].alias("in_part"), "ahead", "place", "source_size", "target"
    )
    within = Window.partitionBy("source", "part").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(parts, d["source"].eqNullSafe(parts["of"]) & (d["part"] == parts["in_part"]))
    return d.withColumn("start", (F.col("inner") + F.col("ahead")).cast("long")).drop("inner", "ahead", "of", "in_part", "part")


def mix(docs: DataFrame, seed: int = 0, block: int = BLOCK, shard: int = SHARD, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(documents, uses): the sizes and targets of all documents, and the word ranges the mix takes.

    documents: key and row (see numbered), doc_id, source, size, place (of the source), source_size,
    target, start. uses: place and start (which name a document that has words), key, row, shard,
    slot, pass, low, high: the words low .. high-1 of the document are in that slot.

    `docs` has doc_id, source and text; other columns are left alone. A null text has no words and is
    never taken; a null source is a source of its own; repeated rows are documents of their own; an
    empty table gives empty results. The same rows and seed give the same mix, in any order.
    """
    sized = materialised(numbered(docs.select("doc_id", "source", "text")).select(F.col("doc.doc_id").alias("doc_id"), "key", "row", "source", "size"))
    sources = materialised(targets(sized, weights, share, most))
    placed = materialised(packed(sized, sources, block))
    spread = placed.filter("size > 0").select(
        "place", "start", "size", "key", "row",
        F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"),
    )
    both = spread.join(slots(sources, seed, block, shard), ["place", "block"])
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    uses = both.select("place", "start", "key", "row", "shard", "slot", "pass", (low - F.col("start")).alias("low"), (high - F.col("start")).alias("high"))
    return placed, uses.filter("high > low")


def mixed_sizes(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words the mix takes)."""
    placed, uses = mix(docs, **how)
    taken = uses.groupBy("place", "start").agg(F.sum(F.col("high") - F.col("low")).alias("taken")).withColumn("some", F.lit(True))
    own = placed.withColumn("some", F.col("size") > 0)
    return own.join(taken, ["place", "start", "some"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: a row per document and pass with the words taken, columns as in `docs`.

    A document taken whole keeps its text as it is; of one taken in part the words are kept in order,
    joined by single spaces. n_chars, where there is such a column, is counted anew.
    """
    _, uses = mix(docs, **how)
    runs = uses.groupBy("key", "row", "pass").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs"))
    runs = runs.select(F.col("key").alias("of"), F.col("row").alias("of_row"), "runs", F.expr("aggregate(runs, 0L, (n, r) -> n + r.high - r.low)").alias("words"))
    both = numbered(docs).join(runs, (F.col("key") == F.col("of")) & (F.col("row") - F.col("of_row") == 0))
    cut = F.when(F.col("words") < F.col("size"), F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)))
    # inside an array of one the words are split off once per row, not once per run of words
    of_words = lambda w: F.flatten(F.transform("runs", lambda r: F.slice(w, r["low"].cast("int") + 1, (r["high"] - r["low"]).cast("int"))))
    some = F.array_join(F.flatten(F.transform(F.array(cut), of_words)), " ")
    out = both.withColumn("text", F.when(F.col("words") < F.col("size"), some).otherwise(F.col("doc.text")))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])

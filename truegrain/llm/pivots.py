"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points, the pivots, in order. The inverted lists
are kept for triples of these, so that to meet in a list is to share three pivots or more. What meets is verified
by its cosine.

Vectors that are very close are kept in balls: if all members are within half the angle of a link of
the ball's leader, any two of them are linked, by the triangle inequality, and are not compared. So a
large group of near copies costs one comparison per member, and two balls cost one comparison unless
the bounds on the angles of their members leave the answer open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegrain.functions.session import materialised
from truegrain.llm.common import mix
from truegrain.operators.cluster import components

#: Cosine from which vectors are linked, pivots to be shared, rounds of leaders.
LINKED, SHARED, ROUNDS = 0.9, 3, 3
#: Pivots: this many times the root of the number of vectors, within bounds. They are a bounded sample; every vector is indexed.
PIVOTS, FEWEST, MOST = 2.5, 64, 4096
#: Slack for rounding in angles.
SLACK = 1e-7


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, unit (doubles as bytes; null where the vector links with nothing)."""
    for b in batches:
        out = []
        for x in b.column(1).to_pylist():
            unit = None
            if x and None not in x:
                v = np.array(x, np.float64)
                if np.isfinite(v).all() and v.any():
                    v = v / np.abs(v).max()
                    unit = (v / np.linalg.norm(v) + 0.0).tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])


def _stacked(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in the column."""
    raw = [v.as_buffer() for v in column]
    size = np.array([len(r) for r in raw])
    return [
        (at, np.frombuffer(b"".join([raw[k] for k in at]), np.float64).reshape(len(at), -1))
        for n in np.unique(size)
        for at in [np.flatnonzero(size == n)]
    ]


@F.arrow_udf(T.DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of unit vectors as bytes; -1 where the lengths differ."""
    out = np.full(len(a), -1.0)
    sizes = [len(x.as_buffer()) == len(y.as_buffer()) for x, y in zip(a, b)]
    same = np.flatnonzero(sizes)
    if len(same):
        for (at, x), (_, y) in zip(_stacked(a.take(pa.array(same))), _stacked(b.take(pa.array(same)))):
            out[same[at]] = np.clip(np.einsum("ij,ij->i", x, y), -1, 1)
    return pa.array(out)


def choose_pivots(distinct: DataFrame, spaced: float = 0.7) -> tuple[np.ndarray, int]:
    """(pivots, nearest kept per vector), at most MOST pivots, all of one length and with cosines below `spaced`.

    They come from a sample twice as large, those of the smallest hashes. Near copies among pivots would
    rank by chance before a vector, and two near vectors would then share few of them.
    """
    n = distinct.count()
    wanted = min(max(FEWEST, round(PIVOTS * math.sqrt(n))), MOST)
    rows = distinct.select("unit").orderBy(F.xxhash64("unit")).limit(2 * wanted).collect()
    sizes = [len(r.unit) for r in rows]
    usual = max(set(sizes), key=sizes.count) if sizes else 64
    some = np.array([np.frombuffer(r.unit, np.float64) for r in rows if len(r.unit) == usual]).reshape(-1, usual // 8)
    chosen = np.zeros((0, usual // 8))
    for v in some:
        if len(chosen) < wanted and (chosen @ v < spaced).all():
            chosen = np.concatenate([chosen, v[None]])
    return chosen, max(6, round(math.log2(max(len(chosen), 1))))


def describe(distinct: DataFrame, pivots: np.ndarray, nearest: int, shared: int = SHARED) -> DataFrame:
    """The columns of `distinct`, with first (nearest pivot) and keys (one per choice of `shared` of the nearest pivots).

    Vectors of another length than the pivots are described by fixed random directions instead.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def described(unit: pa.Array) -> pa.Array:
        rows: list = [None] * len(unit)
        for at, x in _stacked(unit):
            p = pivots
            if p.shape[1] != x.shape[1] or len(p) < FEWEST // 2:
                p = np.random.default_rng(x.shape[1]).normal(size=(FEWEST, x.shape[1]))
            k = min(nearest, len(p))
            order = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :k].astype(np.uint64)
            first = order[:, 0] + np.uint64(x.shape[1] << 20)
            chosen = np.sort(order, axis=1)
            keys = [first]
            for some in combinations(range(k), min(shared, k)):
                key = np.full(len(at), x.shape[1], np.uint64)
                for c in some:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + chosen[:, c] + np.uint64(1))
                keys.append(key)
            for i, r in zip(at, np.stack(keys, 1).view(np.int64).tolist()):
                rows[i] = r
        return pa.array(rows, pa.list_(pa.int64()))

    d = distinct.withColumn("_d", described("unit"))
    return d.select(*distinct.columns, F.col("_d")[0].alias("first"), F.slice("_d", 2, 1 << 20).alias("keys"))


def balls(described: DataFrame, linked: float = LINKED, rounds: int = ROUNDS) -> DataFrame:
    """id, ball, angle: each vector with its leader, itself if it stays alone, and its angle to it.

    Vectors with one nearest pivot choose a leader, that of the smallest hash; those within half the
    angle of a link join it and the rest choose again. However few rounds, the result stays exact:
    vectors left over are balls of one.
    """
    half = math.acos(linked) / 2 - SLACK
    rest, done = described.select("id", "first", "unit"), None
    for k in range(rounds):
        lead = rest.groupBy("first").agg(F.min_by(F.struct(F.col("id").alias("ball"), F.col("unit").alias("lead")), F.xxhash64("id", F.lit(k))).alias("l"))
        near = rest.join(lead, "first").withColumn("angle", F.when(F.col("id") == F.col("l.ball"), 0.0).otherwise(F.acos(cosine("unit", F.col("l.lead")))))
        near = materialised(near.select("id", "first", "unit", F.col("l.ball").alias("ball"), "angle"))
        own = near.filter(F.col("angle") <= half).select("id", "ball", "angle")
        done = own if done is None else done.unionByName(own)
        rest = near.filter(F.col("angle") > half).select("id", "first", "unit")
    return done.unionByName(rest.select("id", F.col("id").alias("ball"), F.lit(0.0).alias("angle")))


def near_vectors(vectors: DataFrame, linked: float = LINKED, shared: int = SHARED, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other vectors of cosine >= `linked` that the index finds; component_id is the
    smallest vec_id reachable by links. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, vectors of different lengths not with one another. Of rows with one id
    one vector counts. A row with a null id never links and keeps its row. An empty table gives no rows.
    Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    units = rows.filter("vec_id is not null").mapInArrow(_units, "vec_id long, unit binary")
    units = materialised(units.groupBy("vec_id").agg(F.min("unit").alias("unit")))
    distinct = units.filter("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    distinct = materialised(distinct)
    pivots, nearest = choose_pivots(distinct)
    known = materialised(describe(distinct, pivots, nearest, shared))
    member = materialised(balls(known, linked, rounds).join(known.select("id", "copies"), "id"))
    ball = member.groupBy("ball").agg(F.sum("copies").alias("size"), F.max("angle").alias("radius"), F.min("id").alias("name"))
    ball = materialised(ball.join(known.select(F.col("id").alias("ball"), "unit"), "ball"))

    lists = known.select("id", F.explode("keys").alias("key")).join(member.select("id", "ball"), "id").select("key", "ball").distinct()
    several = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    lists = materialised(lists.join(several, "key", "left_semi"))
    met = lists.join(lists.select("key", F.col("ball").alias("other")), "key").filter("ball < other").select("ball", "other").distinct()
    a = ball.select("ball", F.col("unit").alias("u"), F.col("radius").alias("r"), F.col("size").alias("n"), F.col("name").alias("a"))
    b = ball.select(F.col("ball").alias("other"), F.col("unit").alias("v"), F.col("radius").alias("q"), F.col("size").alias("m"), F.col("name").alias("b"))
    met = met.join(a, "ball").join(b, "other").withColumn("cos", cosine("u", "v"))
    limit, apart, reach = math.acos(linked), F.acos("cos"), F.col("r") + F.col("q")
    alone = reach == 0
    sure = F.when(alone, F.col("cos") >= linked).otherwise(apart + reach <= limit - SLACK)
    maybe = ~sure & ~alone & (apart - reach <= limit + SLACK)
    judged = materialised(met.select("ball", "other", "n", "m", "a", "b", sure.alias("sure"), maybe.alias("maybe")).filter("sure or maybe"))

    whole = judged.filter("sure")
    by_ball = whole.select("ball", F.col("m").alias("k")).unionByName(whole.select(F.col("other").alias("ball"), F.col("n").alias("k")))
    by_ball = by_ball.groupBy("ball").agg(F.sum("k").alias("whole"))
    one = member.join(known.select("id", "unit"), "id")
    left = one.select("ball", F.col("id").alias("x"), F.col("unit").alias("u"), F.col("copies").alias("n"))
    right = one.select(F.col("ball").alias("other"), F.col("id").alias("y"), F.col("unit").alias("v"), F.col("copies").alias("m"))
    unsure = judged.filter("maybe").select("ball", "other", "a", "b").join(left, "ball").join(right, "other")
    unsure = materialised(unsure.filter(cosine("u", "v") >= linked).select("x", "y", "n", "m", "a", "b"))
    by_id = unsure.select(F.col("x").alias("id"), F.col("m").alias("k")).unionByName(unsure.select(F.col("y").alias("id"), F.col("n").alias("k")))
    by_id = by_id.groupBy("id").agg(F.sum("k").alias("single"))

    edges = whole.select("a", "b").unionByName(unsure.select("a", "b"))
    groups = components(edges, "a", "b").select(F.col("member").alias("name"), "cluster_id")
    counts = member.join(ball.select("ball", "size", "name"), "ball").join(by_ball, "ball", "left").join(by_id, "id", "left").join(groups, "name", "left")
    counts = counts.select(
        F.col("id").alias("of"),
        (F.col("size") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("single", F.lit(0))).cast("long").alias("links"),
        F.coalesce("cluster_id", "name").alias("component"),
    )
    named = units.join(known.select("unit", "id"), "unit", "left").join(counts, F.col("id") == F.col("of"), "left")
    out = named.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    lost = rows.filter("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lost).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

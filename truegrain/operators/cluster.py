"""Duplicate groups: connected components of the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegrain.functions.session import by_shuffle, checkpointed, materialised


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of every node to the smallest one around it."""
    both = edges.unionByName(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    low = both.groupBy("child").agg(F.min("parent").alias("m")).select("child", F.least("child", "m").alias("m"))
    return (
        both.filter("parent > child").join(by_shuffle(low), "child").select(F.col("parent").alias("child"), F.col("m").alias("parent")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie every node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("child", "parent").alias("child"), F.least("child", "parent").alias("parent"))
    low = down.groupBy("child").agg(F.min("parent").alias("m"))
    moved = down.join(by_shuffle(low), "child").filter("parent <> m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    return moved.unionByName(low.select("child", F.col("m").alias("parent"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node has one parent and no parent has a parent."""
    crowded = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("child")
    chained = edges.join(by_shuffle(edges.select(F.col("child").alias("parent"))), "parent", "left_semi").select("child")
    return crowded.unionByName(chained).isEmpty()


def components(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(member, cluster_id) for every id in a pair; the cluster is named after its smallest id.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until only stars are left,
    in a number of rounds that grows with the square of the logarithm of the size. Each step is a
    minimum per node and an equi-join, so a node with very many neighbours is never gathered in
    one place. The state is written to shared storage each round, and read in few tasks however
    many parts the shuffles had.
    """
    edges = pairs.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).filter("child <> parent").distinct()
    edges = materialised(edges)
    while not _is_star_forest(edges):
        edges = materialised(_small_star(_large_star(edges)))
    roots = edges.select(F.col("parent").alias("member"), F.col("parent").alias("cluster_id")).distinct()
    return edges.select(F.col("child").alias("member"), F.col("parent").alias("cluster_id")).unionByName(roots)


def clusters(pairs: DataFrame, a: str = "id_a", b: str = "id_b", score: str = "score") -> DataFrame:
    """One row per group: cluster id (also the record to keep), members, pairs, lowest score."""
    pairs = checkpointed(pairs)
    c = components(pairs, a, b)
    size = c.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))
    strength = (
        pairs.join(by_shuffle(c), pairs[a] == c["member"])
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("pairs"), F.min(score).alias("min_score"))
    )
    return size.join(by_shuffle(strength), "cluster_id").select("cluster_id", F.col("cluster_id").alias("kept"), "members", "pairs", "min_score")

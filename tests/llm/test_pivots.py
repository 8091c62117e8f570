"""Links and components of vectors against brute force."""

import numpy as np
import pytest

from truegrain.llm import pivots as p
from truegrain.llm.common import read


def brute(rows, linked=0.9):
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_size = {}
    for i in ids:
        by_size.setdefault(len(good[i]), []).append(i)
    for some in by_size.values():
        x = np.array([good[i] for i in some])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= linked, 1))):
            i, j = some[a], some[b]
            links[i] += 1
            links[j] += 1
            u, v = find(i), find(j)
            root[max(u, v)] = min(u, v)
    return links, {i: find(i) for i, _ in rows}


def test_embeddings(spark):
    df = read(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    links, component = brute(rows)
    got = {r.vec_id: r for r in p.near_vectors(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component_id for i, r in got.items()} == component
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_recall_near_the_threshold(spark):
    """Chains of vectors whose neighbours are just linked: no ball holds them, the bounds leave pairs open."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(150):
        v = rng.normal(size=24)
        for _ in range(4):
            v = v / np.linalg.norm(v)
            rows.append((len(rows), v.tolist()))
            z = rng.normal(size=24)
            z -= z @ v * v
            c = rng.uniform(0.88, 0.99)
            v = c * v + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
    links, _ = brute(rows)
    got = {r.vec_id: r.n_links for r in p.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] <= links[i] for i in links)
    assert sum(got.values()) >= 0.9 * sum(links.values())


def test_large_group(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=16)
    near = [(v + rng.normal(size=16) * 0.03).tolist() for _ in range(400)]
    rows = list(enumerate([v.tolist()] * 300 + near + rng.normal(size=(200, 16)).tolist()))
    got = {r.vec_id: r for r in p.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links, component = brute(rows)
    assert {i: r.n_links for i, r in got.items()} == links and {i: r.component_id for i, r in got.items()} == component


@pytest.mark.parametrize("copies", [1, 2])
def test_odd_rows(spark, copies):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 1.0]), (10, [1e300, 1e300]), (11, [-1.0, -1.0])]
    df = spark.createDataFrame(rows * copies + [(None, [1.0, 1.0])], "vec_id long, embedding array<double>").selectExpr("*", "'x' as unit", "1 as id")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in p.near_vectors(df).collect()}
    assert got[None] == (0, None, True) and len(got) == 12
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 11))
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[10] == (2, 7, False)
    assert p.near_vectors(df.limit(0)).collect() == []

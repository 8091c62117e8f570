"""The mix against plain water filling and plain counting; the recipe against the documents it makes."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from truegrain.llm import mixing as m
from truegrain.llm.common import read


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: m.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, full, open_ = m.SHARE * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > m.MOST * sizes[s]}
        if not over:
            return full | share
        for s in over:
            full[s] = m.MOST * sizes[s]
            left -= full[s]
        open_ -= over
    return full


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        source = rng.choice(["hot"] * 5 + ["b", "é", "Z", None, ""])
        text = rng.choice([None, "", " ".join(f"w{k}" for k in range(rng.randrange(1, 120)))])
        rows.append((i, source, text, 7, 1))
    rows += [(5, "b", "one two", 7, 1), (5, "b", "one two", 7, 1), (None, "b", "null id", 7, 1), (900, "only", "word " * 3000, 7, 1)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars int, place int"), rows


@pytest.mark.parametrize("block", [8, 512])
def test_sizes(docs, block):
    df, rows = docs
    got = m.mixed_sizes(df, block=block, shard=16).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, t, *_ in rows:
        sizes[s] += size(t)
    want, taken = plain_targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5


def test_runs_agree_in_any_order(docs):
    df, _ = docs
    key = lambda rows: sorted(map(str, rows))
    assert key(m.mixed_sizes(df).collect()) == key(m.mixed_sizes(df.orderBy(F.rand(3)).repartition(5)).collect())


def test_every_block_once_per_pass_and_documents_hold_what_was_taken(docs):
    df, rows = docs
    placed, uses = m.mix(df, block=8, shard=16)
    seen = defaultdict(set)
    for u in uses.collect():
        span = (u["pass"], u.low, u.high)
        assert span not in seen[u.place, u.start]
        seen[u.place, u.start].add(span)
    mixed = m.mixed_documents(df, block=8, shard=16)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += size(r.text)
        assert r.n_chars == len(r.text)
    taken = Counter()
    for r in m.mixed_sizes(df, block=8, shard=16).collect():
        taken[r.source] += r.taken
    assert words == Counter({k: v for k, v in taken.items() if v})
    assert uses.select("shard").distinct().count() > 5


def test_documents(spark, sf):
    got = m.mixed_sizes(read(spark, sf, "documents")).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(a - b) <= 0.5 for a, b in by.values())


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert m.mixed_sizes(empty).collect() == [] and m.mixed_documents(empty).collect() == []
    nothing = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert {(r.taken, r.target) for r in m.mixed_sizes(nothing).collect()} == {(0, 0.0)}

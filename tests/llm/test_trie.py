"""The prefix trie against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from truegrain.functions.scan import running
from truegrain.llm import trie
from truegrain.llm.common import read


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    for turns in convs.values():
        turns.sort()
    nodes = defaultdict(list)
    ended = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = convs.get(c - int(math.fmod(c, 5)), [])
        seq = [t[3:] for t in base[:h] + own[h:]]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
        ended[tuple(seq)].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        own = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += kids[p] == 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(ended.get(p, []))) for p, m in nodes.items()
    )


KIND = "conv_id long, turn long, role string, text string"


def check(spark, rows):
    got = trie.prefix_trie(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, 0, "user", "a"), (0, 1, "bot", "é"), (0, 1, "bot", "é"), (0, None, None, None), (1, 0, "user", "a"), (1, 5, "bot", "b"),
        (-3, 0, "user", "x"), (-5, 0, "user", "y"), (-5, 1, "user", "z"), (7, 2, None, "q"), (None, 0, "user", "lost"), (9, 0, "u", "ser a"), (14, 0, "us", "er a"),
        (2**40, 0, "user", "far"), (22, 0, "user", ""), (23, 0, "", "user"),
    ]
    check(spark, rows)


def test_families_copies_and_chains(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 50)  # several pieces per list of ids
    rng = random.Random(3)
    rows = []
    for c in range(150):
        n = rng.choice([1, 2, 3, 5, 12])
        same = rng.random() < 0.5
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"common {t}" if same else rng.choice(["x", "y", "long text " * 3])) for t in range(n)]
    rows += [(c, t, "user", f"chain {t}") for c in (1000, 1001, 1006) for t in range(90)]
    rng.shuffle(rows)
    check(spark, rows)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], KIND)).collect() == []


def test_contraction_of_random_trees(spark):
    rng = random.Random(1)
    up = {0: None}
    for k in range(1, 300):
        up[k] = k - 1 if rng.random() < 0.7 else rng.randrange(k)
    depth, kids = {0: 0}, defaultdict(int)
    for k in range(1, 300):
        depth[k] = depth[up[k]] + 1
        kids[up[k]] += 1
    rows = [((k, depth[k]), None if up[k] is None else (up[k], depth[up[k]]), kids[k], k * k) for k in up]
    tree = spark.createDataFrame(rows, "id struct<conv:long,depth:long>, up struct<conv:long,depth:long>, n_children long, v long")
    want = {k: k * k for k in up}
    for k in range(299, 0, -1):
        want[up[k]] += want[k]
    assert {r.id.conv: r.v for r in trie.contracted(tree, ["v"]).collect()} == want


def test_extra_columns(spark):
    rows = [(c, t, "user", f"t{t}", 5, "k") for c in range(10) for t in range(3)]
    df = spark.createDataFrame(rows, KIND + ", place int, key string").repartition(3)
    assert sorted(map(tuple, trie.prefix_trie(df).collect())) == plain([r[:4] for r in rows])


def test_running_totals_of_one_key(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") % 10).alias("o"), F.lit(2).cast("long").alias("v"))
    got = [r.s for r in running(df, ["k"], ["o"], {"s": "v"}, 7).orderBy("o", "s").collect()]
    assert got == [2 * i for i in range(1, 1001)]


def test_documents(spark, sf):
    df = read(spark, sf, "conversations")
    check(spark, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])

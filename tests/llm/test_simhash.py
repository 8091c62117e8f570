"""SimHash against plain Python votes, block tables against all pairs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from truegrain.llm import simhash as s
from truegrain.llm.common import read


def test_votes(spark):
    texts = ["a b b c", "a  b\tb\nc ", "", None, "x", "word " * 500 + "other", "é ü \xa0 é"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.fingerprint for r in s.fingerprints(df, ["i"], "t").collect()}
    words = {w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for i, t in enumerate(texts):
        bag = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        expected = 0
        for b in range(64):
            if sum(1 if h[w] >> b & 1 else -1 for w in bag) > 0:
                expected |= 1 << b
        assert got[i] & (2**64 - 1) == expected, t
    assert got[0] == got[1]


def test_within_misses_nothing(spark):
    rng = random.Random(0)
    base = [rng.getrandbits(63) for _ in range(20)]
    some = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for k in rng.sample(range(63), rng.randrange(1, 6)):
                x ^= 1 << k
            some.add(x)
    every = spark.createDataFrame([(x,) for x in some] + [(-1,), (-2,)], "fingerprint long")
    asked = [*base, -1]
    got = sorted(map(tuple, s.within(every, spark.createDataFrame([(x,) for x in asked], "fingerprint long")).collect()))
    d = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == sorted((a, b, d(a, b)) for a in asked for b in [*some, -1, -2] if d(a, b) <= s.RADIUS)


def expected(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), edited)
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 23])
def test_small_tables(spark, n):
    rng = random.Random(n)
    rows = [(i * 3, rng.choice([None, "", "one two three", "é" * i, "word " * i])) for i in range(n)]
    got = {r.doc_id: r for r in s.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r.n_chars, r.edited_sha256) == want[i][:2]


def test_documents(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in s.edited_fingerprints(docs).collect()}
    want = expected(rows)
    edited = spark.createDataFrame([(i, e) for i, (_, _, e) in want.items()], "i long, t string")
    again = {r.i: r.fingerprint & (2**64 - 1) for r in s.fingerprints(edited, ["i"], "t").collect()}
    own = {i: int(r.fingerprint, 16) for i, r in got.items()}
    ids = sorted(own)
    for k, i in enumerate(ids):
        r, after = got[i], own[ids[(k + 1) % len(ids)]]
        assert (r.n_chars, r.edited_sha256) == want[i][:2] and int(r.edited_fingerprint, 16) == again[i]
        assert r.near_edited == 1 - bin(own[i] ^ again[i]).count("1") / 64
        assert r.near_next == 1 - bin(own[i] ^ after).count("1") / 64
        near = sum(bin(own[i] ^ o).count("1") <= s.RADIUS for o in own.values()) - 1
        assert r.n_near == (near if i % 20 == 0 else None)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b", 1), (1, "a b", 1), (1, None, 2), (None, "c", 3), (2, "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    assert s.edited_fingerprints(docs).count() == 5

"""DartMinHash estimates weighted Jaccard; groups against brute force; odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from truegrain.llm import minhash as m


def weighted_jaccard(a, b):
    def bag(text):
        w = text.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    x, y = bag(a or ""), bag(b or "")
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def batch(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_agreement_is_weighted_similarity():
    rng = np.random.default_rng(0)
    element = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
    wa, wb = rng.integers(1, 9, 60).astype(float), rng.integers(1, 9, 60).astype(float)
    wb[:20] = wa[:20]
    e, t, w = np.concatenate([element, element]), np.repeat([0, 1], 60), np.concatenate([wa, wb])
    k = 2000
    s = m.signatures(e, t, w, 2, k)
    expected = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((s[0] == s[1]).mean() - expected) < 4 * np.sqrt(0.25 / k)


def test_signature_depends_on_the_text_alone():
    texts = ["a b c d e f g " * 3, "", "one two", "x y z " * 400]
    both = m.signatures(*m._elements(*batch(texts)), len(texts), 100)
    for i, t in enumerate(texts):
        alone = m.signatures(*m._elements(*batch([t])), 1, 100)
        assert (both[i] == alone[0]).all()
    assert not both[1].any() and both[0].all() and both[2].all()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randrange(40, 160))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["short text", "short text", "", None, "same " * 50, "same " * 50, "same " * 30]
    return [(i, t) for i, t in enumerate(texts)]


def test_groups_against_brute_force(spark, corpus):
    got = {r.doc_id: r for r in m.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    group = {i: i for i, _ in corpus}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in corpus:
        for j, b in corpus[:i]:
            if weighted_jaccard(a, b) >= 0.8:
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    assert {i: got[i].group_id for i in got} == {i: root(i) for i, _ in corpus}
    assert all(r.kept == (r.doc_id == r.group_id) for r in got.values())
    texts = dict(corpus)
    assert all(texts[r.class_id] == texts[r.doc_id] for r in got.values())


def test_large_family_is_tied(spark):
    """Copies that differ more from each other than from their source, as many as a bucket may hold."""
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(300):
        copy = list(base)
        for k in rng.sample(range(200), 3):
            copy[k] = f"new{i}x{k}"
        rows.append((i, " ".join(copy)))
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.group_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_odd_rows(spark):
    rows = [(1, None, 5, "q"), (1, None, 5, "q"), (2, "", 6, "q"), (None, "a b c d e f", 7, "q"), (3, "a b c d e f", 8, None), (4, "a b c d e f", 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, bands string")
    got = sorted((tuple(r)[:4] for r in m.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 2, 2, True), (3, 3, 3, True), (4, 3, 3, False), (None, None, None, True)], key=str)
    kept = m.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "2", "3", "None"]
    assert m.near_duplicates(docs.limit(0)).collect() == [] and m.deduplicated(docs.limit(0)).collect() == []


def test_one_id_with_several_texts(spark):
    x, y = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    other = " ".join(f"u{i}" for i in range(60))
    kept = lambda rows: sorted(map(tuple, m.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert kept([(1, x), (2, x), (2, y)]) == [(1, x), (2, y)]
    assert kept([(1, x), (1, other), (2, x)]) == sorted([(1, x), (1, other)])
    assert len(kept([(1, x), (1, x + " more"), (2, x), (2, x)])) == 1
    assert kept([(5, x), (5, x), (7, y), (7, y), (9, x)]) == [(5, x), (7, y)]


def test_chain_within_one_bucket(spark):
    """Each text is near its neighbours only, so heads of a few rounds leave it in pieces."""
    words = ["w%d" % i for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[10 * i : 10 * i + 100])) for i in range(14)], "doc_id long, text string")
    firsts = docs.select("doc_id", F.unhex(F.md5("text")).alias("id"), F.lit(1).alias("n"), F.lit(96).cast("long").alias("size"), F.expr("array(1L, 2L)").alias("bands"))
    name = {bytes(r.id): r.doc_id for r in firsts.collect()}
    got = {tuple(sorted((name[bytes(r.id_a)], name[bytes(r.id_b)]))) for r in m.candidate_links(firsts, docs).collect()}
    assert got == {(i, i + 1) for i in range(13)}


def test_near_texts_among_unlike_ones_of_a_bucket(spark):
    """One bucket of unlike texts, in which two near ones are never heads of a round that ties something."""
    texts = [" ".join(f"t{i}w{k}" for k in range(96)) for i in range(60)]
    texts[31] = texts[12] + " more"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    firsts = docs.select("doc_id", F.unhex(F.md5("text")).alias("id"), F.lit(1).alias("n"), F.lit(92).cast("long").alias("size"), F.expr("array(1L, 2L)").alias("bands"))
    name = {bytes(r.id): r.doc_id for r in firsts.collect()}
    got = [sorted((name[bytes(r.id_a)], name[bytes(r.id_b)])) for r in m.candidate_links(firsts, docs).collect()]
    assert got == [[12, 31]]

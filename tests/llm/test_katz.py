"""Katz backoff against a plain dictionary model, whose probabilities are shown to sum to one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from truegrain.llm import katz as k
from truegrain.llm.common import read

END, START = object(), object()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    def __init__(self, rows):
        train = [words(t) for i, t in rows if not fold(i)]
        self.uni, self.bi = Counter(), Counter()
        for w in train:
            w = [*w, END]
            self.uni.update(w)
            self.bi.update(zip([START, *w], w))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        of = lambda c: [sum(x == r for x in c.values()) for r in range(1, k.DISCOUNTED + 2)]
        self.d1, self.d2 = k.discounts(of(self.uni)), k.discounts(of(self.bi), k.LEAST)
        self.context = Counter(self.uni)
        self.context[START] = len(train)
        lost = sum(c * (1 - self.d1[min(c, 6)]) for c in self.uni.values())
        self.scale = self.n if lost > 0 else self.n + 1
        self.unknown = (lost if lost > 0 else 1) / self.scale
        self.after = defaultdict(dict)
        for (h, w), c in self.bi.items():
            if c >= k.LEAST:
                self.after[h][w] = c

    def p1(self, w):
        c = self.uni.get(w, 0)
        return self.d1[min(c, 6)] * c / self.scale if c else self.unknown

    def p(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.p1(w)
        mass = sum(self.d2[min(c, 6)] * c for c in seen.values())
        den = self.context[h] + (mass >= self.context[h] * (1 - 1e-12))
        if w in seen:
            return self.d2[min(seen[w], 6)] * seen[w] / den
        return (1 - mass / den) / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def row(self, text):
        w = [*words(text), END]
        base = sum(math.log10((self.uni.get(x, 0) + 1) / (self.n + self.v + 1)) for x in w)
        return len(w), sum(x in self.uni for x in w), base, sum(math.log10(self.p(h, x)) for h, x in zip([START, *w], w))


def corpus():
    rng = random.Random(7)
    vocabulary = ["w%d" % i for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(40)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "A a B\tb\n"), (203, "never seen words w1"), (None, "w1 w2")]


def compare(rows, got):
    plain = Plain(rows)
    assert len(got) == len(rows)
    want = sorted((str(i), fold(i), *plain.row(t)) for i, t in rows)
    found = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    for a, b in zip(want, found):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert {r.train_tokens for r in got} == {plain.n}


def test_probabilities_sum_to_one():
    plain = Plain(corpus())
    vocabulary = [*plain.uni, "an unknown word"]
    for h in [START, *plain.uni, "unknown history"]:
        assert math.isclose(sum(plain.p(h, w) for w in vocabulary), 1, rel_tol=1e-9)


@pytest.mark.parametrize("tile", [k.TILE, 300])
def test_scores(spark, tile, monkeypatch):
    monkeypatch.setattr(k, "PER_PART", 100)
    rows = corpus()
    compare(rows, k.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tile=tile).collect())


def test_documents(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    compare([(r.doc_id, r.text) for r in docs.collect()], k.scored(docs).collect())


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, tile int")
    assert k.scored(empty).collect() == []
    held = next(i for i in range(100) if fold(i))
    got = k.scored(spark.createDataFrame([(held, "only held out")], "doc_id long, text string")).collect()
    assert got[0].n_known == 0 and got[0].train_tokens == 0 and got[0].score == 0
    repeated = [(1, "a b"), (1, "a b"), (1, None)]
    compare(repeated, k.scored(spark.createDataFrame(repeated, "doc_id long, text string")).collect())


def test_pairs_seen_once_count(spark):
    """A held-out copy of one training text scores above the same words in another order."""
    copy, other = [i for i in range(1000, 1100) if fold(i)][:2]
    learned = [i for i in range(100) if not fold(i)]
    sentence = ["s%d" % i for i in range(30)]
    rows = [(learned[0], " ".join(sentence)), *[(i, " ".join("r%d" % (i * 7 % 50 + j) for j in range(8))) for i in learned[1:20]]]
    rows += [(copy, " ".join(sentence)), (other, " ".join(sentence[::-1]))]
    score = {r.doc_id: r.score for r in k.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert score[copy] > score[other] + 5

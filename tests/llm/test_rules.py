"""Quality rules against plain Python counts."""

import math
import random
import re
import zlib
from collections import Counter

from truegrain.llm import rules as r
from truegrain.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n):
    w = [zlib.crc32(x.encode()) for x in WORD.findall(text or "")]
    return [x % n for x in w] + [(a * 1000003 + b) % n for a, b in zip(w, w[1:])]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if windows[t] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def plain(docs, corpus, n, threshold):
    raw, target = Counter(), Counter()
    for text, in_raw, in_target in corpus:
        for g in grams(text, n):
            raw[g] += in_raw
            target[g] += in_target
    a, b = sum(target.values()), sum(raw.values())
    ratio = lambda g: round((math.log((target[g] + 1) / (a + n)) - math.log((raw[g] + 1) / (b + n))) * 1e6) if a and b else 0
    out = []
    for i, text in docs:
        g = grams(text, n)
        llr = sum(map(ratio, g))
        *counts, failed = base(text)
        out.append((i, *counts, failed, len(g), llr, not failed and llr >= threshold * len(g)))
    return out


def told(df):
    return [tuple(x[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams", "llr_micro", "kept")) for x in df.collect()]


def key(rows):
    return sorted(rows, key=str)


ODD = [
    (1, None), (1, ""), (None, "one two three one two three"), (2, " \t\n\x0b\x0c\r "), (3, "a a a a"), (4, "é ü\xa0ß 日本 😀 | #$%"),
    (5, "line\n\nline\n line\r\nline\n"), (5, "line\n\nline\n line\r\nline\n"), (6, "word " * 60), (7, " ".join(f"w{i}" for i in range(70)) + " <b> & *"), (8, "x " * 3000 + "y"),
]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 5, "q") for i, t in ODD], "doc_id long, text string, row int, bucket string")
    corpus = [(t, True, i in (4, 7)) for i, t in ODD]
    table = spark.createDataFrame(corpus, "text string, in_raw boolean, in_target boolean")
    assert key(told(r.judged(docs, table, 256, -400000))) == key(plain(ODD, corpus, 256, -400000))
    none = table.filter("in_target").limit(0)
    assert all(x.llr_micro == 0 and x.kept != x.base_failed for x in r.judged(docs, none).collect())
    assert r.judged(docs.limit(0), table).collect() == []


def test_random_texts(spark):
    rng = random.Random(4)
    pool = [f"v{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(pool[: rng.choice([5, 40])]) + rng.choice(["", "\n", "|"]) for _ in range(rng.randrange(1, 200)))) for i in range(60)]
    corpus = [(t, i % 3 > 0, i % 2 == 0) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    table = spark.createDataFrame(corpus, "text string, in_raw boolean, in_target boolean")
    assert key(told(r.judged(df, table, 1024, -20000))) == key(plain(docs, corpus, 1024, -20000))


def test_labels(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in (1, 2, 3, 4, 5)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 1, 0), (4, 0, 0), (5, 1, 0), (5, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.text: x.in_target for x in r.labelled(docs, labels).collect()}
    assert got == {"t1": True, "t2": False, "t3": False, "t4": False, "t5": True}
    assert sum(x.in_target for x in r.labelled(docs, labels, most=1).collect()) <= 1


def test_every_label_counts(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    plan = r.labelled(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not any(x in plan for x in ("Broadcast", "Limit", "TakeOrdered"))
    assert not hasattr(r, "TRUSTED")


def test_native_plan(spark, sf):
    docs = read(spark, sf, "documents")
    plan = r.judged(docs, r.labelled(docs, read(spark, sf, "labels")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_documents(spark, sf):
    docs = read(spark, sf, "documents")
    labels = read(spark, sf, "labels").collect()
    good = {x.doc_id for x in labels if x.quality == 1 and x.toxic == 0}
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    got = r.judged(docs, r.labelled(docs, read(spark, sf, "labels")))
    assert key(told(got)) == key(plain(rows, [(t, True, i in good) for i, t in rows], r.BUCKETS, r.THRESHOLD))

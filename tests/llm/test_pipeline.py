"""The stages of the pipeline, each on all that the one before kept, against plain code."""

from collections import Counter

import corpus_pipeline as c
import pytest
from pyspark.sql import functions as F
from test_bpe import expected as encoded
from test_minhash import weighted_jaccard

from truegrain.functions.session import materialised
from truegrain.llm import mixing, pii, quality
from truegrain.llm.common import read


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = read(spark, sf, "documents"), []
    for name, stage in c.STAGES:
        made = materialised(stage(spark, docs, sf))
        out.append((name, docs, made))
        docs = made
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns(stages, spark, sf):
    columns = read(spark, sf, "documents").columns
    assert [n for n, _, _ in stages] == ["quality classifier", "minhash near-dedup", "pii", "source mix", "bpe"]
    assert all(made.columns == columns for _, _, made in stages[:-1])


def test_rejected_documents_go(stages, spark, sf):
    _, docs, made = stages[0]
    told = quality.scored(docs, read(spark, sf, "labels")).filter("predicted = 1").select("doc_id")
    assert rows(made.select("doc_id")) == rows(told) and 0 < made.count() < docs.count()


def test_one_of_each_group_stays(stages):
    _, docs, made = stages[1]
    kept = {r.doc_id: r.text for r in made.collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) < set(before) and all(before[i] == t for i, t in kept.items())
    ids = sorted(kept)
    assert not any(weighted_jaccard(kept[a], kept[b]) >= 0.8 for k, a in enumerate(ids) for b in ids[:k])
    assert all(any(weighted_jaccard(t, u) >= 0.8 for u in before.values() if u is not t) for i, t in before.items() if i not in kept)


def test_personal_data_is_masked(stages):
    _, docs, made = stages[2]
    before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, made))
    assert before.keys() == after.keys()
    changed = 0
    for i, r in after.items():
        assert r.n_chars == len(r.text) and not pii.base_spans(r.text)
        changed += r.text != before[i].text
        assert (r.text != before[i].text) >= bool(pii.base_spans(before[i].text))
    assert 0 < changed < len(after) / 2


def test_mix_takes_what_it_says(stages):
    _, docs, made = stages[3]
    want = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs).collect()}
    got = {r.doc_id: r.n for r in made.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w")).groupBy("doc_id").agg(F.sum("w").alias("n")).collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_token_ids(stages):
    _, docs, made = stages[4]
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((i, tuple(ids)) for (i, _), (ids, _) in zip(texts, encoded([t for _, t in texts])))
    assert Counter((r.doc_id, tuple(r.ids)) for r in made.collect()) == want
    assert all(r.n_tokens == len(r.ids) for r in made.collect())

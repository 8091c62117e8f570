"""BPE against the public tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from truegrain.llm import bpe
from truegrain.llm.common import read

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \t\n", "Hello  World's 12 é<|endoftext|> foo<|startoftext|>", "日本 İİx ǅ ß", "a\xa0b c\x00d <|EndOfText|>",
    "ΟΔΟΣ Σ", "a\x1cb\x1fc\x85d", "it'S they'LL ''s 's'", "x" * 3000, "ab" * 700 + "!" * 99, "한 é ퟿", "\U0001f600\U0001f468‍\U0001f469 ١½Ⅷ",
]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [(e.ids, t.decode(e.ids, skip_special_tokens=False)) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_odd_texts():
    v = bpe.vocabulary(PATH)
    got = bpe._encode(v, ODD, bpe._texts)
    for text, a, b in zip(ODD, got, expected(ODD)):
        assert tuple(a) == tuple(b), text


def test_random_texts():
    rng = random.Random(5)
    letters = "abetTHES 'éÉß12,.!<|>中Σ́\n"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(400)]
    assert [tuple(x) for x in bpe._encode(bpe.vocabulary(PATH), texts, bpe._texts)] == [tuple(x) for x in expected(texts)]


def test_round_trip_of_ids():
    v = bpe.vocabulary(PATH)
    for ids, decoded in expected(["one two, three", "x"]):
        assert bpe.decode(v, ids) == decoded


def test_documents(spark, sf):
    docs = read(spark, sf, "documents")
    rows = {r.doc_id: r for r in bpe.encoded_digests(docs, PATH).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for (i, _), (ids, decoded) in zip(texts.items(), expected(list(texts.values()))):
        r = rows[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (1, "", 2), (None, "two words", 3), (1, "two words", 4)]])
def test_cases(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe.encoded(df, PATH).collect()), key=str)
    assert len(got) == len(rows)
    for i, ids, decoded in got:
        assert decoded in ("", "two</w> words</w>") and len(ids) in (0, 2)

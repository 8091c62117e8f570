"""Alignment against a plain walk over the bytes, and against all pairs of intervals."""

import hashlib
from collections import defaultdict

import public_tokenizers as P
import pytest

from truegrain.llm import align
from truegrain.llm.common import read

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def byte_of():
    """The usual table of byte-level vocabularies, letter to byte."""
    table, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1
    return table


def plain(rows):
    """doc_id, counts and groups of every row, by plain Python and the two libraries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb, letter = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_of()
    ta.encode_special_tokens = True
    docs = []
    for i, text in rows:
        text = text or ""
        whole = (" " + text).encode()
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        ra = [bytes(letter[c] for c in ta.id_to_token(x)) for x in a]
        rb = [bytes([int(tb.id_to_piece(x)[3:5], 16)]) if tb.is_byte(x) else tb.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(ra) != whole or b"".join(rb) != whole:
            a, b, ra, rb = [], [], [], []
        spans = []
        for raw in (ra, rb):
            at, own = 0, []
            for r in raw:
                own.append((at, at + len(r)))
                at += len(r)
            spans.append(own)
        ends = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, k, m = [], 0, 0
        for e in sorted(ends):
            x, y = [], []
            while k < len(a) and spans[0][k][1] <= e:
                x.append(str(a[k]))
                k += 1
            while m < len(b) and spans[1][m][1] <= e:
                y.append(str(b[m]))
                m += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        linked, m = [], 0
        for k, (s, e) in enumerate(spans[0]):
            while m and spans[1][m - 1][1] > s:
                m -= 1
            while m < len(b) and spans[1][m][1] <= s:
                m += 1
            n = m
            while n < len(b) and spans[1][n][0] < e:
                linked.append((a[k], b[n]))
                n += 1
        docs.append((i, len(a), len(b), groups, linked))
    count, most = defaultdict(int), defaultdict(int)
    for *_, linked in docs:
        for p in set(linked):
            count[p] += 1
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for i, n_a, n_b, groups, linked in docs:
        text = ";".join(groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        out.append((i, n_a, n_b, len(groups), len(linked), sum(count[p] == most[p[0]] for p in linked), sum(count[p] for p in linked), sha, text))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[7], r[5], r[6]))


ODD = [
    (1, "plain words here"), (1, "plain words here"), (1, None), (None, "an id that is null"), (2, ""), (3, " "), (4, "  two  spaces "),
    (5, "tabs\tand\nlines\r\n"), (6, "é ü ß 日本語 😀 x́"), (7, "a▁b has the sign of pieces"), (8, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (9, "nul \x00 byte"), (10, "ﬁ ligature and ① number"), (11, "x" * 3000), (12, "​ zero width ﻿"), (13, "don't we'll 12345 $%&"),
]


def test_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = align.aligned(docs, A, B).collect()
    assert order(got) == order(plain(ODD))
    assert all(r.groups_sha256 == "" and r.n_a == 0 for r in got if r.doc_id in (2, 7))


def test_tiles_and_extra_columns(spark):
    rows = [(i, f"some words of number {i % 7} and more of the same", "x", 1, 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair string, tile int, n_a int").repartition(5)
    got = align.aligned(docs, A, B, tile=200).collect()  # several tiles a task
    assert order(got) == order(plain([r[:2] for r in rows]))


def test_empty_table(spark):
    assert align.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_long_text_is_cut_without_change(monkeypatch):
    monkeypatch.setattr(align, "STRETCH", 40)
    text = "Some words, that are cut; here 12 and there.\n  But not  inside  of anything that isn't plain. " * 30 + "日本語" * 60
    assert len(align._stretches(text)) > 20
    a, b = align.byte_level(A), align.piece_level(B)
    x, y = align.encode(a, b, [text])[0]
    assert x.tolist() == a.encode([" " + text])[0] and y.tolist() == b.encode([text])[0]


@pytest.mark.parametrize("seed", range(3))
def test_coalescing(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    la = rng.integers(1, 6, 40)
    lb = np.diff(np.concatenate([[0], np.sort(rng.choice(np.arange(1, la.sum()), 25, replace=False)), [la.sum()]]))
    ea, eb = np.cumsum(la), np.cumsum(lb)
    side, place, group = align.coalesced(la, lb)
    for s, p, g in zip(side, place, group):
        start = (ea - la)[p] if s == 0 else (eb - lb)[p]
        assert g == len([x for x in set(ea.tolist()) & set(eb.tolist()) if x <= start])
    want = [(i, j) for i in range(len(la)) for j in range(len(lb)) if ea[i] - la[i] < eb[j] and eb[j] - lb[j] < ea[i]]
    assert list(zip(*[v.tolist() for v in align.links(la, lb)])) == want


def test_documents(spark, sf):
    docs = read(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert order(align.aligned(docs, A, B).collect()) == order(plain(rows))


def test_few_tiles_are_held_at_once(spark, monkeypatch):
    """Many tiles in one task: a row group has few of them, and their counts are not gathered as lists."""
    import pyarrow.parquet as pq

    written, write = [], align.materialised
    monkeypatch.setattr(align, "materialised", lambda df, **options: written.append(write(df, **options)) or written[-1])
    rows = [(i, f"text number {i} of some words") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = align.aligned(df, A, B, tile=1)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert {r.doc_id: r.groups for r in got.collect()} == {i: r["groups"] for i, r in ((r.doc_id, r) for r in align.aligned(df, A, B).collect())}
    parts = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written[0].inputFiles()]
    assert sum(p.num_rows for p in parts) == 50
    assert all(p.row_group(k).num_rows <= align.GROUP for p in parts for k in range(p.num_row_groups))

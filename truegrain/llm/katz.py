"""Language-model scores: bigrams with Katz backoff.

Counts of one and two words are discounted by Good and Turing's estimate; what a history loses by it
goes to words not seen after it, in proportion to their unigram
probability and exactly normalised. Unigrams back off in turn to one class of unknown words.

The corpus is stored once as a table of tiles, each the word numbers of some documents and its own
sorted vocabulary of hashes. A tile asks the partitions of the n-gram tables for what it needs: it
sends each partition its n-grams in one packed row, with its training counts, and is told the counts
over the whole corpus. So counting and looking up share one shuffle of each tile's distinct n-grams,
no word is a row, and no table is held by one task or the driver. The backoff weights, which need
sums over all successors of a history, are exchanged the same way.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegrain.functions.session import checkpoint_root, materialised
from truegrain.llm.common import LOWER, mix, pieces, text_bytes, word_hashes, words

#: Largest count that is discounted, least count of a bigram in the model.
DISCOUNTED, LEAST = 5, 1
#: Bytes of text per tile, and n-grams per partition of a table (about).
TILE, PER_PART = 6 << 20, 400_000
#: Keys of the end and the start of a text.
END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A2757A2757A275)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def in_training(id_col: str = "doc_id") -> Column:
    """False for the fold that is only scored: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 != 2, F.lit(True))


def _pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, so that what is zero in all of them compresses away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""


def _unpack(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel() if raw else np.zeros(0, kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0))) if len(keys) else b""


def _unpack_keys(raw: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64)


# Tiles -------------------------------------------------------------------------------------------


def _tiles(most: int):
    """Tiles of about `most` bytes of text, from the documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list = []
        size = 0

        def close():
            nonlocal number, held, size
            ids = [i for x in held for i in x[0]]
            train = [t for x in held for t in x[1]]
            vocab, index = np.unique(np.concatenate([x[2] for x in held] + [np.array([END])]), return_inverse=True)
            lens = np.concatenate([x[3] for x in held]).astype(np.int32)
            row = {"tile": number, "ids": ids, "train": train, "lens": _pack(lens), "vocab": _pack_keys(vocab), "words": _pack(index[:-1].astype(np.int32))}
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=_TILE)

        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in pieces(offsets, 1 << 21):
                part = LOWER[data[offsets[lo] : offsets[hi]]]
                s, e, t = words(part, offsets[lo : hi + 1] - offsets[lo])
                held.append((b.column(0)[lo:hi].to_pylist(), b.column(2)[lo:hi].to_pylist(), word_hashes(part, s, e), np.bincount(t, minlength=hi - lo)))
                size += len(part)
                if size >= most:
                    yield close()
        if held:
            yield close()

    return run


_TILE = pa.schema([("tile", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lens", pa.binary()), ("vocab", pa.binary()), ("words", pa.binary())])


@dataclass
class Tile:
    """A tile laid out by position: every word and the end of each text, with what stands before."""

    vocab: np.ndarray
    doc: np.ndarray
    word: np.ndarray  # place in vocab
    history: np.ndarray  # place in vocab; len(vocab) is the start
    train: np.ndarray  # per document
    pairs: np.ndarray  # sorted keys of the distinct bigrams
    pair: np.ndarray  # place in pairs per position

    @classmethod
    def of(cls, row: dict) -> Tile:
        vocab, lens, flat = _unpack_keys(row["vocab"]), _unpack(row["lens"], np.int32).astype(np.int64), _unpack(row["words"], np.int32)
        n = len(lens)
        doc = np.repeat(np.arange(n), lens + 1)
        last = np.cumsum(lens + 1) - 1
        word = np.empty(len(doc), np.int64)
        is_end = np.zeros(len(doc), bool)
        is_end[last] = True
        word[is_end] = np.searchsorted(vocab, END)
        word[~is_end] = flat
        history = np.empty(len(doc), np.int64)
        history[1:] = word[:-1]
        history[last - lens] = len(vocab)
        with np.errstate(over="ignore"):
            keys = mix(np.append(vocab, START)[history] * _ODD + mix(vocab)[word])
        pairs, pair = np.unique(keys, return_inverse=True)
        return cls(vocab, doc, word, history, np.array(row["train"], bool), pairs, pair)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row after the other: a batch holds several tiles, and only one should be unpacked at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _sent(level: int, tile: int, parts: int, keys: np.ndarray, *columns: np.ndarray) -> list[dict]:
    """A row per partition that holds some of the sorted keys: partitions are ranges of the hash."""
    shift = np.uint64(64 - int(math.log2(parts)))
    part = (keys >> shift).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    return [
        {"level": level, "part": int(part[a]), "tile": tile, "keys": _pack_keys(keys[a:b]), "packed": [_pack(c[a:b]) for c in columns]}
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)])
    ]


_SENT = pa.schema([("level", pa.int32()), ("part", pa.int64()), ("tile", pa.int64()), ("keys", pa.binary()), ("packed", pa.list_(pa.binary()))])
SENT = "level int, part long, tile long, keys binary, packed array<binary>"
TOLD = "level int, part long, tile long, packed array<binary>, numbers array<long>"


def _asked(parts: dict[int, int]):
    """Requests of a tile for its words and bigrams, with its training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                t = Tile.of(row)
                learned = t.train[t.doc]
                uni = np.bincount(t.word[learned], minlength=len(t.vocab)).astype(np.uint32)
                bi = np.bincount(t.pair[learned], minlength=len(t.pairs)).astype(np.uint32)
                yield pa.RecordBatch.from_pylist(_sent(1, row["tile"], parts[1], t.vocab, uni) + _sent(2, row["tile"], parts[2], t.pairs, bi), schema=_SENT)

    return run


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """One partition of an n-gram table: total counts, told to every tile, and counts of counts.

    Each n-gram is owned by the first tile that asks for it, so that sums over n-grams take it once.
    """
    rows = rows.sort_values("tile")
    asked = [_unpack_keys(k) for k in rows["keys"]]
    counts = np.concatenate([_unpack(p[0], np.uint32) for p in rows["packed"]]).astype(np.int64)
    keys = np.concatenate(asked)
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(place, weights=counts).astype(np.int64)
    own = np.zeros(len(keys), np.uint8)
    own[first] = 1
    level, part = int(rows["level"].iat[0]), int(rows["part"].iat[0])
    out, at = [], 0
    told = total[place].astype(np.uint32)
    for tile, k in zip(rows["tile"], asked):
        cut = slice(at, at + len(k))
        out.append((level, part, int(tile), [_pack(told[cut]), np.packbits(own[cut]).tobytes()], None))
        at += len(k)
    numbers = [int(total.sum()), int((total > 0).sum()), *np.bincount(total[total <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:].tolist()]
    out.append((level, part, None, None, numbers))
    return pd.DataFrame(out, columns=["level", "part", "tile", "packed", "numbers"])


# The model ---------------------------------------------------------------------------------------


def discounts(counts_of_counts: list[int], least: int = 1, k: int = DISCOUNTED) -> np.ndarray:
    """Katz's factors d[r] for counts r up to k from n[1..k+1]; 1 beyond, and wherever the estimate is no factor."""
    n = [0, *counts_of_counts]
    d = np.ones(k + 2)
    beyond = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
    for r in range(least, k + 1):
        if n[r] and beyond < 1:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond)
            if 0 < x < 1:
                d[r] = x
    return d


@dataclass
class Model:
    """The few numbers of the corpus that every task needs."""

    tokens: int
    types: int
    uni: np.ndarray
    bi: np.ndarray
    unknown: float = 0.0
    scale: float = 1.0

    @classmethod
    def of(cls, uni: list[int], bi: list[int]) -> Model:
        m = cls(uni[0], uni[1], discounts(uni[2:]), discounts(bi[2:], LEAST))
        lost = sum(n * r * (1 - m.uni[r]) for r, n in enumerate(uni[2 : 2 + DISCOUNTED], 1))
        # without any discount one more token, an unknown one, is assumed
        m.scale = float(m.tokens if lost > 0 else m.tokens + 1)
        m.unknown = (lost if lost > 0 else 1.0) / m.scale
        return m

    def word(self, count: np.ndarray) -> np.ndarray:
        d = self.uni[np.minimum(count, DISCOUNTED + 1)]
        return np.where(count > 0, d * count / self.scale, self.unknown)

    def discounted(self, count: np.ndarray) -> np.ndarray:
        return self.bi[np.minimum(count, DISCOUNTED + 1)] * count


def _replies(row: dict, t: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count of each word, count of each bigram, whether the tile owns the bigram), from what the partitions told."""
    found = {1: [], 2: []}
    for x in sorted(row["told"], key=lambda x: x["part"]):
        n = _unpack(x["packed"][0], np.uint32).astype(np.int64)
        found[x["level"]].append((n, np.unpackbits(np.frombuffer(x["packed"][1], np.uint8), count=len(n)).astype(bool)))
    uni = np.concatenate([n for n, _ in found[1]])
    bi, own = (np.concatenate(x) for x in zip(*found[2]))
    return uni, bi, own


def _history_counts(t: Tile, uni: np.ndarray) -> np.ndarray:
    """Of every word as a history; the start stands before as many words as there are ends."""
    return np.append(uni, uni[np.searchsorted(t.vocab, END)])


def _one_of_each(t: Tile) -> tuple[np.ndarray, np.ndarray]:
    """(history, word) of each distinct bigram."""
    at = np.zeros(len(t.pairs), np.int64)
    at[t.pair] = np.arange(len(t.pair))
    return t.history[at], t.word[at]


def _weighed(model: Model, parts: int):
    """Per tile: sums over the bigrams it owns by history, and a request for the histories it backs off from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                t = Tile.of(row)
                uni, bi, own = _replies(row, t)
                h, w = _one_of_each(t)
                kept = own & (bi >= LEAST)
                n = len(t.vocab) + 1
                seen = np.bincount(h[kept], weights=model.discounted(bi[kept]), minlength=n)
                lower = np.bincount(h[kept], weights=model.word(uni[w[kept]]), minlength=n)
                needs = np.zeros(n, bool)
                needs[h] = True
                needs &= _history_counts(t, uni) >= LEAST
                at = np.flatnonzero(needs)
                keys = np.append(t.vocab, START)[at]
                order = np.argsort(keys)
                at = at[order]
                count = _history_counts(t, uni)[at].astype(np.uint32)
                yield pa.RecordBatch.from_pylist(_sent(3, row["tile"], parts, keys[order], seen[at], lower[at], count), schema=_SENT)

    return run


def _backed(rows: pd.DataFrame) -> pd.DataFrame:
    """One partition of the histories: the weight of backing off, and the denominator of what was seen.

    The weight is the mass not given to seen words over the unigram mass of words not seen, so the
    probabilities after a history sum to one. A history without any discount is counted once more.
    """
    rows = rows.sort_values("tile")
    asked = [_unpack_keys(k) for k in rows["keys"]]
    seen, lower = (np.concatenate([_unpack(p[i], np.float64) for p in rows["packed"]]) for i in (0, 1))
    count = np.concatenate([_unpack(p[2], np.uint32) for p in rows["packed"]]).astype(np.float64)
    _, first, place = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
    seen, lower, count = np.bincount(place, weights=seen), np.bincount(place, weights=lower), count[first]
    short = seen >= count * (1 - 1e-12)
    count = count + short
    weight = (1 - seen / count) / (1 - lower)
    out, at = [], 0
    weight, short = weight[place], short[place].astype(np.uint8)
    for tile, k in zip(rows["tile"], asked):
        cut = slice(at, at + len(k))
        out.append((3, int(rows["part"].iat[0]), int(tile), [_pack(weight[cut]), np.packbits(short[cut]).tobytes()], None))
        at += len(k)
    return pd.DataFrame(out, columns=["level", "part", "tile", "packed", "numbers"])


_SCORE = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
])
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                t = Tile.of(row)
                backed = [x for x in row["told"] if x["level"] == 3]
                row["told"] = [x for x in row["told"] if x["level"] < 3]
                uni, bi, _ = _replies(row, t)
                n, docs = len(t.vocab) + 1, len(t.train)
                weight, short = np.ones(n), np.zeros(n, bool)
                count = _history_counts(t, uni)
                has = np.zeros(n, bool)
                has[t.history] = True
                at = np.flatnonzero(has & (count >= LEAST))
                at = at[np.argsort(np.append(t.vocab, START)[at])]
                if len(at):
                    parts = sorted(backed, key=lambda x: x["part"])
                    told = [_unpack(x["packed"][0], np.float64) for x in parts]
                    weight[at] = np.concatenate(told)
                    short[at] = np.concatenate([np.unpackbits(np.frombuffer(x["packed"][1], np.uint8), count=len(v)) for x, v in zip(parts, told)])
                r, h = bi[t.pair], t.history
                kept = r >= LEAST
                p = np.where(kept, model.discounted(r) / np.maximum(count[h] + short[h], 1), weight[h] * model.word(uni[t.word]))
                c = uni[t.word]
                base = np.log10((c + 1) / (model.tokens + model.types + 1))
                columns = [
                    pa.array(row["ids"], pa.int64()), pa.array(~t.train),
                    np.bincount(t.doc, minlength=docs), np.bincount(t.doc, weights=c > 0, minlength=docs).astype(np.int64),
                    np.full(docs, model.tokens), np.bincount(t.doc, weights=base, minlength=docs), np.bincount(t.doc, weights=np.log10(p), minlength=docs),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCORE)], schema=_SCORE)

    return run


def _joined(tiles: DataFrame, told: DataFrame) -> DataFrame:
    """Each tile with all it was told; its row is read from its bucket, only the answers are shuffled."""
    rows = told.groupBy("tile").agg(F.collect_list(F.struct("level", "part", "packed")).alias("told"))
    return tiles.join(rows.hint("merge"), "tile")


def scored(docs: DataFrame, buckets: int | None = None, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are lower-cased in A-Z and split at ASCII white space; each text ends with one more token.
    A null or empty text is its end alone. Repeated ids are texts of their own; a row with a null id
    is learned from. Without training texts every word is unknown. An empty table gives no rows.
    Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    checkpoint_root(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), in_training().alias("train"))
    name = f"tiles_{uuid.uuid4().hex}"
    schema = "tile long, ids array<long>, train array<boolean>, lens binary, vocab binary, words binary"
    source.mapInArrow(_tiles(tile), schema).write.option("compression", "zstd").bucketBy(buckets, "tile").saveAsTable(name)
    tiles = spark.table(name)
    try:
        size = tiles.select(F.sum(F.length("words") / 4).alias("n")).first().n or 0
        parts = 1 << max(0, math.ceil(math.log2(max(size / PER_PART, 1))))
        asked = tiles.mapInArrow(_asked({1: max(1, parts // 4), 2: parts}), SENT)
        told = materialised(asked.groupBy("level", "part").applyInPandas(_counted, TOLD))
        sums = told.filter("tile is null").select("level", F.posexplode("numbers").alias("k", "n")).groupBy("level", "k").agg(F.sum("n").alias("n")).collect()
        numbers = {level: [0] * (DISCOUNTED + 3) for level in (1, 2)}
        for r in sums:
            numbers[r.level][r.k] = r.n
        model = Model.of(numbers[1], numbers[2])
        answers = told.filter("tile is not null").select("level", "part", "tile", "packed")
        weighed = _joined(tiles, answers).mapInArrow(_weighed(model, max(1, parts // 4)), SENT)
        backed = materialised(weighed.groupBy("part").applyInPandas(_backed, TOLD).select("level", "part", "tile", "packed"))
        return materialised(_joined(tiles, answers.unionByName(backed)).mapInArrow(_scored(model), SCORE))
    finally:
        spark.sql(f"DROP TABLE {name}")

"""Quality classifier: a convolutional network over the bytes of a text, in numpy.

Every byte has a learned vector. Filters over a few neighbouring bytes run over overlapping chunks
that cover the whole text, each giving its largest response per filter in each chunk. The largest
over all chunks and the mean over chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegrain.llm.common import pieces, text_bytes

#: Network: numbers per byte, bytes per filter, step of a filter, filters, bytes from chunk to chunk.
DIM, WIDTH, STEP, FILTERS, CHUNK = 8, 6, 2, 24, 512
#: Training: labelled texts used at most (half of each label where there are enough), steps, texts per step. A small
#: sample is gone over more often, so that the network is trained as long.
SAMPLE, STEPS, BATCH, RATE = 4000, 750, 32, 0.004
#: Bytes of text scored in one go.
PART = 1 << 18


@dataclass
class Network:
    byte: np.ndarray  # 257 x DIM; the last row is padding
    filter: np.ndarray  # WIDTH x DIM x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS + 1, the last the constant


def new_network(seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    f = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    byte = f(257, DIM) * 0.5
    byte[256] = 0
    return Network(byte, f(WIDTH, DIM, FILTERS) / np.float32(np.sqrt(WIDTH * DIM)), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS + 1, np.float32))


def _layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded to whole chunks, with one filter width between chunks overlapping: (symbols, chunks per text).

    A text of n bytes has ceil((n + WIDTH) / CHUNK) chunks. The filter positions of a chunk start in it and
    read on into the next, so nothing is missed at a border; the end of a text is followed by padding.
    """
    size = np.diff(offsets)
    chunks = -(-(size + WIDTH) // CHUNK)
    begin = np.concatenate([[0], np.cumsum(chunks * CHUNK)])
    symbols = np.full(int(begin[-1]) + WIDTH, 256, np.int32)
    text = np.repeat(np.arange(len(size)), size)
    symbols[np.arange(len(data)) + (begin[:-1] - offsets[:-1])[text]] = data
    return symbols, chunks


def _responses(net: Network, symbols: np.ndarray) -> np.ndarray:
    """Responses in chunks x positions x filters."""
    x = net.byte[symbols]
    n = (len(symbols) - WIDTH) // STEP
    pairs = x[: (n + WIDTH // STEP) * STEP].reshape(-1, STEP * DIM)
    w = net.filter.reshape(WIDTH // STEP, STEP * DIM, FILTERS)
    r = pairs[:n] @ w[0]
    for k in range(1, WIDTH // STEP):
        r += pairs[k : k + n] @ w[k]
    return r.reshape(-1, CHUNK // STEP, FILTERS)


def _pooled(net: Network, symbols: np.ndarray, chunks: np.ndarray) -> tuple:
    r = _responses(net, symbols)
    r[np.cumsum(chunks) - 1, 1 - WIDTH // STEP :] = 0  # padding; these positions would read the next text
    where = r.argmax(1)
    top = np.take_along_axis(r, where[:, None, :], 1)[:, 0, :] + net.bias
    act = np.tanh(top)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    most = np.maximum.reduceat(act, first)
    mean = np.add.reduceat(act, first) / chunks[:, None].astype(np.float32)
    return where, act, first, most, mean


def _logit(net: Network, most: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return most @ net.out[:FILTERS] + mean @ net.out[FILTERS:-1] + net.out[-1]


def scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    symbols, chunks = _layout(data, offsets)
    _, _, _, most, mean = _pooled(net, symbols, chunks)
    return 1 / (1 + np.exp(-_logit(net, most, mean).astype(np.float64)))


def _step(net: Network, data: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Network:
    """Gradient of the weighted log loss of a few texts."""
    symbols, chunks = _layout(data, offsets)
    where, act, first, most, mean = _pooled(net, symbols, chunks)
    p = 1 / (1 + np.exp(-_logit(net, most, mean)))
    d = ((p - label) * weight / len(label)).astype(np.float32)
    text = np.repeat(np.arange(len(chunks)), chunks)
    out = np.concatenate([d @ most, d @ mean, [d.sum()]]).astype(np.float32)
    is_top = (act == most[text]).astype(np.float32)
    is_top /= np.add.reduceat(is_top, first)[text]
    da = d[text, None] * (net.out[FILTERS:-1] / chunks[text, None] + net.out[:FILTERS] * is_top)
    dr = (da * (1 - act * act)).astype(np.float32)
    at = (np.arange(len(act)) * CHUNK)[:, None] + where * STEP
    byte, filt = np.zeros_like(net.byte), np.zeros_like(net.filter)
    for k in range(WIDTH):
        s = symbols[at + k]
        x = net.byte[s]
        filt[k] = np.einsum("cfd,cf->df", x, dr)
        np.add.at(byte, s, dr[:, :, None] * net.filter[k].T[None])
    byte[256] = 0
    return Network(byte, filt, dr.sum(0), out)


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 0) -> Network:
    """Adam on the log loss, classes weighted alike. Without both labels the network says 0.5 of everything."""
    net = new_network(seed)
    y = np.asarray(labels, np.float32)
    share = y.mean() if len(y) else 0
    if not 0 < share < 1:
        return net
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    rng = np.random.default_rng(seed)
    fields = ("byte", "filter", "bias", "out")
    m = {k: np.zeros_like(getattr(net, k)) for k in fields}
    v = {k: np.zeros_like(getattr(net, k)) for k in fields}
    size = np.array([len(t) for t in texts])
    step = 0
    while step < steps:
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH)[: steps - step]:
            some = order[k : k + BATCH]
            data = np.frombuffer(b"".join([texts[i] for i in some]), np.uint8)
            g = _step(net, data, np.concatenate([[0], np.cumsum(size[some])]), y[some], weight[some])
            step += 1
            rate = RATE * (1 - step / (steps + 1)) + 1e-5
            for f in fields:
                d = getattr(g, f)
                m[f] = 0.9 * m[f] + 0.1 * d
                v[f] = 0.99 * v[f] + 0.01 * d * d
                change = rate * (m[f] / (1 - 0.9**step)) / (np.sqrt(v[f] / (1 - 0.99**step)) + 1e-8)
                setattr(net, f, (getattr(net, f) - change).astype(np.float32))
    net.byte[256] = 0
    return net


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for the rows that are never learned from: crc32 of the id as text is a multiple of `folds`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and labels of at most `sample` rows outside the held-out fold, in the order of their ids.

    Of each label half the bound is taken, those with the smallest hash of the id. Ids with
    conflicting, odd or no labels are passed over. Only ids travel until the rows are chosen.
    """
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    marks = marks.filter(~held_out()).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("doc_id", "y")
    of = lambda y: marks.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
    chosen = [tuple(r) for y in (0, 1) for r in of(y).collect()]
    if not chosen:
        return [], np.zeros(0)
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, y int")  # bounded by `sample`
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    found = sorted((r.doc_id, r.text, r.y) for r in rows.collect())
    return [t.encode() for _, t, _ in found], np.array([y for _, _, y in found])


def scorer(net: Network):
    """A column function: text to probability of label 1. A null text is scored as an empty one."""

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        data, offsets = text_bytes(text)
        out = [scores(net, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in pieces(offsets, PART)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS, seed: int = 0) -> Network:
    return fit(*training_texts(docs, labels, sample), steps=steps, seed=seed)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    The score reads the whole text and nothing else. Null and empty texts are scored as empty; equal
    texts score alike; a null id is not held out. Without labels of both kinds every score is 0.5.
    """
    score = scorer(train(docs, labels, **how))
    out = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of `docs` that are not rejected, with their columns."""
    return docs.filter(scorer(train(docs, labels, **how))(F.col("text")) >= threshold)

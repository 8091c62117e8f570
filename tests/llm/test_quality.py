"""The byte network: gradients, coverage of whole texts, held-out accuracy, odd rows."""

import zlib

import numpy as np

from truegrain.llm import quality as q
from truegrain.llm.common import read


def batch(texts):
    size = np.cumsum([0, *map(len, texts)])
    return np.frombuffer(b"".join(texts), np.uint8), size


def test_gradient():
    net = q.new_network(3)
    net.out += np.random.default_rng(0).normal(0, 0.3, net.out.shape).astype(np.float32)
    data, offsets = batch([b"some words!! " * 90, b"plain"])
    y, w = np.array([0, 1], np.float32), np.ones(2, np.float32)

    def loss():
        p = q.scores(net, data, offsets)
        return -(np.log(1 - p[0]) + np.log(p[1])) / 2

    g = q._step(net, data, offsets, y, w)
    for name in ("byte", "filter", "bias", "out"):
        a, d = getattr(net, name), getattr(g, name)
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        keep, eps = a[at], 2e-3
        a[at] = keep + eps
        up = loss()
        a[at] = keep - eps
        down = loss()
        a[at] = keep
        assert abs((up - down) / (2 * eps) - d[at]) < 0.02 + 0.1 * abs(d[at]), name


def test_every_byte_counts():
    """A pattern is found wherever it stands, also across chunks and at the very end."""
    net = q.new_network(1)
    net.out[: q.FILTERS] = 1
    plain = bytes(97 for _ in range(3000))
    base = q.scores(net, *batch([plain]))[0]
    for at in (0, 511, 1023, 2047, 2990):
        changed = plain[:at] + b"!Z!Z!Z" + plain[at + 6 :]
        assert q.scores(net, *batch([changed]))[0] != base


def test_one_text_does_not_change_another():
    net = q.new_network(1)
    net.out[:] = 0.5
    a, b = b"abc " * 300, b"XYZ"
    both = q.scores(net, *batch([a, b, b""]))
    alone = [q.scores(net, *batch([t]))[0] for t in (a, b, b"")]
    assert np.allclose(both, alone, atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    got = q.scored(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = np.mean([r.predicted == r.quality for r in got])
    kept = np.mean([r.predicted for r in got if r.quality])
    assert right > 0.85 and kept > 0.85


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (1, None, 9.0), (2, "", 1.0), (None, "x", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    rows = q.scored(docs, labels).collect()
    assert [r.score for r in rows] == [0.5] * 4 and [r.predicted for r in rows] == [1] * 4
    assert q.scored(docs.limit(0), labels.limit(0)).collect() == []
    assert q.accepted(docs, labels).columns == docs.columns

"""Near-duplicate documents by DartMinHash over weighted word shingles.

A document is a weighted set: its runs of five words, each with the number of times it occurs. Every
element has a region of weight x rank, cut into cells of area one; a hash throws a Poisson number of
darts into each cell. The darts within a document's weights, of the lowest ranks, are hashed to the
coordinates of its signature, and the earliest per coordinate stays (Christiani, 2020). Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity, and a signature costs
time in proportion to the shingles, not to shingles times coordinates.

Signatures are joined in bands. What shares a band is verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegrain.functions.session import by_shuffle, materialised
from truegrain.llm.common import LOWER, mix, pieces, salted, shingles, text_bytes, uniform, word_hashes, words
from truegrain.operators.cluster import components
from truegrain.operators.pairs import bucket_links

#: Similarity from which documents are near duplicates; bands of the signature and coordinates per band.
SIMILAR, BANDS, ROWS = 0.8, 20, 5
#: Words per shingle, and bytes of text worked on at once.
WIDTH, PART = 5, 1 << 19
#: Chance of at most k darts in a cell of area one.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(18)])


def weighted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, text, count) of the distinct elements of each text, sorted within a text."""
    if len(hashes) == 0:
        return hashes, text, np.zeros(0, np.int64)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.concatenate([at, [len(h)]]))


def darts(element: np.ndarray, text: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dart, text, rank) of all darts within the weights of the elements and below each text's rank limit.

    Weights are cut into layers [2^v - 1, 2^(v+1) - 1), ranks within a layer into cells of area one.
    The darts of a cell depend on element, layer and cell alone, so they are the same in every text.
    """
    found: list[tuple] = []
    layer = 0
    some = np.arange(len(element))
    while len(some):
        width = float(2**layer)
        cells = np.maximum(np.ceil(limit[text[some]] * width), 1).astype(np.int64)
        who = np.repeat(some, cells)
        cell = np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells)
        h = mix(element[who] ^ salted(cell.astype(np.uint64), layer))
        count = np.searchsorted(_POISSON, uniform(h), side="right")
        keep = count > 0
        who, cell, h, count = who[keep], cell[keep], h[keep], count[keep]
        for k in range(int(count.max(initial=0))):
            more = count > k
            w, d = who[more], salted(h[more], k)
            rank = (cell[more] + uniform(salted(d, 1))) / width
            height = width - 1 + uniform(salted(d, 2)) * width
            inside = (rank < limit[text[w]]) & (height < weight[w])
            found.append((d[inside], text[w][inside], rank[inside]))
        layer += 1
        some = some[weight[some] > 2.0**layer - 1]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(element: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """n_texts x k earliest darts. Texts in which a coordinate stayed empty go again with twice the darts.

    A text without elements has a row of zeros, which must not be compared.
    """
    out = np.zeros((n_texts, k), np.uint64)
    total = np.bincount(text, weights=weight, minlength=n_texts)
    todo = np.flatnonzero(total > 0)
    aim = k * np.log(k) + 2 * k
    mine = np.ones(len(element), bool)
    while len(todo):
        limit = np.zeros(n_texts)
        limit[todo] = aim / total[todo]
        d, t, rank = darts(element[mine], text[mine], weight[mine], limit)
        slot = t * k + (salted(d, 3) % np.uint64(k)).astype(np.int64)
        late = np.argsort(rank, kind="stable")[::-1]
        earliest = np.full(n_texts * k, -1, np.int64)
        earliest[slot[late]] = late  # of several darts for a slot the last written, the earliest, stays
        slot = np.flatnonzero(earliest >= 0)
        d = d[earliest[slot]]
        full = np.bincount(slot // k, minlength=n_texts) == k
        done = full[slot // k]
        out.reshape(-1)[slot[done]] = d[done]
        todo = todo[~full[todo]]
        left = np.zeros(n_texts, bool)
        left[todo] = True
        mine = left[text]
        aim *= 2
    return out


def _elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[data]
    s, e, t = words(data, offsets)
    return weighted(*shingles(word_hashes(data, s, e), t, len(offsets) - 1, WIDTH))


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in pieces(offsets, PART):
                e, t, w = _elements(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                sig = signatures(e, t, w.astype(float), hi - lo, bands * rows).reshape(hi - lo, bands, rows)
                key = np.zeros((hi - lo, bands), np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                size = np.bincount(t, weights=w, minlength=hi - lo).astype(np.int64)
                flat = pa.array(key.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(size), lists], ["doc_id", "content", "size", "bands"])

    return run


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, content (digest of the text), size (shingles), bands (a key per band)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("content"))
    return d.mapInArrow(_sign(bands, rows), "doc_id long, content binary, size long, bands array<long>")


def _copies(element: np.ndarray, text: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-th copy of an element as an element of its own: weighted similarity becomes that of plain sets."""
    who = np.repeat(np.arange(len(element)), count)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    h, t = mix(element[who] ^ salted(nth.astype(np.uint64), 77)), text[who]
    order = np.lexsort((h, t))
    return h[order], t[order]


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for lo, hi in pieces(offsets, PART):
            h, t = _copies(*_elements(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            # half of the hash does for one document, and the differences of sorted values pack well
            cut = np.searchsorted(t, np.arange(hi - lo + 1))
            sets = [np.unique((h[x:y] >> np.uint64(24)).astype(np.uint64)) for x, y in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([_pack(x) for x in sets], pa.binary())], ["id", "set"])


def _pack(values: np.ndarray) -> bytes:
    """Sorted 40-bit numbers in five bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :5] = part
    return out.view("<u8").ravel()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [_unpack(x.as_buffer()).view(np.int64) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int64()))], ["id", "own", "tokens"])


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for x, y in zip(b.column(2), b.column(3)):
            p, q = _unpack(x.as_buffer()), _unpack(y.as_buffer())
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both) if len(p) + len(q) else 0.0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["id_a", "id_b", "similarity"])


def shingle_sets(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """id, set: the shingles of the texts in `firsts` (id, the text's digest; doc_id, one document that has it; n, its rows), 40 bits each.

    The texts are shuffled once at any size: the ids grow with them, and a broadcast of few ids would
    only be the plan of small inputs. Where one document has several rows of a text, one of them is taken.
    """
    body = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", body.alias("text"), F.unhex(F.md5(body)).alias("id"))
    once = d.join(firsts.filter("n = 1").select("doc_id", "id").hint("merge"), ["doc_id", "id"], "left_semi")
    more = d.join(firsts.filter("n > 1").select("doc_id", "id"), ["doc_id", "id"], "left_semi").dropDuplicates(["id"])
    return once.unionByName(more).select("id", "text").mapInArrow(_shingled, "id binary, set binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """id_a, id_b, similarity: weighted Jaccard over the shingles of whole texts, for distinct pairs of ids.

    A pair meets its sets in two equi-joins, which Spark splits where one document is in very many pairs.
    """
    left = pairs.join(sets.select(F.col("id").alias("id_a"), F.col("set").alias("set_a")), "id_a")
    both = left.join(sets.select(F.col("id").alias("id_b"), F.col("set").alias("set_b")), "id_b")
    return both.select("id_a", "id_b", "set_a", "set_b").mapInArrow(_similarity, "id_a binary, id_b binary, similarity double")


def candidate_links(firsts: DataFrame, docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """id_a, id_b, similarity of verified links between distinct texts that tie all groups together.

    `firsts` has a row per distinct text with words: id, doc_id, n, size, bands. A bucket is all texts with
    one key in one band. `bucket_links` compares its members with heads and contracts groups between
    rounds, so that no family of copies is paired up. Texts in buckets that hold several groups in the end are
    joined by their rarest shingles, which finds every link that is left between the groups.
    """
    members = firsts.select(F.posexplode("bands").alias("band", "key"), "id", "size")
    members = members.select(F.xxhash64("band", "key").alias("bucket"), "id", "size")
    n = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = materialised(members.join(n, "bucket"))
    sets = materialised(shingle_sets(docs, firsts.select("id", "doc_id", "n").join(members.select("id").distinct(), "id", "left_semi")))

    def whole(ids: DataFrame) -> DataFrame:
        return sets.join(by_shuffle(ids), "id").select("id", "own", "set").mapInArrow(_tokens, "id binary, own binary, tokens array<long>")

    return bucket_links(members, lambda pairs: verified(pairs, sets), similar, whole)


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id, group_id, kept, content.

    A document is an id with a text: rows equal in both are one, an id with several texts is several.
    class_id is the smallest id with the same text, group_id the smallest in the group of near
    duplicates (texts tied by links of at least `similar`); kept marks the one document that stands for
    its group, and content is the digest of its text. Texts without words, null ones included, are near
    nothing: each is its own group. Rows with a null id are left out of the search; each is a row with
    null class and group, kept. Other columns are not read. An empty table gives no rows.
    """
    named = signed(docs.filter("doc_id is not null"), bands, rows)
    # one text has one signature, so of the rows of a document any will do
    names = named.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    names = materialised(names)
    # written first, so that the join with a text that very many rows share can be split by Spark
    classes = materialised(names.filter("size > 0").groupBy("content").agg(F.min("doc_id").alias("class_id")))
    with_words = names.filter("size > 0").join(classes, "content")
    firsts = materialised(with_words.filter("doc_id = class_id").withColumnRenamed("content", "id"))
    groups = components(candidate_links(firsts, docs, similar)).select(F.col("member").alias("content"), F.col("cluster_id").alias("lead"))
    lead = materialised(classes.join(groups, "content", "left").select("content", "class_id", F.coalesce("lead", "content").alias("lead")))
    # of a group the text of the smallest id stays, of several such the one of the smallest digest
    best = lead.groupBy("lead").agg(F.min(F.struct("class_id", "content")).alias("best"))
    lead = materialised(lead.join(best, "lead").select("content", "class_id", F.col("best.class_id").alias("group_id"), (F.col("content") == F.col("best.content")).alias("leads")))
    told = names.select("doc_id", "content", "size").join(lead, "content", "left")
    kept = F.when(F.col("size") > 0, F.col("leads") & (F.col("doc_id") == F.col("group_id"))).otherwise(True)
    found = told.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "doc_id").alias("group_id"), kept.alias("kept"), "content")
    none = F.lit(None).cast("long")
    lost = docs.filter("doc_id is null").select(none.alias("doc_id"), none.alias("class_id"), none.alias("group_id"), F.lit(True).alias("kept"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("content"))
    return found.unionByName(lost)


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, one document of each group of near duplicates, with all their columns.

    A document is an id with a text. Rows with a null id stay, as do texts without words; of rows equal in id
    and text one stays, whichever other columns it has. An empty table gives an empty one.
    """
    body = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    gone = near_duplicates(docs, **how).filter("not kept").select(F.col("doc_id").alias("_gone"), F.col("content").alias("_what"))
    repeated = docs.filter("doc_id is not null").groupBy("doc_id", body.alias("_what")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    gone, repeated = materialised(gone), materialised(repeated.select(F.col("doc_id").alias("_gone"), "_what"))
    on = (F.col("doc_id") == F.col("_gone")) & (body == F.col("_what"))
    kept = docs.join(gone.unionByName(repeated), on, "left_anti")
    more = docs.join(repeated.join(gone, ["_gone", "_what"], "left_anti"), on, "left_semi").withColumn("_what", body)
    return kept.unionByName(more.dropDuplicates(["doc_id", "_what"]).drop("_what"))

"""Alignment of two tokenizers by interval coalescing, with corpus-wide counts of the links.

Both tokenizers cut the same bytes. All tokens of both are sorted by their start and the running maximum
of their ends is taken: where a start reaches the maximum, no token crosses and a group begins. Within a
group the overlapping pairs are the links.

A text is encoded once. Texts are worked on in tiles of bounded size; a tile tells the corpus how many of
its documents hold each pair of linked ids, counts are added up per pair, and each tile gets back the
counts of its own pairs. So a pair that nearly every document holds costs one row per tile, not per document.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegrain.functions.session import materialised
from truegrain.llm.common import pieces, text_bytes

#: Bytes of text in a tile, and of a stretch of a long text that is encoded at once.
TILE, STRETCH = 1 << 20, 1 << 18
#: Tiles in a row group of the written table.
GROUP = 8
#: A space between letters: neither tokenizer has a token that crosses into it from the left.
_CUT = regex.compile(r"(?<=[a-z])(?= [a-z])")
_BYTE = regex.compile(r"<0x([0-9A-F]{2})>")


class Tokenizer:
    """ids of texts, and of every id its bytes, their number, and its decimal form with a separator."""

    def __init__(self, tokens: list[bytes], encode):
        self.bytes, self.encode = tokens, encode
        self.length = np.array([len(t) for t in tokens], np.int64)


def _byte_letters() -> dict[str, int]:
    """The byte that each printable letter stands for: itself where printable, else numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@cache
def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE file; strings of special tokens in a text are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer as Library

    lib = Library.from_file(path)
    lib.encode_special_tokens = True
    letter = _byte_letters()
    tokens = [bytes(letter[c] for c in lib.id_to_token(i) if c in letter) for i in range(lib.get_vocab_size())]
    return Tokenizer(tokens, lambda texts: [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)])


@cache
def piece_level(path: str) -> Tokenizer:
    """A model of pieces with byte fallback, which itself puts a space before a text."""
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(lib.get_piece_size()):
        piece = lib.id_to_piece(i)
        tokens.append(bytes([int(_BYTE.fullmatch(piece)[1], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else piece.replace("▁", " ").encode())
    return Tokenizer(tokens, lambda texts: lib.encode(texts, num_threads=1))


def _stretches(text: str) -> list[str]:
    """A long text, cut before spaces between small letters, about STRETCH characters each; one without such a place stays whole."""
    if len(text) <= STRETCH:
        return [text]
    out, at = [], 0
    while at < len(text):
        place = _CUT.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = place.start() if place else len(text)
        out.append(text[at:end])
        at = end
    return out


def encode(a: Tokenizer, b: Tokenizer, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(A's ids, B's ids) of a space and each text; both empty where a text is, or where either side's bytes are others."""
    cut = [_stretches(t) for t in texts]
    flat = [s for some in cut for s in some]
    # a stretch after the first begins with the space that B puts before a text by itself
    first = [k == 0 for some in cut for k in range(len(some))]
    of_a = a.encode([" " + s if f else s for s, f in zip(flat, first)])
    of_b = b.encode([s if f else s[1:] for s, f in zip(flat, first)])
    out, at = [], 0
    for text, some in zip(texts, cut):
        x = [i for ids in of_a[at : at + len(some)] for i in ids]
        y = [i for ids in of_b[at : at + len(some)] for i in ids]
        at += len(some)
        whole = b" " + text.encode()
        same = text and b"".join([a.bytes[i] for i in x]) == whole and b"".join([b.bytes[i] for i in y]) == whole
        out.append((np.array(x, np.int64), np.array(y, np.int64)) if same else (np.zeros(0, np.int64),) * 2)
    return out


def coalesced(la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(side, place, group) of all tokens of both sides, sorted by start; `la` and `lb` are their lengths.

    A group begins where a start reaches the running maximum of the ends before it.
    """
    ea, eb = np.cumsum(la), np.cumsum(lb)
    start, end = np.concatenate([ea - la, eb - lb]), np.concatenate([ea, eb])
    side = np.repeat([0, 1], [len(la), len(lb)])
    place = np.concatenate([np.arange(len(la)), np.arange(len(lb))])
    order = np.lexsort((side, start))
    s, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] >= reach[:-1]
    return side[order], place[order], np.cumsum(new) - 1


def links(la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in A, place in B) of all pairs whose byte ranges overlap, in order."""
    ea, eb = np.cumsum(la), np.cumsum(lb)
    lo = np.searchsorted(eb, ea - la, side="right")
    hi = np.searchsorted(eb - lb, ea, side="left")
    n = hi - lo
    i = np.repeat(np.arange(len(la)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]


def _written(names: np.ndarray, x: np.ndarray, y: np.ndarray, side: np.ndarray, place: np.ndarray, group: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2`: the groups in order, first A's ids, then B's. names: ids with ',', '|' and ';' after them."""
    order = np.lexsort((place, side, group))
    side, place, group = side[order], place[order], group[order]
    ids = np.where(side == 0, x[np.minimum(place, len(x) - 1)], y[np.minimum(place, len(y) - 1)])
    last = np.ones(len(ids), bool)
    last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    kind = np.where(last, 1 + side, 0)
    return "".join(names[kind, ids].tolist())[:-1].encode()


@cache
def _names(n: int) -> np.ndarray:
    return np.array([[f"{i}{c}" for i in range(n)] for c in ",|;"], object)


def _tiled(a_name: str, b_name: str, tile: int, texts_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(SparkFiles.get(a_name)), piece_level(SparkFiles.get(b_name))
        names = _names(max(len(a.bytes), len(b.bytes)))
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in pieces(offsets, tile):
                texts = [t or "" for t in batch.column(1)[lo:hi].to_pylist()]
                n_a, n_b, n_groups, n_links, sha, wrote, codes, times = ([] for _ in range(8))
                for x, y in encode(a, b, texts):
                    la, lb = a.length[x], b.length[y]
                    side, place, group = coalesced(la, lb)
                    i, j = links(la, lb)
                    # a pair of ids as one number
                    pair, n = np.unique(x[i] << 32 | y[j], return_counts=True)
                    text = _written(names, x, y, side, place, group) if len(x) else b""
                    n_a.append(len(x)), n_b.append(len(y)), n_groups.append(int(group[-1]) + 1 if len(group) else 0), n_links.append(len(i))
                    sha.append(hashlib.sha256(text).hexdigest() if len(x) else "")
                    wrote.append(text.decode())
                    codes.append(pair), times.append(n)
                every, where = np.unique(np.concatenate(codes), return_inverse=True)
                held = np.bincount(where, minlength=len(every))
                stops = np.cumsum([0, *[len(c) for c in codes]]).astype(np.int32)
                big = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind))
                cells = [
                    pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0)[lo:hi]),
                    big(n_a, pa.int64()), big(n_b, pa.int64()), big(n_groups, pa.int64()), big(n_links, pa.int64()), big(sha, pa.string()),
                    big(wrote if texts_out else [], pa.string()), big(every, pa.int64()), big(held, pa.int32()),
                    big(stops, pa.int32()), big(where.astype(np.int32), pa.int32()), big(np.concatenate(times).astype(np.int32), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(cells, _TILE)
                number += 1

    return run


_TILE = ["tile", "ids", "n_a", "n_b", "n_groups", "n_links", "sha", "groups", "pair", "held", "stops", "which", "times"]
_TILE_KINDS = ["long", "array<long>", "array<long>", "array<long>", "array<long>", "array<long>", "array<string>", "array<string>", "array<long>", "array<int>", "array<int>", "array<int>", "array<int>"]


def _answered(group: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of one tile, with their links weighed by the counts of the tile's pairs."""
    out = []
    place, n_held, is_best = (known.column(c).to_numpy() for c in ("place", "n", "best"))
    for b in group.combine_chunks().to_batches():
        for k in range(b.num_rows):
            cell = lambda c, k=k, b=b: b.column(c)[k].values.to_numpy(zero_copy_only=False)
            ids = b.column("ids")[k].values
            stops, which, times = cell("stops"), cell("which"), cell("times").astype(np.int64)
            count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            count[place], best[place] = n_held, is_best
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[stops])
            n = len(stops) - 1
            groups = b.column("groups")[k].values if len(b.column("groups")[k].values) else pa.nulls(n, pa.string())
            cols = [ids, *[b.column(c)[k].values for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(total(best[which] * times)), pa.array(total(count[which] * times)), b.column("sha")[k].values, groups]
            out.append(pa.Table.from_arrays(cols, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]))
    return pa.concat_tables(out)


def pair_counts(tiles: DataFrame) -> DataFrame:
    """pair, n, best: how many documents hold a pair of ids linked, and whether this is the most of its A id."""
    held = tiles.select(F.inline(F.arrays_zip("pair", "held")))
    counts = materialised(held.groupBy("pair").agg(F.sum("held").alias("n")))
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text", with_groups: bool = True, tile: int = TILE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups (the alignment as text).

    A is a byte-level BPE file that encodes a space and the text, B a model of pieces that adds the space.
    A group is a stretch of bytes at whose ends tokens of both end; links are overlapping pairs of tokens.
    The count of a pair of ids is the number of rows, corpus-wide, that hold it linked; n_best are the links
    whose count is the highest of their A id, count_sum the counts over all links. Null and empty texts, and
    texts that either tokenizer changes, have no tokens: zeros, and '' as groups_sha256. Rows with one id,
    a null one included, are rows of their own. Other columns are not read. An empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    sc.addFile(path_a), sc.addFile(path_b)
    run = _tiled(path_a.rsplit("/", 1)[-1], path_b.rsplit("/", 1)[-1], tile, with_groups)
    schema = ", ".join(f"{n} {k}" for n, k in zip(_TILE, _TILE_KINDS))
    # Spark reads a row group of lists at once, so a group holds few tiles
    tiles = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
    tiles = materialised(tiles, **{"parquet.block.row.count.limit": GROUP})
    asked = materialised(tiles.select("tile", F.posexplode("pair").alias("place", "pair")))
    answer = asked.join(pair_counts(tiles), "pair").select("tile", "place", "n", "best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    # the counts go to their tile as rows that are sorted on disk, not gathered as lists of many tiles at once
    found = tiles.drop("pair", "held").groupBy("tile").cogroup(answer.groupBy("tile")).applyInArrow(_answered, out)
    return found.withColumnRenamed("doc_id", id_col) if with_groups else found.drop("groups").withColumnRenamed("doc_id", id_col)

"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A piece starts as one symbol per byte. Each pair of neighbours is a leaf whose key is the rank of
its merge and then its place, so the root of a tree of minima is the leftmost pair of the lowest
rank. Merging it changes at most three leaves, whose paths to the root are recomputed; this goes
on until the root holds no mergeable pair. The trees of all distinct pieces of a part of the input
are kept side by side in arrays, so a step serves every piece at once.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from truegrain.llm.common import pieces, text_bytes

#: Bytes of text whose distinct words are encoded together, and symbols in the trees of one step.
PART, SYMBOLS = 8 << 20, 1 << 20
NONE = np.int64(2**62)
#: White space of the tokenizer's patterns, as a character class.
WHITE = r"\t-\r\x20\x85\xA0  -     　"
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_UNSPACED = regex.compile(f"[^{WHITE}]+")


class Vocabulary:
    """A tokenizer file of kind BPE with word ends, lower case and white space dropped.

    Read from the file: tokens, merges, the suffix of word ends, the pattern of pieces and the
    special tokens. Merges become one sorted array of pair codes with their rank and result.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.tokens = [""] * self.size
        for token, i in {**vocab, **special}.items():
            self.tokens[i] = token
        self.special = special
        self.splits = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(pattern.replace(r"\s", WHITE)).findall
        letter = _byte_letters()
        self.inner = np.array([vocab[c] for c in letter], np.int64)
        self.last = np.array([vocab[c + end] for c in letter], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank, self.result = code[order], order.astype(np.int64), result[order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NONE if it never merges, and the place of its merge."""
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], NONE), at


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + n))
        n += b not in plain
    return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _merge(v: Vocabulary, symbols: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Merge all rows of `symbols` (each with `count` symbols, width a power of two); -1 where one is gone."""
    rows, width = symbols.shape
    place = np.arange(width)
    follow = np.broadcast_to(place + 1, (rows, width)).copy()
    before = np.broadcast_to(place - 1, (rows, width)).copy()
    tree = np.full((rows, 2 * width), NONE, np.int64)
    rank, _ = v.ranks(symbols[:, :-1], symbols[:, 1:])
    pair = place[1:] < count[:, None]
    tree[:, width : 2 * width - 1] = np.where(pair & (rank < NONE), rank * width + place[:-1], NONE)
    w = width // 2
    while w:
        np.minimum(tree[:, 2 * w : 4 * w : 2], tree[:, 2 * w + 1 : 4 * w : 2], out=tree[:, w : 2 * w])
        w //= 2
    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        i = tree[live, 1] % width
        j = follow[live, i]
        _, at = v.ranks(symbols[live, i], symbols[live, j])
        symbols[live, i] = v.result[at]
        symbols[live, j] = -1
        after = follow[live, j]
        follow[live, i] = after
        right = after < count[live]
        before[live[right], after[right]] = i[right]
        tree[live, width + j] = NONE
        new = np.full(len(live), NONE, np.int64)
        r, _ = v.ranks(symbols[live[right], i[right]], symbols[live[right], after[right]])
        new[right] = np.where(r < NONE, r * width + i[right], NONE)
        tree[live, width + i] = new
        b = before[live, i]
        left = b >= 0
        r, _ = v.ranks(symbols[live[left], b[left]], symbols[live[left], i[left]])
        tree[live[left], width + b[left]] = np.where(r < NONE, r * width + b[left], NONE)
        for rows_of, leaf in ((live, i), (live, j), (live[left], b[left])):
            node = (width + leaf) >> 1
            while len(node) and node[0]:
                tree[rows_of, node] = np.minimum(tree[rows_of, 2 * node], tree[rows_of, 2 * node + 1])
                node = node >> 1
        live = live[tree[live, 1] < NONE]
    return symbols


def encode_pieces(v: Vocabulary, texts: list[str]) -> list[list[int]]:
    """Token ids of each piece: its bytes, the last with the word end, merged as far as they go."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    out: list[list[int]] = [[]] * len(raw)
    wide = 2 ** np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
    for width in np.unique(wide):
        chosen = np.flatnonzero(wide == width)
        step = max(1, SYMBOLS // int(width))
        for k in range(0, len(chosen), step):
            part = chosen[k : k + step]
            n = size[part]
            flat = np.frombuffer(b"".join([raw[p] for p in part]), np.uint8)
            symbols = np.full((len(part), int(width)), -1, np.int64)
            filled = np.arange(width) < n[:, None]
            symbols[filled] = v.inner[flat]
            ends = np.cumsum(n) - 1
            symbols[np.arange(len(part)), n - 1] = v.last[flat[ends]]
            done = _merge(v, symbols, n)
            kept = done >= 0
            ids, stop = done[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
            start = 0
            for p, e in zip(part.tolist(), stop):
                out[p] = ids[start:e]
                start = e
    return out


def _normal(text: str) -> str:
    """NFC and lower case, letter by letter (no rule for a word-final sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def _words(text: str) -> list[str]:
    """Split at white space. str.split also splits at four control characters that are no white space here."""
    return _UNSPACED.findall(text) if _SEPARATORS.search(text) else text.split()


def _spans(v: Vocabulary, text: str) -> Iterator[tuple[str, bool]]:
    """The text between special tokens, and these."""
    if v.splits is None or not any(s in text for s in v.special):
        yield text, False
    else:
        for k, part in enumerate(v.splits.split(text)):
            yield part, k % 2 == 1


def _encode(v: Vocabulary, texts: list[str], write) -> list:
    """write(ids as text, tokens as text) of every text; distinct words are encoded once."""
    words: dict[str, None] = {}
    for t in texts:
        for part, special in _spans(v, t):
            if not special:
                words.update(dict.fromkeys(_words(_normal(part))))
    cut = {w: v.piece(w) for w in words}
    each = list(dict.fromkeys(p for ps in cut.values() for p in ps))
    ids_of = dict(zip(each, encode_pieces(v, each)))
    as_ids, as_tokens = {}, {}
    for w, ps in cut.items():
        ids = [i for p in ps for i in ids_of[p]]
        as_ids[w] = " ".join(map(str, ids))
        as_tokens[w] = " ".join([v.tokens[i] for i in ids])
    out = []
    for t in texts:
        ids, tokens = [], []
        for part, special in _spans(v, t):
            if special:
                ids.append(str(v.special[part]))
                tokens.append(part)
            else:
                found = _words(_normal(part))
                ids += map(as_ids.__getitem__, found)
                tokens += map(as_tokens.__getitem__, found)
        if "" in ids:  # a word of control characters alone can be without tokens
            ids, tokens = [x for x in ids if x], [x for x in tokens if x]
        out.append(write(" ".join(ids), " ".join(tokens)))
    return out


def decode(v: Vocabulary, ids: list[int]) -> str:
    """As the file has no decoder, tokens are joined by spaces, special ones included."""
    return " ".join([v.tokens[i] for i in ids])


def _digests(ids: str, tokens: str) -> tuple:
    return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()


def _texts(ids: str, tokens: str) -> tuple:
    return [int(x) for x in ids.split(" ")] if ids else [], tokens


def _ids(ids: str, tokens: str) -> tuple:
    found = np.fromstring(ids, np.int32, sep=" ")  # four bytes a token; a list of numbers takes ten times that
    return len(found), found


def _mapped(df: DataFrame, path: str, id_col: str, text: str, write, names: list[str], kinds: list, part: int = PART) -> DataFrame:
    """Apply write() to every text of `df`; the vocabulary travels with the job as a file."""
    sc = df.sparkSession.sparkContext
    sc.addFile(path)
    name = path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(SparkFiles.get(name))
        for b in batches:
            _, offsets = text_bytes(b.column(1))
            for lo, hi in pieces(offsets, part):
                texts = [t or "" for t in b.column(1)[lo:hi].to_pylist()]
                columns = list(zip(*_encode(v, texts, write))) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *[pa.array(c, k) for c, k in zip(columns, kinds)]], [id_col, *names])

    schema = T.StructType([df.schema[id_col]])
    for n, k in zip(names, kinds):
        schema.add(n, T.ArrayType(T.IntegerType()) if pa.types.is_list(k) else T.LongType() if k == pa.int64() else T.StringType())
    return df.select(f"`{id_col}`", f"`{text}`").mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of token ids), decoded (their tokens as text) for every row of `docs`.

    A null text counts as empty and has no tokens. Rows with equal ids are rows of their own. Other
    columns are not read. Strings of special tokens in a text are those tokens.
    """
    return _mapped(docs, path, id_col, text, _texts, ["ids", "decoded"], [pa.list_(pa.int32()), pa.string()])


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids: as encoded(), without the decoded text."""
    return _mapped(docs, path, id_col, text, _ids, ["n_tokens", "ids"], [pa.int64(), pa.list_(pa.int32())], PART // 8)


def encoded_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encoded(), with the results hashed where they are made."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _mapped(docs, path, id_col, text, _digests, names, [pa.int64(), pa.string(), pa.string()])

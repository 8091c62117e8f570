"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate spans, by what the span is made of and what stands before it, and a
dynamic program over a window picks boundaries and types together. It is trained on windows around
what the fixed patterns find in a bounded sample of texts, on variants of these that the patterns
miss (a phone without plus sign, a card in groups), and on credentials; everything else in the
windows teaches it what to leave alone. Windows are where digits or an @ stand (every candidate span
has a digit), so words of plain prose cost nothing.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegrain.llm.common import pieces, text_bytes

#: Fixed patterns and the order of the kinds; `secret` is found by the field alone.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret")

#: Tokens of a candidate span at most, texts of the training sample, weight of a margin for adding a span.
LONGEST, SAMPLE, MARGIN = 12, 2000, 2.0
PART = 1 << 19
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_AT = np.zeros(256, bool)
_AT[64] = True
_NUMBER = _DIGIT.copy()
_NUMBER[[ord(c) for c in "+-(). "]] = True
_ADDRESS = np.zeros(256, bool)
_ADDRESS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@"]] = True

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _holds(kind: int, s: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    d = _digits(s) if kind > 1 else ""
    return kind == 0 or (14 <= len(d) <= 19 and luhn(d) if kind == 2 else 10 <= len(d) <= 15)


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find in a whole text: leftmost, without overlap per kind, failing matches dropped."""
    found = [(m.start(), m.end(), k) for k, p in enumerate((EMAIL, IP, CARD, PHONE)) for m in p.finditer(text) if _holds(k, m.group())]
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


# Windows -----------------------------------------------------------------------------------------

def _runs(inside: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of `inside` that hold a seed."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    lo, hi = edge[::2], edge[1::2]
    has = np.unique(np.searchsorted(lo, seeds, side="right") - 1)
    return lo[has], hi[has]


def _spots(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of byte ranges, disjoint and in order, outside which no entity can lie.

    A range holds whole runs of the characters of numbers or addresses, so a fixed pattern finds in
    it just what it finds there in the whole text.
    """
    found = []
    for inside, seed in ((_NUMBER, _DIGIT), (_ADDRESS, _AT)):
        at = np.flatnonzero(seed[data])
        if len(at):
            found.append(np.stack(_runs(inside[data], at), 1))
    whole = data.tobytes()
    if not found:
        return []
    spans = np.concatenate(found)
    first = np.searchsorted(offsets, spans[:, 0], side="right") - 1
    last = np.searchsorted(offsets, spans[:, 1] - 1, side="right") - 1
    out = []
    for (lo, hi), a, b in zip(spans.tolist(), first.tolist(), last.tolist()):
        for t in range(a, b + 1):  # a run may cross from one text into the next
            start, stop = int(offsets[t]), int(offsets[t + 1])
            if max(lo, start) < min(hi, stop):
                out.append((t, *_widen(whole, max(lo, start), min(hi, stop), start, stop)))
    out.sort()
    joined: list[tuple[int, int, int]] = []
    for t, lo, hi in out:
        if joined and joined[-1][0] == t and lo <= joined[-1][2]:
            joined[-1] = (t, joined[-1][1], max(joined[-1][2], hi))
        else:
            joined.append((t, lo, hi))
    return joined


_WHITE = frozenset(b" \t\n\v\f\r")


def _widen(data: bytes, lo: int, hi: int, start: int, stop: int) -> tuple[int, int]:
    """To whole words, and to the two words before and the two after."""
    for _ in range(3):
        while lo > start and data[lo - 1] in _WHITE:
            lo -= 1
        while lo > start and data[lo - 1] not in _WHITE:
            lo -= 1
    for _ in range(3):
        while hi < stop and data[hi] in _WHITE:
            hi += 1
        while hi < stop and data[hi] not in _WHITE:
            hi += 1
    return lo, hi


# The field ---------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z0-9]+|\s+|[^A-Za-z0-9\s]")


def _bucket(n: int) -> str:
    return str(n) if n < 4 else f"{4 * (n // 4)}+" if n < 40 else "40+"


def _shape(s: str) -> str:
    """The sorts of characters in order, repeats dropped: digits 9, letters a and A, others as they are."""
    return re.sub(r"(.)\1+", r"\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s))))[:24]


def span_features(s: str, before: str, after: str) -> list[str]:
    """What a whole candidate span looks like, and what is around it."""
    digits = _digits(s)
    letters = sum(c.isalpha() for c in s)
    groups = len(re.findall("[0-9]+", s))
    mixed = len(s) >= 12 and s.isalnum() and 0 < len(digits) < len(s)
    f = [
        "shape code" if mixed else f"shape {_shape(s)}" if groups < 6 else "shape many",
        f"digits {_bucket(len(digits))}",
        f"letters {_bucket(letters)}",
        f"groups {_bucket(groups)}",
        f"before {before}",
        f"after {after[:1] if after[:1] in '.,;:)' else 'other' if after[:1].strip() else 'space'}",
        f"first {s[0] if not s[0].isalnum() else 'digit' if s[0].isdigit() else 'letter'}",
        f"last {s[-1] if not s[-1].isalnum() else 'digit' if s[-1].isdigit() else 'letter'}",
    ]
    if 12 <= len(digits) <= 19 and not letters:
        f.append("luhn" if luhn(digits) else "no luhn")
    if letters == 0 and s.count(".") == 3 and _holds_ip(s):
        f.append("octets")
    if "@" in s:
        f.append("one at" if s.count("@") == 1 and "." in s.partition("@")[2] else "odd at")
    if not letters and groups < 6:
        f.append("lengths " + re.sub("[0-9]+", lambda m: _bucket(len(m.group())), s))
    if mixed:
        f += ["hex" if re.fullmatch("[0-9a-f]+", s) else "upper" if s.isupper() else "mixed", f"length {_bucket(len(s))}"]
        if s.isupper():
            f.append(f"prefix {s[:4]}")
    return f


def _holds_ip(s: str) -> bool:
    return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s) is not None and all(int(p) <= 255 for p in s.split("."))


def candidates(window: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, features) of the spans of at most LONGEST tokens that may be an entity.

    A span begins with a letter, digit, + or (, ends with a letter or digit, has a digit, cuts no word,
    and holds single spaces only between numbers.
    """
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(window)]
    out = []
    for i, (lo, _, first) in enumerate(tokens):
        if not (first.isascii() and (first[0].isalnum() or first in "+(")) or (lo and window[lo - 1].isalnum()):
            continue
        digit = letter = spaced = False
        before = None
        for _, hi, t in tokens[i : i + LONGEST]:
            if t == " " and not letter:
                spaced = True
                continue
            if not (t.isascii() and (t.isalnum() or t in "._%+-@()")) or (spaced and t.isalnum() and not t.isdigit()):
                break
            letter |= t.isalnum() and not t.isdigit()
            digit |= any(c.isdigit() for c in t)
            if digit and t[-1].isalnum() and (hi == len(window) or not window[hi].isalnum()):
                before = _before(window, lo) if before is None else before
                out.append((lo, hi, span_features(window[lo:hi], before, window[hi : hi + 1])))
    return out


def _before(window: str, at: int) -> str:
    """The announcing word before a place, also across = : and quotes; `other` if there is none."""
    m = re.search(r"([A-Za-z]+)[\s=:\"']*$", window[max(0, at - 24) : at])
    word = m.group(1).lower() if m else ""
    return word + m.group()[len(word) :].replace(" ", "") if _announces(word) else "other"


def _announces(word: str) -> bool:
    return word in ("password", "passwd", "secret", "token", "key", "apikey", "tel", "phone", "mail", "email", "card", "ip")


Weights = dict[str, np.ndarray]  # per feature a weight for each kind


def _scores(w: Weights, features: list[str]) -> np.ndarray:
    out = np.zeros(len(KINDS))
    for f in features:
        v = w.get(f)
        if v is not None:
            out += v
    return out


def best_spans(w: Weights, window: str, margin: float = 0.0) -> list[Span]:
    """The most likely segmentation of a window: typed entities of bounded length, and single characters of no type.

    best[k] is the score of the best segmentation of the first k characters; a candidate ending at k
    continues best at its start. Text of no type scores 0, so only ends of candidates are visited.
    """
    spans = candidates(window)
    if not spans:
        return []
    by_end: dict[int, list] = {}
    for lo, hi, f in spans:
        by_end.setdefault(hi, []).append((lo, _scores(w, f) - margin))
    ends = sorted(by_end)
    best, back = [0.0], [None]
    at = [0]
    for hi in ends:
        top, how = best[-1], None
        for lo, s in by_end[hi]:
            k = int(s.argmax())
            total = best[bisect_right(at, lo) - 1] + s[k]
            if total > top:
                top, how = total, (lo, hi, k)
        at.append(hi)
        best.append(top)
        back.append(how)
    out, k = [], len(at) - 1
    while k > 0:
        if back[k] is None:
            k -= 1
        else:
            out.append(back[k])
            k = bisect_right(at, back[k][0]) - 1
    return out[::-1]


def _expected(w: Weights, spans: list) -> tuple[float, np.ndarray]:
    """Log partition function over segmentations, and for every candidate and kind its probability."""
    points = sorted({0, *[x for lo, hi, _ in spans for x in (lo, hi)]})
    place = {x: i for i, x in enumerate(points)}
    n = len(points)
    s = np.array([_scores(w, f) for _, _, f in spans])
    into, outof = [[] for _ in range(n)], [[] for _ in range(n)]
    for c, (lo, hi, _) in enumerate(spans):
        into[place[hi]].append((place[lo], c))
        outof[place[lo]].append((place[hi], c))
    all_of = np.logaddexp.reduce(s, 1)
    fwd, bwd = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        fwd[i] = np.logaddexp.reduce([fwd[i - 1], *[fwd[j] + all_of[c] for j, c in into[i]]])
    for i in range(n - 2, -1, -1):
        bwd[i] = np.logaddexp.reduce([bwd[i + 1], *[bwd[j] + all_of[c] for j, c in outof[i]]])
    z = fwd[-1]
    p = np.array([np.exp(fwd[place[lo]] + s[c] + bwd[place[hi]] - z) for c, (lo, hi, _) in enumerate(spans)])
    return z, p


def fit(windows: list[tuple[str, list[Span]]], passes: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 0) -> Weights:
    """Weights per feature and kind that maximise the likelihood of the marked spans, by adaptive gradient steps."""
    w: Weights = {}
    seen: dict[str, np.ndarray] = {}
    ready = [(candidates(t), {(lo, hi): k for lo, hi, k in gold}) for t, gold in windows]
    ready = [(c, g) for c, g in ready if c]
    for c, _ in ready:
        for _, _, f in c:
            for x in [*f, "bias"]:
                w.setdefault(x, np.zeros(len(KINDS)))
    for x in w:
        w[x] = w[x] - 1.0 if x == "bias" else w[x]
        seen[x] = np.full(len(KINDS), 1e-6)
    ready = [([(lo, hi, [*f, "bias"]) for lo, hi, f in c], g) for c, g in ready]
    rng = random.Random(seed)
    for _ in range(passes):
        rng.shuffle(ready)
        for c, gold in ready:
            _, p = _expected(w, c)
            g = -p
            for k, (lo, hi, _) in enumerate(c):
                if (lo, hi) in gold:
                    g[k, gold[lo, hi]] += 1
            for k in np.flatnonzero(np.abs(g).max(1) > 1e-4):
                for x in c[k][2]:
                    d = g[k] - decay * w[x]
                    seen[x] += d * d
                    w[x] = w[x] + rate * d / np.sqrt(seen[x])
    return w


def _variants(rng: random.Random) -> tuple[str, list[Span]]:
    """A made-up window with an entity the fixed patterns miss, a credential, or a number that is none."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghilmnorstu", k=rng.randrange(2, 9)))
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    sort = rng.randrange(9)
    lead = f"{word()} {word()} "
    if sort == 0:
        s, k = f"({d(3)}) {d(3)}-{d(4)}", 3
    elif sort == 1:
        s, k = f"{d(3)}-{d(3)}-{d(4)}", 3
    elif sort == 2:
        s, k = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567890", k=15)) + d(1), 4
    elif sort == 3:
        lead, s, k = f"{word()} password=", hexes(17) + d(1), 4
    elif sort == 4:
        lead, s, k = f'{word()} token = "', hexes(39) + d(1), 4
    elif sort == 5:
        s, k = f"{rng.randrange(1, 9)}.{rng.randrange(10)}", None
    elif sort == 6:
        s, k = d(rng.randrange(1, 9)), None
    elif sort == 7:
        s, k = f"{d(rng.randrange(1, 3))},{d(3)}.{d(2)}", None
    else:
        s, k = f"{rng.randrange(1900, 2030)}-{d(2)}-{d(2)}", None
    end = '"' if sort == 4 else rng.choice(["", ".", ","])
    return f"{lead}{s}{end} {word()} {word()}", [] if k is None else [(len(lead), len(lead) + len(s), k)]


#: Credentials that mark training windows.
_SECRET = re.compile(r"\b(?:password=|token = \"|(?=AKIA))((?=[A-Za-z]*[0-9])[A-Za-z0-9]{16,})")


def _windows(texts: list[str]) -> list[str]:
    raw = [t.encode() for t in texts]
    whole = b"".join(raw)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return [whole[lo:hi].decode() for _, lo, hi in _spots(np.frombuffer(whole, np.uint8), offsets)]


def _marked(window: str) -> list[Span]:
    """What a training window teaches: base spans without overlap, and credentials."""
    gold: list[Span] = []
    secrets = [(m.start(1), m.end(1), 4) for m in _SECRET.finditer(window)]
    for lo, hi, k in sorted([*base_spans(window), *secrets]):
        if not gold or lo >= gold[-1][1]:
            gold.append((lo, hi, k))
    return gold


def train(docs: DataFrame, sample: int = SAMPLE, text: str = "text", seed: int = 0) -> Weights:
    """Fit the field on at most `sample` distinct texts with digits or @, those of smallest hash, and on made-up variants."""
    some = docs.select(F.col(text).alias("t")).filter(F.col("t").rlike("[0-9@]")).withColumn("h", F.xxhash64("t"))
    hashes = [r.h for r in some.select("h").distinct().orderBy("h").limit(sample).collect()]
    texts: list[str] = []
    if hashes:
        picked = docs.sparkSession.createDataFrame([(h,) for h in hashes], "h long")  # bounded by `sample`
        texts = sorted(r.t for r in some.join(F.broadcast(picked), "h").groupBy("h").agg(F.min("t").alias("t")).collect())
    marked = [(w, _marked(w)) for w in _windows(texts)]
    rng = random.Random(seed)
    marked += [_variants(rng) for _ in range(max(len(marked) // 4, 300))]
    return fit(marked, seed=seed)


# Over a table ------------------------------------------------------------------------------------


def found(w: Weights, data: np.ndarray, offsets: np.ndarray, margin: float = MARGIN) -> dict[int, tuple[list[Span], list[Span]]]:
    """For each text with spans: (base spans, added spans), in code points. Added spans overlap no base span."""
    spots = _spots(data, offsets)
    out: dict[int, tuple[list[Span], list[Span]]] = {}
    if not spots:
        return out
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    for t, lo, hi in spots:
        window = data[lo:hi].tobytes().decode("utf-8", "replace")
        shift = int(points[lo] - points[offsets[t]])
        base = base_spans(window)
        more = [s for s in best_spans(w, window, margin) if all(s[1] <= b[0] or s[0] >= b[1] for b in base)]
        if base or more:
            a, b = out.setdefault(t, ([], []))
            a += [(x + shift, y + shift, k) for x, y, k in base]
            b += [(x + shift, y + shift, k) for x, y, k in more]
    return out


SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("kind", "string").add("base", "boolean"))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))


def finder(w: Weights, margin: float = MARGIN):
    """A column function: text to its spans (start, end, kind, base), by start, then kind. A null text has none."""

    @F.arrow_udf(SPANS)
    def spans(text: pa.Array) -> pa.Array:
        data, offsets = text_bytes(text)
        rows: list[list] = [[]] * len(text)
        for lo, hi in pieces(offsets, PART):
            part = found(w, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], margin)
            for t, (base, more) in part.items():
                both = sorted([(x, k, y, True) for x, y, k in base] + [(x, k, y, False) for x, y, k in more])
                rows[lo + t] = [{"start": x, "end": y, "kind": KINDS[k], "base": b} for x, k, y, b in both]
        return pa.array(rows, _SPANS)

    return spans


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def spans_of(docs: DataFrame, weights: Weights | None = None, margin: float = MARGIN) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (fixed patterns), base_sha256, spans (all, as text), n_added.

    Null and empty texts have no spans; equal texts have equal spans; no other column is read.
    """
    find = finder(train(docs) if weights is None else weights, margin)
    d = docs.select("doc_id", find(F.col("text")).alias("all"))
    base = F.filter("all", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select(
        "doc_id",
        *[count(k) for k in KINDS[:4]],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("all")).alias("spans"),
        (F.size("all") - F.size(base)).cast("long").alias("n_added"),
    )


def masked(docs: DataFrame, weights: Weights | None = None, margin: float = MARGIN) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; overlapping spans become one, named after the first.

    n_chars, where there is such a column, is counted anew. A null text stays null.
    """
    w = train(docs) if weights is None else weights

    @F.arrow_udf(T.StringType())
    def mask(text: pa.Array) -> pa.Array:
        data, offsets = text_bytes(text)
        out = text.to_pylist()
        for lo, hi in pieces(offsets, PART):
            part = found(w, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], margin)
            for t, (base, more) in part.items():
                old, new, at = out[lo + t], [], 0
                for x, y, k in sorted(base + more):
                    if x >= at:
                        new += [old[at:x], f"[{KINDS[k].upper()}]"]
                    at = max(at, y)
                out[lo + t] = "".join([*new, old[at:]])
        return pa.array(out, text.type)

    clean = docs.withColumn("text", mask(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)

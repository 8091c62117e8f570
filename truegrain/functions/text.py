"""Text forms and similarities, as Spark expressions; one vectorised function for Jaro-Winkler."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_case(c: Column) -> Column:
    return F.lower(c)


def fold_space(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def fold_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}\s]+", "")


def normalise(c: Column) -> Column:
    """Lower case, no punctuation, single spaces."""
    return fold_space(fold_punctuation(fold_case(c)))


def words(c: Column) -> Column:
    return F.split(normalise(c), " ")


def token_sort_key(c: Column) -> Column:
    """The distinct words in alphabetical order: equal for texts that differ in word order only."""
    return F.array_join(F.sort_array(F.array_distinct(words(c))), " ")


def shingle_runs(c: Column, n: int = 3) -> Column:
    """All runs of n words in order, repeats included; a shorter text is one run of its own."""

    def of(w: Column) -> Column:
        # The words zipped with themselves shifted by 1, 2, ...: linear, and no slice per run.
        runs = w
        for k in range(1, n):
            rest = F.slice(w, F.lit(k + 1), F.size(w))
            runs = F.zip_with(runs, rest, lambda x, y: F.concat(x, F.lit(" "), y))
        return F.when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.slice(runs, F.lit(1), F.size(w) - (n - 1)))

    # The one-entry array binds the words to a name: split once, not once per use.
    return F.element_at(F.transform(F.array(words(c)), of), 1)


def shingle_hashes(c: Column, n: int = 3) -> Column:
    """A 64-bit hash of every entry of `shingle_runs`: of the hashes of its words, so no run is written out."""

    def of(h: Column) -> Column:
        shifted = [F.slice(h, F.lit(k + 1), F.greatest(F.size(h) - (n - 1), F.lit(0))) for k in range(n)]
        runs = F.transform(F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)]), lambda r: F.xxhash64(r))
        return F.when(F.size(h) < n, F.array(F.xxhash64(h))).otherwise(runs)

    return F.element_at(F.transform(F.array(F.transform(words(c), lambda w: F.xxhash64(w))), of), 1)


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct runs of n words."""
    return F.array_distinct(shingle_runs(c, n))


def _both(a: Column, b: Column, value: Column) -> Column:
    """The value where both sides are present, else null: a field not given says nothing."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def lev_sim(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    sim = F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest.cast("double")
    )
    return _both(a, b, sim)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets given as arrays of distinct entries."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return _both(a, b, F.try_divide(both, (F.size(a) + F.size(b)).cast("double") - both))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(words(a)), F.array_distinct(words(b)))


def num_sim(a: Column, b: Column, tolerance: float) -> Column:
    gap = F.abs(a.cast("double") - b.cast("double"))
    return _both(a, b, F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.lit(float(tolerance))))


def date_sim(a: Column, b: Column, days: float) -> Column:
    gap = F.abs(F.datediff(a, b)).cast("double")
    return _both(a, b, F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.lit(float(days))))


def cat_sim(a: Column, b: Column, synonyms: Mapping[str, str] | None = None) -> Column:
    """1 for equal categories or synonyms (each mapped to its main term), else 0."""
    if synonyms:
        table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
        a, b = (F.coalesce(F.try_element_at(table, c), c) for c in (a, b))
    return (a == b).cast("double")


def abbrev_match(a: Column, b: Column) -> Column:
    """Words agree one by one, each equal to or a beginning of the other; or one text is the other's initials."""
    wa, wb = words(a), words(b)
    fits = F.forall(F.zip_with(wa, wb, lambda x, y: F.startswith(x, y) | F.startswith(y, x)), lambda x: x)
    stepwise = (F.size(wa) == F.size(wb)) & F.coalesce(fits, F.lit(False))

    def initials(w: Column) -> Column:
        return F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")

    def acronym(short: Column, full: Column) -> Column:
        return (F.size(full) > 1) & (F.size(short) == 1) & (F.element_at(short, 1) == initials(full))

    return (normalise(a) != normalise(b)) & (stepwise | acronym(wa, wb) | acronym(wb, wa))


def subsumes(a: list[tuple[Column, Column]], b: list[Column]) -> Column:
    """Every present field of a equals b's: a is a partial copy of b. a holds (value, missing test)."""
    out = F.lit(True)
    for (value, gone), other in zip(a, b):
        out = out & (gone | value.eqNullSafe(other))
    return out


def phonetic_key(c: Column, algorithm: str = "soundex") -> Column:
    if algorithm == "soundex":
        return F.soundex(c)
    if algorithm == "metaphone":
        return metaphone(c)
    raise ValueError(f"unknown phonetic algorithm {algorithm!r}; choose soundex or metaphone")


# The published Metaphone rules as replacements, applied in order. Sounds are
# written in lower case while letters still to be handled are in upper case.
METAPHONE = [
    (r"[^A-Z]", ""),
    (r"([ABD-Z])\1+", "$1"),
    (r"^(AE|[GKP]N|WR)", "_$1"),
    (r"^_AE", "E"),
    (r"^_[GKP]N", "N"),
    (r"^_WR", "R"),
    (r"^X", "S"),
    (r"^WH", "W"),
    (r"MB$", "M"),
    (r"SCH", "sk"),
    (r"CIA", "xA"),
    (r"T?CH", "x"),
    (r"S?C(?=[IEY])", "s"),
    (r"C", "k"),
    (r"DG(?=[EYI])", "j"),
    (r"D", "t"),
    (r"GH(?![AEIOU]|$)", ""),
    (r"GN(ED)?$", "N$1"),
    (r"G(?=[IEY])", "j"),
    (r"G", "k"),
    (r"PH", "f"),
    (r"TH", "0"),
    (r"SH", "x"),
    (r"S(?=I[OA])", "x"),
    (r"T(?=I[OA])", "x"),
    (r"T", "t"),
    (r"Q", "k"),
    (r"kK|K", "k"),
    (r"V|F", "f"),
    (r"X", "ks"),
    (r"Z|S", "s"),
    (r"(?<=[AEIOU])H(?![AEIOU])", ""),
    (r"(?<=[a-z0])H", ""),
    (r"[WY](?![AEIOU])", ""),
    (r"(?!^)[AEIOU]", ""),
]


def metaphone(c: Column) -> Column:
    """Metaphone key of a word, as a chain of replacements inside the JVM."""
    out = F.upper(c)
    for pattern, to in METAPHONE:
        out = F.regexp_replace(out, pattern, to)
    return F.upper(out)


def jw_sim(a: Column | str, b: Column | str) -> Column:
    """Jaro-Winkler similarity of already paired texts; equal pairs in a batch are computed once.

    Everything the workers need is defined in here, so they need not have this package installed.
    """

    def one(x: str, y: str) -> float:
        if x == y:
            return 1.0
        if not x or not y:
            return 0.0
        reach = max(max(len(x), len(y)) // 2 - 1, 0)
        used, mine = [False] * len(y), []
        for i, ch in enumerate(x):
            at = next((j for j in range(max(0, i - reach), min(len(y), i + reach + 1)) if not used[j] and y[j] == ch), None)
            if at is not None:
                used[at] = True
                mine.append(ch)
        if not mine:
            return 0.0
        theirs = [ch for ch, u in zip(y, used) if u]
        swaps = sum(p != q for p, q in zip(mine, theirs)) // 2
        k = len(mine)
        jaro = (k / len(x) + k / len(y) + (k - swaps) / k) / 3.0
        if jaro <= 0.7:
            return jaro
        prefix = 0
        while prefix < min(4, len(x), len(y)) and x[prefix] == y[prefix]:
            prefix += 1
        return jaro + prefix * 0.1 * (1.0 - jaro)

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = list(zip(x, y))
        seen = {p: None if p[0] is None or p[1] is None else one(*p) for p in set(pairs)}
        return pd.Series([seen[p] for p in pairs], dtype="float64")

    return F.pandas_udf(batch, T.DoubleType())(a, b)

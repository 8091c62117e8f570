"""Quality rules by the log-likelihood ratio of hashed n-grams, in DataFrame operations only.

Words and pairs of neighbouring words are hashed to a fixed number of buckets. Two multinomials over the
buckets are counted, one of the trusted target and one of the raw corpus, both smoothed by one. A text's
verdict is the mean over its n-grams of log(target / raw): the log-likelihood ratio divided by the number
of n-grams, so that long and short texts are judged alike, against a fixed threshold. Ratios are whole
millionths, so sums are exact in every order and the verdict is the same in every run.

Nothing but counts of buckets is shuffled: all measures of a text are computed in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegrain.functions.session import by_shuffle, materialised

#: Buckets of n-grams, and the mean log ratio (in millionths) below which a text is rejected.
BUCKETS, THRESHOLD = 1 << 18, -300_000
#: Words of a text at least, and percent of its words that may stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words in a window, and the factor of the first word in the number of a pair.
WINDOW, FACTOR = 3, 1_000_003
#: Bits of a window's number that hold its place in the text; a text has less than 2**31 bytes, so less words.
PLACE_BITS = 30
SPACES, SOLID, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[^#*$%&|<>]+"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once although the body names it several times."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def grams(docs: DataFrame, n: int = BUCKETS) -> DataFrame:
    """`docs` without its column `words`, a row per word and per pair of neighbours with its bucket; one row with a null where there is none."""
    own = [c for c in docs.columns if c != "words"]
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))
    rows = docs.select(*own, F.inline_outer(pairs).alias("a", "b"))
    pair = F.when(F.col("b").isNotNull(), (F.crc32("a") * FACTOR + F.crc32("b")) % n)
    found = rows.select(*own, "a", F.explode(F.array(F.crc32("a") % n, pair)).alias("bucket"))
    return found.filter("bucket is not null or a is null").drop("a")


def _repeated(docs: DataFrame) -> DataFrame:
    """`docs` with n_repeat_words: how many of `words` stand in a window of WINDOW words found twice or more in the text.

    Windows are numbers, the upper bits of their hash and then their place, so that sorted ones with equal
    upper bits are neighbours; those few are told apart by their whole hash. The places of what is found
    twice are sorted again, and each adds the words up to the next place, at most a window.
    """
    places = (1 << PLACE_BITS) - 1
    none = lambda kind: F.array().cast(f"array<{kind}>")
    at = lambda i: [F.get("h", i + k) for k in range(WINDOW)]
    d = docs.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("win", F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*at(i)))).otherwise(none("bigint")))
    d = d.withColumn("s", F.sort_array(F.transform("win", lambda x, i: x.bitwiseAND(F.lit(-1 - places)).bitwiseOR(i.cast("bigint")))))
    near = lambda x, k: F.coalesce(F.shiftright(F.get("s", k).bitwiseXOR(x), PLACE_BITS) == 0, F.lit(False))
    d = d.withColumn("later", F.filter("s", lambda x, k: near(x, k - 1)))
    d = d.withColumn("some", F.when(F.size("later") > 0, F.filter("s", lambda x, k: near(x, k - 1) | near(x, k + 1))).otherwise(none("bigint")))
    place = lambda x: x.bitwiseAND(F.lit(places)).cast("int")
    d = d.withColumn("some", F.sort_array(F.transform("some", lambda x: F.struct(F.get("win", place(x)).alias("h"), place(x).alias("i")))))
    same = lambda x, k: F.coalesce(F.get("some", k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("found", F.sort_array(F.transform(F.filter("some", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    # a null (no next place) is skipped by least(), so the last place adds a whole window
    step = F.transform("found", lambda v, k: F.least(F.lit(WINDOW), F.get("found", k + 1) - v).cast("long"))
    return d.withColumn("n_repeat_words", F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)).drop("h", "win", "s", "later", "some", "found")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text; a null has none."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(SOLID))
    return _repeated(docs.withColumn("words", words(body))).withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace(body, SYMBOLS, "")).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )


def ratios(corpus: DataFrame, n: int = BUCKETS) -> DataFrame:
    """bucket, ratio: millionths of log(target / raw) of all `n` buckets; 0 everywhere if either side has no words.

    `corpus` has text, in_raw and in_target, which say in which of the two multinomials a text counts.
    """
    texts = corpus.select(words(F.coalesce(F.col("text"), F.lit(""))).alias("words"), F.col("in_raw").cast("long").alias("r"), F.col("in_target").cast("long").alias("t"))
    counted = grams(texts, n).filter("bucket is not null").groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    every = corpus.sparkSession.range(n).select(F.col("id").alias("bucket"))
    counts = materialised(every.join(counted, "bucket", "left").na.fill(0, ["r", "t"]))
    total = counts.agg(F.sum("r").alias("r_all"), F.sum("t").alias("t_all"), F.count(F.lit(1)).alias("n"))
    of = lambda c: total.select(c).scalar()
    share = lambda c: (F.col(c) + 1).cast("double") / (of(f"{c}_all") + of("n")).cast("double")
    ratio = F.round((F.log(share("t")) - F.log(share("r"))) * 1e6).cast("long")
    none = (of("r_all") == 0) | (of("t_all") == 0)
    return counts.select("bucket", F.when(none, F.lit(0).cast("long")).otherwise(ratio).alias("ratio"))


def labelled(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """text, in_raw, in_target: all documents are raw; target is what every label calls good (quality 1) and not toxic.

    The target is fitted on every trusted id; `most`, if a caller gives it, leaves that many of the smallest
    hashes. Texts are shuffled to meet their labels, whose number grows with them.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0").select(F.col("doc_id").alias("good"))
    if most is not None:
        good = good.orderBy(F.xxhash64("good"), "good").limit(most)
    both = docs.select("doc_id", "text").join(by_shuffle(good), F.col("doc_id") == F.col("good"), "left")
    return both.select("text", F.lit(True).alias("in_raw"), F.col("good").isNotNull().alias("in_target"))


def judged(docs: DataFrame, corpus: DataFrame, n: int = BUCKETS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams, llr_micro, score, kept.

    llr_micro is the sum of log ratios over the text's n-grams in millionths, score their mean (null without
    words). A text is kept if it doesn't fail the base rules and its mean is at least `threshold` millionths.
    `corpus` is a table for `ratios`; where raw or target has no words, all ratios are 0 and the base rules
    alone decide. Null and empty texts have no words and fail. Rows with equal ids, a null one included, are
    rows of their own. Other columns are not read. An empty table gives no rows.
    """
    table = materialised(ratios(corpus, n))
    own = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    base = ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed")
    told = measures(docs.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("row"), *own[1:-1], base, "words")
    # a row's n-grams stay in its task, where their ratios are added up before one row is shuffled; `row` tells equal ids apart
    weighed = grams(told, n).join(F.broadcast(table), "bucket", "left")  # bounded: `n` rows, whatever the size of the corpus
    told = weighed.groupBy(*own).agg(F.count("bucket").alias("n_grams"), F.coalesce(F.sum("ratio"), F.lit(0)).alias("llr_micro")).drop("row")
    score = F.when(F.col("n_grams") > 0, F.col("llr_micro").cast("double") / F.col("n_grams").cast("double") / 1e6)
    return told.select("*", score.alias("score"), (~F.col("base_failed") & (F.col("llr_micro") >= threshold * F.col("n_grams"))).alias("kept"))

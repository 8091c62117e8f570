"""Prefix trie of conversations with subtree totals by parallel tree contraction.

A prefix is named by sums over its turns of hashes of (place, role, text), so that all prefixes of a
conversation are running totals and no task holds a conversation. Equal prefixes are one node, called
by its smallest member and its depth.

Subtree totals come from contraction in join rounds: a round rakes all leaves, which add what they hold to
their parents, and compresses unary chains, splicing out nodes no two of which are neighbours, so that long
chains halve. When only the root is left, rounds are undone in reverse: a spliced node's total is what it
held plus the total of the child it was spliced into. A round works on the nodes still live, whose number
falls geometrically.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegrain.functions.scan import running
from truegrain.functions.session import materialised, shuffle_width

#: Conversations that share a base, and the number of different head lengths.
FAMILY, HEADS = 5, 9
#: Characters of a piece of a list of ids.
PIECE = 1 << 16
LANES = [f"s{k}" for k in range(4)]


def _head(conv: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("int")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, nth (from 1), digest, bytes of every turn. Turns of one number are ordered by their digest."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one")
    )
    return running(turns, ["conv_id"], ["turn", "digest"], {"nth": "one"}).select("conv_id", "nth", "digest", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv, place (from 1; 0 for the root), digest, bytes, last: every conversation with the head of its base put first."""
    per = materialised(turns.groupBy("conv_id").agg(F.max("nth").alias("n")))
    base = per.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = per.select(F.col("conv_id").alias("conv"), "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), _head(F.col("conv_id")).alias("h"))
    taken = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    convs = convs.join(base, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialised(convs)
    # at most HEADS - 1 turns of a conversation, asked by at most FAMILY others
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("nth") < HEADS)).withColumnRenamed("conv_id", "base")
    first = convs.join(heads, "base").filter("nth <= h").select("conv", F.col("nth").alias("place"), "digest", "bytes", (F.col("nth") == F.col("length")).alias("last"))
    own = turns.filter(F.col("nth") > _head(F.col("conv_id"))).join(convs, F.col("conv_id") == F.col("conv"))
    place = F.col("nth") - F.col("h") + F.col("taken")
    rest = own.select("conv", place.alias("place"), "digest", "bytes", (place == F.col("length")).alias("last"))
    root = convs.select("conv", F.lit(0).cast("long").alias("place"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"), (F.col("length") == 0).alias("last"))
    return first.unionByName(rest).unionByName(root)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, place, bytes, last, and key and up: two 64-bit names each of the prefix and of the one without its last turn."""
    a, b = F.xxhash64("place", "digest"), F.xxhash64(F.lit(1), "place", "digest")
    half = lambda h, k: F.shiftrightunsigned(h, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))
    real = lambda c: F.when(F.col("place") > 0, c).otherwise(0)
    parts = {f"l{k}": real(half(a if k < 2 else b, k % 2)) for k in range(4)}
    sums = running(rows.withColumns(parts).drop("digest"), ["conv"], ["place"], dict(zip(LANES, parts)))
    name = lambda place, s: F.struct(F.xxhash64(place, *s).alias("x"), F.xxhash64(F.lit(2), *reversed(s), place).alias("y"))
    before = [F.col(s) - F.col(p) for s, p in zip(LANES, parts)]
    up = F.when(F.col("place") > 0, name(F.col("place") - 1, before))
    return sums.select("conv", "place", "bytes", "last", name(F.col("place"), [F.col(s) for s in LANES]).alias("key"), up.alias("up"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x, y, conv) as pieces of comma-joined ids, none of two keys."""
    key, ids, size = None, [], 0
    out: list[tuple] = []

    def close() -> None:
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def flushed() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["x", "y", "first", "ids"])
        out.clear()
        return b

    for b in batches:
        for x, y, c in zip(*[v.to_pylist() for v in b.columns]):
            if key != (x, y) or size >= PIECE:
                close()
                key, size = (x, y), 0
            ids.append(c)
            size += len(str(c)) + 1
        if len(out) >= 100:
            yield flushed()
    close()
    if out:
        yield flushed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each key's pieces, sorted by key and first id; a piece at a time is in memory."""
    key, sha = None, None
    out: list[tuple] = []
    for b in batches:
        for x, y, ids in zip(*[b.column(k).to_pylist() for k in (0, 1, 3)]):
            if key == (x, y):
                sha.update(b",")
            else:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (x, y), hashlib.sha256()
            sha.update(ids.encode())
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["x", "y", "sha"])
            out = []
    if key is not None:
        out.append((*key, sha.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["x", "y", "sha"])


def ends(rows: DataFrame) -> DataFrame:
    """key, sha: the SHA-256 of the ids of the conversations that end in each prefix.

    A hash reads its text in order, so the list of one key passes through one task; but it arrives in
    long pieces, made where ranges of (key, id) lie, and is never held as a whole.
    """
    last = rows.filter("last").select("key.x", "key.y", "conv")
    ranged = last.repartitionByRange(shuffle_width(rows.sparkSession), "x", "y", "conv").sortWithinPartitions("x", "y", "conv")
    listed = ranged.mapInArrow(_listed, "x long, y long, first long, ids string")
    ordered = listed.repartition("x", "y").sortWithinPartitions("x", "y", "first")
    hashed = ordered.mapInArrow(_hashed, "x long, y long, sha string")
    return hashed.select(F.struct("x", "y").alias("key"), "sha")


def nodes(rows: DataFrame) -> DataFrame:
    """id (conv, depth), up (id of the parent, null for the root), n_convs, n_children, saved, sha."""
    made = rows.groupBy("key").agg(
        F.min("conv").alias("conv"), F.max("place").alias("depth"), F.max("up").alias("up"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes")
    )
    made = materialised(made)
    named = lambda p: F.struct(F.col(f"{p}conv").alias("conv"), F.col(f"{p}depth").alias("depth"))
    parent = made.select(F.col("key").alias("up"), F.struct("conv", "depth").alias("of"))
    kids = made.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = made.join(kids, "key", "left").join(ends(rows), "key", "left").join(parent, "up", "left")
    none = hashlib.sha256(b"").hexdigest()
    return materialised(
        whole.select(
            named("").alias("id"), F.col("of").alias("up"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.coalesce("sha", F.lit(none)).alias("sha"),
        )
    )


def _coin(node: Column, turn: int, bits: int) -> Column:
    """A bit of a node in a round: in turn those of its depth, by which a chain of consecutive depths halves; then of a hash."""
    if turn < bits:
        return F.shiftright(node["depth"], turn).bitwiseAND(F.lit(1)) == 1
    return F.xxhash64(F.lit(turn), node).bitwiseAND(F.lit(1)) == 1


def contracted(tree: DataFrame, values: list[str]) -> DataFrame:
    """id and `values`: the sums over each node's subtree, itself included.

    `tree` has id (with a field depth), up (null for the one root), n_children, and a column for each value.
    """
    on_edge = {v: f"edge_{v}" for v in values}
    live = tree.select("id", "up", F.col("n_children").alias("n"), *values, *[F.lit(0).cast("long").alias(e) for e in on_edge.values()])
    deepest = tree.agg(F.max("id.depth")).first()[0]
    if deepest is None:
        return tree.select("id", *values)
    bits, turn = int(deepest).bit_length(), 0
    raked, spliced = [], []
    while True:
        # rake: every leaf adds what it and its edge hold to its parent
        leaf = (F.col("n") == 0) & F.col("up").isNotNull()
        gains = live.filter(leaf).groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(v) + F.col(e)).alias(f"gain_{v}") for v, e in on_edge.items()])
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        state = materialised(
            live.join(gains, "id", "left").select(
                "id", "up", leaf.alias("leaf"), (F.col("n") - zero("gone")).alias("n"), *[(F.col(v) + zero(f"gain_{v}")).alias(v) for v in values], *on_edge.values()
            )
        )
        raked.append(state.filter("leaf").select("id", *values))
        rest = state.filter("not leaf").drop("leaf")
        if rest.filter("up is not null").isEmpty():
            raked.append(rest.select("id", *values))
            break
        # compress: a unary node p is spliced out if its coin is 1 and that of its child, where unary too, is 0
        p = rest.filter("n = 1 and up is not null").select(F.col("id").alias("p"), F.col("up").alias("p_up"), *[F.col(c).alias(f"p_{c}") for c in [*values, *on_edge.values()]])
        out = F.col("p").isNotNull() & _coin(F.col("p"), turn, bits) & ((F.col("n") != 1) | ~_coin(F.col("id"), turn, bits))
        pairs = materialised(rest.join(p, F.col("up") == F.col("p"), "left").withColumn("out", F.coalesce(out, F.lit(False))))
        gone = pairs.filter("out").select(F.col("p").alias("id"), F.col("id").alias("via"), *[(F.col(f"p_{v}") + F.col(e)).alias(v) for v, e in on_edge.items()])
        spliced.append((turn, gone))
        moved = pairs.select(
            "id", F.when(F.col("out"), F.col("p_up")).otherwise(F.col("up")).alias("up"), "n", *values,
            *[F.when(F.col("out"), F.col(e) + F.col(f"p_{v}") + F.col(f"p_{e}")).otherwise(F.col(e)).alias(e) for v, e in on_edge.items()],
        )
        live = moved.join(gone.select("id"), "id", "left_anti")
        turn += 1
    # expand: undo the rounds, the last first
    known = raked.pop()
    for _, gone in reversed(spliced):
        known = known.unionByName(raked.pop())
        below = known.select(F.col("id").alias("via"), *[F.col(v).alias(f"below_{v}") for v in values])
        known = known.unionByName(materialised(gone.join(below, "via").select("id", *[(F.col(v) + F.col(f"below_{v}")).alias(v) for v in values])))
    for r in raked:
        known = known.unionByName(r)
    return known


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered by turn, null first, turns of one number by the md5 of role and text; null roles
    and texts are empty. Each is rebuilt with the head of its base, then every distinct sequence of first
    turns is a node, named by its smallest member and its depth. Repeated rows are turns of their own. Rows
    without conv_id belong to no conversation. Other columns are not read. An empty table has no root and no rows.
    """
    rows = materialised(prefixes(rebuilt(numbered(conversations))))
    tree = nodes(rows).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    totals = contracted(tree, ["leaves", "saved"]).select("id", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return tree.select("id", "up", "n_convs", "n_children", F.col("sha").alias("ends_sha256")).join(totals, "id").select(
        F.col("id.conv").alias("conv_id"), F.col("id.depth").alias("depth"), F.col("up.conv").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )

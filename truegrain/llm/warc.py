"""WARC archives: written by Spark's text sink, read back in parallel from any byte range.

A file of records can only be walked from its start: a record's length is in its header, and the
magic that opens a record may also stand inside a payload. To read a file in parallel, tasks look
for the magic everywhere in their byte ranges and emit candidates, each with the offset at which
its record ends and the next must begin. Pointer jumping from the start of each file then marks
the candidates on the chain of successors; all others lie inside payloads and are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from truegrain.functions.session import checkpointed, materialised, scratch_path

#: Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(content: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four letters."""
    five = lambda i: F.conv(F.substr(F.sha1(content), i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda v, k: F.substr(F.lit(ALPHABET), F.shiftright(v, k).bitwiseAND(31) + 1, F.lit(1))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), five)
    return F.concat_ws("", F.transform(groups, lambda v: F.concat(*[letter(v, k) for k in (15, 10, 5, 0)])))


def write(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """One record per row under `path`, in plain files of the text sink, which end records by CR LF CR LF.

    Of rows with equal payloads of at least `min_bytes` bytes the one with the smallest id is written
    as response, the others as revisit records that name it and hold no payload. A null payload is an
    empty one. Rows that share the smallest id are all responses; a null id is the largest. A null
    url is left out of the header, line breaks in it are dropped.

    Only ids and digests are shuffled to find equal payloads. The list of repeated digests is written
    first, so Spark knows its size and sends it to all tasks only below the broadcast threshold.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.regexp_replace(F.col(f"`{url}`").cast("string"), "[\r\n]", "").alias("uri"),
        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("body"),
    )
    rows = rows.withColumn("digest", base32_sha1(F.col("body"))).withColumn("bytes", F.octet_length("body"))
    repeated = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    repeated = materialised(repeated.filter("rows > 1 and first is not null").select(F.col("digest").alias("of"), "first"))
    told = rows.join(repeated, (F.col("digest") == F.col("of")) & (F.coalesce("id", F.lit(2**63 - 1)) != F.col("first")), "left")
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("body")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.when(revisit, F.lit(len(HTTP))).otherwise(F.col("bytes") + len(HTTP)).cast("string")),
        F.lit("\r\n"),
        block,
    )
    told.select(record.alias("value")).write.option("lineSep", END).text(path)


def _number(fields: dict[str, str], name: str) -> int | None:
    v = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
    return int(v) if v.isascii() and v.lstrip("-").isdigit() else None


def _digest(block: bytes) -> tuple[int, str]:
    payload = block.partition(END.encode())[2]
    return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _told(body: bytes) -> dict:
    """What the bytes between two magics say of the record that may begin with them."""
    out = dict.fromkeys(("head", "length", "type", "id", "uri", "refers_to", "named_digest", "payload_bytes", "payload_digest"))
    head, found, rest = body.partition(END.encode())
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n") if ": " in x)
    length = _number(fields, "Content-Length")
    if not found or length is None or length < 0 or (len(rest) >= length and rest[length : length + len(END)] != END.encode()):
        return out
    out |= {"head": len(head) + len(END), "length": length, "type": fields.get("WARC-Type"), "id": _number(fields, "WARC-Record-ID")}
    out |= {"uri": fields.get("WARC-Target-URI"), "refers_to": _number(fields, "WARC-Refers-To")}
    out["named_digest"] = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    if len(rest) >= length:
        out["payload_bytes"], out["payload_digest"] = _digest(rest[:length])
    return out


TOLD = "head long, length long, type string, id long, uri string, refers_to long, named_digest string, payload_bytes long, payload_digest string"


def _numbered(keep: bool):
    """Chunks of a task with their number in its byte range; with the bytes, or with what they tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for b in batches:
            rows = []
            for file, at, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                body = body.as_buffer().to_pybytes()
                k = seen[file, at] = seen.get((file, at), -1) + 1
                rows.append({"file": file, "range": at, "number": k, "size": len(body)} | ({"body": body} if keep else _told(body)))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_KEPT if keep else _TOLD)

    return run


_PLACE = [("file", pa.string()), ("range", pa.int64()), ("number", pa.int64()), ("size", pa.int64())]
_KEPT = pa.schema([*_PLACE, ("body", pa.binary())])
_TOLD = pa.schema([*_PLACE, *[(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in TOLD.split(", ")]])


def chunks(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """The bytes between magics: file, range (start of the task's byte range), number in it, size, and body or what it tells."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    where = text.select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("value").cast("binary"))
    return where.mapInArrow(_numbered(keep), f"file string, `range` long, number long, size long, {'body binary' if keep else TOLD}")


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """Offsets of the records of one byte range, and for each where its chain leaves the range."""
    rows = rows.sort_values("number").reset_index(drop=True)
    after = rows["base"].iloc[0] + (rows["size"] + len(MAGIC)).cumsum() - rows["size"] - len(MAGIC)
    rows["start"] = after - len(MAGIC)
    rows["begin"] = after + rows["head"]
    rows["next"] = rows["begin"] + rows["length"] + len(END)
    # a record that would end beyond its file has been cut off
    rows.loc[rows["next"] > rows["bytes"], ["next", "length"]] = None
    place = {v: i for i, v in enumerate(rows["start"])}
    out = [None] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        n = rows["next"].iat[i]
        if pd.notna(n):
            j = place.get(int(n))
            out[i] = int(n) if j is None else out[j]
    rows["leaves"] = pd.array(out, dtype="Int64")
    return rows.drop(columns=["base", "bytes"])


def _marked(rows: pd.DataFrame) -> pd.DataFrame:
    """The chunks of a byte range with their record: those on a chain from an entry open one, the rest belong to the last."""
    rows = rows.sort_values("start").reset_index(drop=True)
    live = {int(x) for x, e in zip(rows["start"], rows["entry"]) if e}
    own, record = [], None
    for at, n in zip(rows["start"], rows["next"]):
        if int(at) in live:
            record = int(at)
            if pd.notna(n):
                live.add(int(n))
        own.append(record)
    rows["record"] = pd.array(own, dtype="Int64")
    return rows.drop(columns="entry")


def _entries(rows: DataFrame) -> DataFrame:
    """(file, start) of the records at which the chain from the start of a file enters a byte range.

    Pointer jumping: with every round the pointers span twice as many ranges, and what the marked
    entries point to is marked as well, so the rounds grow with the logarithm of the ranges of a file.
    """
    heads = rows.filter("length is not null").select("file", "start", "leaves")
    targets = heads.select("file", F.col("leaves").alias("start")).filter("start is not null").distinct()
    jump = heads.join(targets, ["file", "start"], "left_semi").unionByName(heads.filter("start = 0"))
    jump = checkpointed(jump.select("file", "start", F.col("leaves").alias("to")))
    marked = checkpointed(jump.filter("start = 0").select("file", "start"))
    n = marked.count()
    while True:
        reached = marked.join(jump, ["file", "start"]).select("file", F.col("to").alias("start"))
        marked = checkpointed(marked.unionByName(reached.join(jump, ["file", "start"], "left_semi")).distinct())
        far = jump.select("file", F.col("start").alias("to"), F.col("to").alias("far"))
        now = marked.count()
        if now == n:
            return marked
        jump, n = checkpointed(jump.join(far, ["file", "to"], "left").select("file", "start", F.coalesce("far", "to").alias("to"))), now


def _with_open(spark: SparkSession, path: str, marked: DataFrame, records: DataFrame) -> DataFrame:
    """Length and digest of records whose payload holds the magic: their chunks are read again and put together."""
    opened = records.filter("payload_digest is null").select("file", F.col("start").alias("record"), "head", "length")
    if opened.isEmpty():
        return records
    ends = marked.groupBy("file", "range").agg(F.max("record").alias("last"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.max("last").over(before)).select("file", "range", "carried")
    parts = marked.join(carried, ["file", "range"]).withColumn("record", F.coalesce("record", "carried"))
    parts = parts.join(opened.select("file", "record"), ["file", "record"], "left_semi").select("file", "range", "number", "size", "record", "start")
    bodies = chunks(spark, path, keep=True).withColumnRenamed("size", "bytes")
    found = parts.join(bodies, ["file", "range", "number"], "left")
    same = F.when(F.col("bytes") == F.col("size"), F.col("body")).otherwise(F.raise_error(F.lit("byte ranges moved between two reads")))
    pieces = found.select("file", "record", "start", same.alias("body"))

    def put_together(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("start")
        body = MAGIC.encode().join(g["body"])
        block = body[int(g["head"].iat[0]) :][: int(g["length"].iat[0])]
        n, digest = _digest(block)
        return pd.DataFrame({"file": g["file"].iat[0], "start": int(g["record"].iat[0]), "n": n, "digest": digest}, index=[0])

    whole = pieces.join(opened, ["file", "record"]).groupBy("file", "record").applyInPandas(put_together, "file string, start long, n long, digest string")
    return records.join(whole, ["file", "start"], "left").withColumns(
        {"payload_bytes": F.coalesce("payload_bytes", "n"), "payload_digest": F.coalesce("payload_digest", "digest")}
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under `path`: file, start, next, type, id, uri, refers_to, named_digest, payload_bytes, payload_digest.

    Byte ranges are read in parallel. Offsets come from the sizes of the chunks: summed per range,
    then over the ranges of a file. Bytes that no chain from the start of a file reaches are payload
    or damaged, and give no record, nor does a record that its file ends within; a file that doesn't
    begin with a record gives none at all.
    A revisit record has the length and digest of its own, empty payload here; named_digest is the one in its header.
    """
    told = materialised(chunks(spark, path))
    ranges = told.groupBy("file", "range").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    base = ranges.select(
        "file", "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), (F.sum("bytes").over(whole) - len(MAGIC)).alias("bytes")
    )
    schema = f"file string, `range` long, number long, size long, {TOLD}, start long, begin long, next long"
    rows = told.join(base, ["file", "range"]).groupBy("file", "range").applyInPandas(_chained, f"{schema}, leaves long")
    rows = materialised(rows)
    entries = _entries(rows).withColumn("entry", F.lit(True))
    flagged = rows.drop("leaves").join(entries, ["file", "start"], "left").fillna(False, ["entry"])
    marked = materialised(flagged.groupBy("file", "range").applyInPandas(_marked, f"{schema}, record long"))
    records = marked.filter("record = start and length is not null")
    return _with_open(spark, path, marked, records).select("file", "start", "next", "type", "id", "uri", "refers_to", "named_digest", "payload_bytes", "payload_digest")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, file, start: revisits with the payload they refer to.

    A revisit means the record of the id and of the digest that its header names, so ids may repeat.
    """
    first = records.filter("type = 'response'").groupBy(F.col("id").alias("of"), F.col("payload_digest").alias("digest")).agg(F.first("payload_bytes").alias("n"))
    again = records.filter("type = 'revisit'").join(first, (F.col("refers_to") == F.col("of")) & (F.col("named_digest") == F.col("digest")), "left")
    again = again.withColumns({"payload_bytes": F.col("n"), "payload_digest": F.col("digest")}).drop("of", "n", "digest")
    return records.filter("type = 'response'").unionByName(again).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "file", "start"
    )


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages as WARC files in the shared folder and read them back: one row per page, see resolved()."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, min_bytes)
    return resolved(read_records(spark, path))

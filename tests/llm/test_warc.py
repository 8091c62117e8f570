"""Archives: round trip, magic inside payloads, many byte ranges, damage."""

import base64
import glob
import hashlib

import pytest

from truegrain.llm import warc as w

FAKE = w.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 4\r\n\r\nabcd" + w.END
ROWS = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/\r\nX: y", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 5000),
    (6, "u", "before " + FAKE + "after " + FAKE), (7, "u", FAKE * 40), (8, "u", w.MAGIC), (9, "u", "x" + w.END + w.MAGIC + "Content-Length: 99999999999\r\n\r\n"),
    (10, "u", "y" * 9000 + FAKE * 3), (11, "u", FAKE * 40), (12, "u", "<p>one</p>"), (13, "u", w.MAGIC + "Content-Length: -5\r\n\r\n"),
]


def expected(rows):
    first = {}
    for i, _, body in rows:
        first.setdefault(body or "", i)
        first[body or ""] = min(first[body or ""], i)
    out = []
    for i, _, body in rows:
        raw = (body or "").encode()
        f = first[body or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    return sorted(out)


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def found(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as size", "'x' as file")
    assert found(w.archive(pages)) == expected(ROWS)


def test_many_ranges_in_one_file(spark, small_ranges):
    pages = spark.createDataFrame(ROWS * 1, "page_id long, url string, html string").coalesce(1)
    assert found(w.archive(pages)) == expected(ROWS)


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(ROWS[:5], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in w.archive(pages, min_bytes=1).collect()}
    assert got == {1: "response", 2: "revisit", 3: "response", 4: "response", 5: "response"}


def test_damage_ends_the_chain(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string")
    w.write(pages.coalesce(1), str(tmp_path / "a"))
    file = glob.glob(str(tmp_path / "a" / "part-*"))[0]
    raw = open(file, "rb").read()
    at = raw.index(b"<urn:page:12>")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(raw[: at + 300])
    assert sorted(r.id for r in w.read_records(spark, str(tmp_path / "b")).collect()) == list(range(12))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.warc").write_bytes(b"no archive " + raw)
    assert w.read_records(spark, str(tmp_path / "c")).collect() == []


def test_odd_tables(spark):
    assert w.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    rows = [(1, "u", "same"), (1, "u", "same"), (None, "u", "same"), (None, None, None)]
    got = found(w.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).fillna(-1, ["page_id", "refers_to"]))
    assert [(a, d, e) for a, _, _, d, e in got] == [(-1, "response", -1), (-1, "revisit", 1), (1, "response", -1), (1, "response", -1)]


def test_one_id_with_several_payloads(spark):
    rows = [(1, "a"), (1, "bb"), (2, "a"), (3, "bb"), (4, "ccc")]
    got = w.archive(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [
        (1, 1, "response", None), (1, 2, "response", None), (2, 1, "revisit", 1), (3, 2, "revisit", 1), (4, 3, "response", None)
    ]
    digest = {r.payload_bytes: r.payload_digest for r in got}
    assert all(r.payload_digest == digest[r.payload_bytes] for r in got) and len(set(digest.values())) == 3

import pytest
from pyspark.sql import functions as F

from truegrain.functions.session import checkpoint_root, materialised
from truegrain.operators.rows import flag_rows
from truegrain.sources import files, order, tables
from truegrain.streaming import streams

SCHEMA = "id long, t string"


def test_csv_line_breaks_quotes_ragged(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,t,u\n1,"two\nlines, ""quoted""",x\n2,short\n3,a,b,extra\n')
    got = tables.read_table(spark, str(p), multiline=True).orderBy("id").collect()
    assert [(r.id, r.t, r.u) for r in got] == [("1", 'two\nlines, "quoted"', "x"), ("2", "short", None), ("3", "a", "b")]
    first = tables.preview(tables.read_table(spark, str(p), multiline=True), 2).collect()
    assert len(first) == 2 and first[1].u == "" and first[0].total_rows == 3


@pytest.mark.parametrize("fmt", ["csv", "tsv", "json", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a\tb,"c"\nd'), (2, "é"), (3, None)], SCHEMA)
    path = str(tmp_path / f"t.{fmt}")
    tables.write_processed(df, path, fmt)
    assert sorted(tables.read_table(spark, path, schema=SCHEMA, multiline=True).collect()) == sorted(df.collect())


def test_json_documents_and_lines(spark, tmp_path):
    (tmp_path / "doc.json").write_text('[\n {"id": 1},\n {"id": 2}\n]\n')
    (tmp_path / "lines.json").write_text('{"id": 1}\n{"id": 2}\n{"id": 3}\n')
    assert tables.read_table(spark, str(tmp_path / "doc.json")).count() == 2
    assert tables.read_table(spark, str(tmp_path / "lines.json")).count() == 3


def test_unsupported_types_are_named(spark):
    with pytest.raises(ValueError, match="csv, tsv, json, parquet.*spreadsheets"):
        tables.read_table(spark, "/x/book.XLSX")
    with pytest.raises(ValueError, match="unsupported file type 'doc'"):
        tables.read_table(spark, "/x/a.doc")
    with pytest.raises(ValueError, match="different kinds"):
        tables.read_table(spark, ["/x/a.csv", "/x/b.tsv"])


def test_output_must_not_cover_input(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    tables.write_processed(spark.createDataFrame([(1, "a")], SCHEMA), path)
    back = tables.read_table(spark, path)
    for target in (path, str(tmp_path)):
        with pytest.raises(ValueError, match="holds input of this job"):
            tables.write_processed(back, target)
    assert tables.read_table(spark, path).count() == 1


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_row_index_is_dense_and_in_order(spark, tmp_path, fmt):
    path = str(tmp_path / f"t.{fmt}")
    tables.write_processed(spark.range(5000).select("id", F.repeat(F.lit("x"), 20).alias("t")).repartitionByRange(7, "id"), path, fmt)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = tables.read_table(spark, path, schema=SCHEMA, multiline=False)
        got = order.with_row_index(back).filter("id <> row_index").count()
        n = order.with_row_index(back).select("row_index").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == 0 and n == 5000


def test_order_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    got = order.with_order_index(df, "k").orderBy("k").collect()
    assert [r.row_index for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)


def test_folder_of_files(spark, tmp_path):
    for name, text in {"a.csv": "id,t\n1,x\n2,\n", "b.csv": "id,t\n3,z\n", "c.csv": "id,t\n", "n.txt": "no"}.items():
        (tmp_path / name).write_text(text)
    inputs = files.list_inputs(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in inputs.collect()} == {"a.csv", "b.csv", "c.csv"}
    s = files.inspect_dir(inputs).first()
    assert (s.files, s.csv_files, s.has_inputs) == (3, 3, True)
    done = inputs.filter("path LIKE '%a.csv'")
    assert files.pending_inputs(inputs, done).count() == 2
    assert files.list_inputs(spark, str(tmp_path), done).filter("processed").count() == 1
    per = files.batch_completeness(files.read_batch(spark, [str(tmp_path / f"{x}.csv") for x in "abc"], "csv"))
    got = {r.path.rsplit("/", 1)[1]: (r.total_rows, r.missing_cells, r.file_status) for r in files.batch_status(inputs, per).collect()}
    assert got["a.csv"] == (2, 1, "completed") and got["c.csv"] == (None, None, "empty_or_unreadable")


def test_listing_does_not_read_contents(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n1\n")
    plan = files.list_inputs(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_stream_takes_each_file_once(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    df = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    for i in range(3):
        df.withColumn("id", F.col("id") + 10 * i).write.mode("append").parquet(src)
        stream = streams.new_files(spark, src, "parquet", df.schema, files_per_batch=1)
        streams.process_new(streams.flag_stream(stream, ["t"], ["t"]), sink, ck)
    got = spark.read.parquet(sink)
    assert got.count() == 6
    want = flag_rows(spark.read.parquet(src), ["t"], ["t"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_forgets_after_the_delay(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    # the same key again within the delay, and long after it, in separate arrivals
    for t in ("2024-01-01 00:00:00", "2024-01-01 00:30:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"):
        df = spark.sql(f"SELECT 'k' AS k, TIMESTAMP_NTZ'{t}' AS ts").coalesce(1)
        df.write.mode("append").parquet(src)
        stream = streams.new_files(spark, src, "parquet", df.schema)
        streams.process_new(streams.distinct_stream(stream, ["k"], "ts", "1 hour"), sink, ck)
    got = sorted(str(r.ts) for r in spark.read.parquet(sink).collect())
    # the first arrival after the delay only moves the watermark on; from then on the key is free again
    assert got == ["2024-01-01 00:00:00", "2024-01-03 00:00:00"]


def test_shared_folder_is_used(spark):
    root = checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir", root)
    df = materialised(spark.range(3).toDF("x"))
    assert df.count() == 3 and df.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/"))


def test_json_sorts_side_by_side(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "b.json").write_text('\n[\n{"id": 3},\n{"id": 4}]')
    (tmp_path / "c.json").write_text('{"id": 5,\n "t": "x"}')
    (tmp_path / "d.json").write_text('[{"id": 6}, {"id": 7}]')
    got = tables.read_table(spark, [str(tmp_path / f"{x}.json") for x in "abcd"], schema="id bigint, t string")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert got.filter("t = 'x'").count() == 1
    assert sorted(r.id for r in tables.read_table(spark, str(tmp_path), "json").collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_damaged_json_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{"id": oops\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        tables.read_table(spark, str(tmp_path / "a.json"), schema="id bigint").collect()


def test_ragged_csv_is_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n1,x\n2,b,LOST\n3\nfour,y\n")
    got = tables.damaged_rows(spark, str(tmp_path / "a.csv"), "id bigint, t string").collect()
    assert sorted(r.line for r in got) == ["2,b,LOST", "3", "four,y"]
    assert tables.damaged_counts(spark, str(tmp_path / "a.csv"), "id bigint, t string").first().damaged == 3


def test_streamed_line_breaks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,t\n1,"one\ntwo"\n2,three\n')
    stream = streams.new_files(spark, str(tmp_path / "in"), "csv", tables.T.StructType.fromDDL("id bigint, t string"), multiline=True)
    got = streams.as_batch(lambda s, c: streams.process_new(stream, s, c), spark, str(tmp_path))
    batch = tables.read_table(spark, str(tmp_path / "in" / "a.csv"), schema="id bigint, t string", multiline=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) == [(1, "one\ntwo"), (2, "three")]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    far = N(conf=N(get=lambda *_: None), sparkContext=N(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(far)

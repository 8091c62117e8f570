"""A directory run over files of several kinds, broken ones among them, and the ledger it is written to."""

import pytest
from pyspark.sql import functions as F

from truegrain.operators import ledger
from truegrain.plans.directory import every_input, groups, run_directory
from truegrain.sources.headers import first_lines
from truegrain.sources.tables import read_table


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.csv").write_text('id,name\n1,x\n1,x\n2,\n3,"two\nlines"\n')
    (d / "sub" / "a.csv").write_text("id,name\n1,x\n9,y,surplus\n")
    (d / "b.tsv").write_text("id\tname\n4\tz\n")
    (d / "c.csv").write_text("key,val\nk,1\nk,2\n")
    (d / "lines.json").write_text('{"id": "5", "name": "j"}\n{"id": "5", "name": "j"}\n{"id": "6", "name": null}\n')
    (d / "cut.json").write_text('{"id": "7", "name": "j"}\n{"id": "8", "na\n')
    (d / "doc.json").write_text('[\n{"id": "1", "name": "x"}\n]\n')
    (d / "empty.csv").write_text("")
    (d / "head.csv").write_text("id,name\n")
    (d / "junk.csv").write_bytes(bytes(range(1, 9)) * 50)
    (d / "junk.parquet").write_bytes(b"PAR1 this is no table PAR1")
    (d / "notes.txt").write_text("not listed")
    return d


def test_run(spark, folder, tmp_path):
    spark.createDataFrame([("1", "x"), ("1", "x"), ("2", None)], "id string, name string").coalesce(1).write.parquet(str(folder / "table.parquet"))
    reference = spark.createDataFrame([(1, "x", "p"), (6, None, "q")], "id long, name string, more string")
    out = str(tmp_path / "out")
    rows = run_directory(spark, str(folder), out, reference=reference).collect()
    got = {r.source_file.split("/in/")[1].split("/part-")[0]: r for r in rows}
    assert set(got) == {"a.csv", "sub/a.csv", "b.tsv", "c.csv", "lines.json", "cut.json", "doc.json", "empty.csv", "head.csv", "junk.csv", "junk.parquet", "table.parquet"}
    failed = {k for k, r in got.items() if r.status == "failed"}
    assert failed == {"cut.json", "empty.csv", "junk.csv", "junk.parquet"} and all(got[k].error for k in failed)
    figures = lambda k: (got[k].total_rows, got[k].missing_cells, got[k].incomplete_rows, got[k].duplicate_rows, got[k].rows_written, got[k].known_rows)
    assert figures("a.csv") == (4, 1, 1, 1, 3, 2)
    assert figures("sub/a.csv") == (2, 0, 0, 0, 2, 1) and got["sub/a.csv"].damaged_rows == 1
    assert figures("b.tsv") == (1, 0, 0, 0, 1, 0)
    assert figures("c.csv") == (2, 0, 0, 0, 2, None) and got["c.csv"].missing_columns == ["id", "name", "more"] and got["c.csv"].extra_columns == ["key", "val"]
    assert figures("lines.json") == (3, 1, 1, 1, 2, 1)
    assert figures("doc.json") == (1, 0, 0, 0, 1, 1)
    assert figures("head.csv") == (0, 0, 0, 0, 0, None)
    assert figures("table.parquet") == (3, 1, 1, 1, 2, 2) and got["a.csv"].missing_columns == ["more"]
    assert {got["a.csv"].output, got["sub/a.csv"].output} == {"a_processed.csv", "a_processed_2.csv"}
    back = read_table(spark, f"{out}/output={got['a.csv'].output}", "csv", multiline=True)
    assert back.columns == ["id", "name", "in_reference", "is_incomplete", "missing_value_count", "completeness_score", "quality_flag"]
    assert sorted((r.id, r.name, r.in_reference, r.is_incomplete) for r in back.collect()) == [
        ("1", "x", "true", "false"), ("2", None, "false", "true"), ("3", "two\nlines", "false", "false")
    ]


def test_groups_and_use_cases(spark, folder, tmp_path):
    found, failed = groups(spark, every_input(spark, str(folder)))
    assert sorted((g.kind, len(g.paths)) for g in found) == [("csv", 1), ("csv", 3), ("json", 1), ("json", 2), ("tsv", 1)]
    assert {e for _, e in failed if "Parquet" not in e and "parquet" not in e} == {"no header", "no text"}
    rows = run_directory(spark, str(folder), str(tmp_path / "out4"), ["UC4"]).filter("kind = 'json' and status = 'completed'").collect()
    assert sorted(r.rows_written for r in rows) == [1, 2]
    with pytest.raises(ValueError, match="unknown use cases"):
        run_directory(spark, str(folder), str(tmp_path / "x"), ["UC9"])


def test_first_lines_read_little(spark, tmp_path):
    (tmp_path / "long.json").write_text("\n \n" + '{"a": 1}\n' * 200000)
    (tmp_path / "short.json").write_text("[1]\n")
    got = {r.file.rsplit("/", 1)[1]: r.line for r in first_lines(spark, str(tmp_path)).collect()}
    assert got == {"long.json": '{"a": 1}', "short.json": "[1]"}


def test_first_lines_of_many_files_take_few_tasks(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"f{k:02}.json").write_text("\n" * (k % 3) + f'[{{"a": {k}}},\n{{"a": 0}}]\n' if k % 5 else "\n \n")
    (tmp_path / "long.json").write_text('{"a": "first"}\n' + '{"a": "later", "b": "' + "x" * 1000 + '"}\n' * 40000)
    tracker, group = spark.sparkContext.statusTracker(), "first lines"
    spark.sparkContext.setJobGroup(group, group)
    got = {r.file.rsplit("/", 1)[1]: r.line for r in first_lines(spark, str(tmp_path)).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {**{f"f{k:02}.json": f'[{{"a": {k}}},' for k in range(60) if k % 5}, "long.json": '{"a": "first"}'}
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < 30


def test_ledger_is_appended_and_compacted(spark, folder, tmp_path):
    results = run_directory(spark, str(folder), str(tmp_path / "out"))
    path = str(tmp_path / "ledger")
    for k in (1, 2):
        ledger.append_entries(ledger.run_entries(results, "UC1,UC4", F.timestamp_seconds(F.lit(1000 * k))), path)
    book = spark.read.parquet(path)
    n = results.count()
    now = ledger.current_jobs(book)
    assert book.count() == 2 * n and now.count() == n and now.filter("seq <> 2000000000").isEmpty()
    ledger.compacted(book, str(tmp_path / "compact"))
    again = spark.read.parquet(str(tmp_path / "compact"))
    assert sorted(again.collect()) == sorted(now.collect())
    detail = ledger.job_detail(now, "output_file_path string, total_rows bigint").filter("filename = 'c.csv'").first()
    assert detail.results.total_rows == 2 and detail.results.output_file_path == "c_processed.csv"
    assert ledger.run_activity(now, "quality").filter("activity_details like '%failed%'").count() == 4


def test_current_jobs_splits_a_hot_job(spark):
    rows = spark.range(5000).select(F.lit(7).alias("job_id"), (F.col("id") % 100).alias("updated_at"), "id").withColumnRenamed("id", "seq")
    df = ledger.current_jobs(rows.repartition(6))
    assert [tuple(r) for r in df.collect()] == [(7, 99, 4999)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan

"""A folder of files of several kinds and columns, each file judged on its own, in one run.

Files with equal kind and columns are one group and are read, judged and written by one plan; their
rows carry the file they come from. A file that can't be read is found by halving the group it is in,
is reported with its error, and doesn't keep the others from being finished.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegrain.functions.hashing import row_digest
from truegrain.functions.missing import any_of, missing_count, missing_tests, ref
from truegrain.functions.session import materialised
from truegrain.operators.duplicates import dedup
from truegrain.operators.rows import flag_rows
from truegrain.sources.files import list_inputs
from truegrain.sources.headers import first_lines
from truegrain.sources.tables import DAMAGED, FORMATS, csv_options, output_path, stem, write_processed

FILE, ROW, KNOWN, OUTPUT = "source_file", "_row", "in_reference", "output"
#: Columns of a run's results, with their types.
RESULT = {
    "source_file": "string", "output": "string", "kind": "string", "status": "string", "error": "string", "total_rows": "bigint", "damaged_rows": "bigint",
    "missing_cells": "bigint", "incomplete_rows": "bigint", "completeness_pct": "double", "duplicate_groups": "bigint", "duplicate_rows": "bigint",
    "rows_written": "bigint", "known_rows": "bigint", "missing_columns": "array<string>", "extra_columns": "array<string>",
}


@dataclass(frozen=True)
class Group:
    """Files of one kind with one header."""

    kind: str
    header: str
    paths: tuple[str, ...]


def _header(kind: Column, line: Column) -> Column:
    """What makes files of a text kind alike: the header line, or the keys of the first record of JSON lines."""
    record = F.array_join(F.array_sort(F.json_object_keys(line)), ",")
    return F.when(kind == "json", F.coalesce(record, F.lit("document"))).otherwise(line)


def _message(e: Exception) -> str:
    return str(e).strip().splitlines()[0][:500]


def groups(spark: SparkSession, inputs: DataFrame) -> tuple[list[Group], list[tuple[str, str]]]:
    """The groups of the listed files (path, extension), and (path, error) of files whose header can't be used.

    Only first lines and Parquet footers are read. The driver knows files, as for any read, and no rows.
    """
    listed = inputs.select("path", F.col("extension").alias("kind"))
    found, failed = [], []
    texts = [r.path for r in listed.filter("kind <> 'parquet'").select("path").collect()]
    if texts:
        lines = first_lines(spark, texts)
        # listings escape names in their own way, so both sides are compared as written in the metadata of a scan
        per = listed.filter("kind <> 'parquet'").join(lines, F.col("path") == F.col("file"), "left")
        strange = F.col("line").rlike(r"[\x00-\x08\x0E-\x1F\x{FFFD}]")
        error = F.when(F.col("line").isNull(), "no header").when(strange, "no text")
        per = per.select("path", "kind", error.alias("error"), F.when(error.isNull(), _header(F.col("kind"), F.col("line"))).alias("header"))
        for r in per.groupBy("kind", "error", "header").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect():
            if r.error:
                failed += [(p, r.error) for p in r.paths]
            else:
                found.append(Group(r.kind, r.header, tuple(r.paths)))
    same: dict[str, list[str]] = {}
    for r in listed.filter("kind = 'parquet'").select("path").collect():
        try:
            same.setdefault(spark.read.parquet(r.path).schema.simpleString(), []).append(r.path)
        except (PySparkException, Py4JJavaError) as e:
            failed.append((r.path, _message(e)))
    found += [Group("parquet", s, tuple(sorted(p))) for s, p in same.items()]
    return sorted(found, key=lambda g: (g.kind, g.header)), failed


def _reader(spark: SparkSession, group: Group) -> Callable[[Sequence[str]], DataFrame]:
    """How files of the group are read, with DAMAGED where a CSV row doesn't fit."""
    if group.kind in ("csv", "tsv"):
        names = spark.read.options(**csv_options(group.kind)).csv(group.paths[0]).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, DAMAGED]])
        options = csv_options(group.kind, multiline=True) | {"columnNameOfCorruptRecord": DAMAGED}
        return lambda paths: spark.read.schema(schema).options(**options).csv(list(paths))
    if group.kind == "json":
        reader = lambda: spark.read.option("multiLine", group.header == "document").option("mode", "FAILFAST")
        return lambda paths: reader().json(list(paths)).withColumn(DAMAGED, F.lit(None).cast("string"))
    return lambda paths: spark.read.parquet(*paths).withColumn(DAMAGED, F.lit(None).cast("string"))


def staged(read: Callable[[Sequence[str]], DataFrame], paths: Sequence[str]) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """Tables of the files that can be read, with FILE and ROW (their order), and (path, error) of the others.

    Files are read once into the shared folder; where that fails, the halves are tried on their own.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    try:
        return [materialised(read(paths).select("*", F.col("_metadata.file_path").alias(FILE), place.alias(ROW)))], []
    except (PySparkException, Py4JJavaError) as e:
        if len(paths) == 1:
            return [], [(paths[0], _message(e))]
        half = len(paths) // 2
        a, b = staged(read, paths[:half]), staged(read, paths[half:])
        return a[0] + b[0], a[1] + b[1]


def output_names(paths: DataFrame, suffix: str = "_processed") -> DataFrame:
    """path, output: {stem}{suffix}.csv; files of one stem get a number from the second on, by path."""
    nth = F.row_number().over(Window.partitionBy(stem(F.col("path"))).orderBy("path"))
    name = F.element_at(F.split(output_path("path", suffix), "/"), -1)
    plain = F.regexp_replace(name, r"\.csv$", "")
    return paths.select("path", F.when(nth == 1, name).otherwise(F.concat(plain, F.lit("_"), nth.cast("string"), F.lit(".csv"))).alias(OUTPUT))


def _with_known(df: DataFrame, names: Sequence[str], reference: DataFrame | None) -> DataFrame:
    """Adds KNOWN: whether a row's columns equal those of a row of the reference, compared as text; null without a shared column."""
    shared = [c for c in names if reference is not None and c in reference.columns]
    if not shared:
        return df.withColumn(KNOWN, F.lit(None).cast("boolean"))
    content = F.struct(*[ref(c).cast("string").alias(c) for c in shared])
    digest = F.unhex(F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256))
    keys = reference.select(digest.alias("_known")).distinct()
    both = df.withColumn("_d", digest).join(keys, F.col("_d") == F.col("_known"), "left")
    return both.withColumn(KNOWN, F.col("_known").isNotNull()).drop("_d", "_known")


def judged(df: DataFrame, names: Sequence[str], critical: Sequence[str] | None, sentinels: Iterable[str]) -> DataFrame:
    """Per file: rows, missing cells, incomplete rows, duplicates and known rows, from one aggregate by row content."""
    tests = missing_tests(df, names, sentinels)
    of = list(missing_tests(df, [c for c in critical or names if c in names] or names, sentinels).values())
    per = df.select(FILE, row_digest(df, names).alias("_h"), missing_count(tests.values()).alias("_m"), any_of(of).alias("_bad"), KNOWN, F.col(DAMAGED).isNotNull().alias("_dam"))
    one = per.groupBy(FILE, "_h").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_m").alias("missing"), F.count_if("_bad").alias("bad"), F.count_if(KNOWN).alias("known"),
        F.count(KNOWN).alias("asked"), F.count_if("_dam").alias("damaged"),
    )
    cells = (F.sum("n") * len(tests)).cast("double")
    return one.groupBy(FILE).agg(
        F.sum("n").alias("total_rows"), F.sum("damaged").alias("damaged_rows"), F.sum("missing").alias("missing_cells"), F.sum("bad").alias("incomplete_rows"),
        (F.lit(100.0) * (cells - F.sum("missing")) / cells).alias("completeness_pct"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"),
        F.count(F.lit(1)).alias("distinct_rows"), F.when(F.sum("asked") > 0, F.sum("known")).alias("known_rows"),
    )


def every_input(spark: SparkSession, folder: str) -> DataFrame:
    """path, extension of all supported files below the folder, files without a byte included, which no scan shows."""
    listed = list_inputs(spark, folder).select("path", "extension")
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).inputFiles()
    paths = spark.createDataFrame([(unquote(n),) for n in names], "path string")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = paths.select(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/").alias("path"), ext.alias("extension")).filter(F.col("extension").isin(list(FORMATS)))
    plain = listed.select(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/").alias("path"))
    return listed.unionByName(known.join(plain, "path", "left_anti"))


def run_directory(
    spark: SparkSession,
    folder: str,
    out: str,
    use_cases: Sequence[str] = ("UC1", "UC4"),
    reference: DataFrame | None = None,
    critical_cols: Sequence[str] | None = None,
    sentinels: Iterable[str] = (),
    fmt: str = "csv",
) -> DataFrame:
    """Runs every supported file below `folder` through UC1 (flags), UC4 (duplicates removed) or both, and writes it to `out`.

    A processed file is the folder output={stem}_processed.csv below `out`, which must not exist: the rows of
    the file in their columns, with the flags of UC1, and in_reference where a reference is given. Duplicates
    are judged within a file; the first row of each stays. Returns one row per input file: its figures, or
    status failed with the error. A file with a header and no rows is completed with zero rows.
    """
    unknown = set(use_cases) - {"UC1", "UC4"}
    if unknown or not use_cases:
        raise ValueError(f"unknown use cases {sorted(unknown)}; choose from UC1, UC4")
    sentinels = list(sentinels)
    inputs = materialised(every_input(spark, folder))
    names_of = materialised(output_names(inputs.select("path")))
    found, failed = groups(spark, inputs)
    results, mode = [], "errorifexists"
    for g in found:
        try:
            read = _reader(spark, g)
            parts, bad = staged(read, g.paths)
        except (PySparkException, Py4JJavaError) as e:
            parts, bad = [], [(p, _message(e)) for p in g.paths]
        failed += bad
        done = spark.createDataFrame([(p,) for p in g.paths if p not in {b for b, _ in bad}], "path string")
        counted = None
        for df in parts:
            names = [c for c in df.columns if c not in (FILE, ROW, DAMAGED)]
            with_known = _with_known(df, names, reference)
            rows = with_known.select(*[ref(c) for c in names], FILE, ROW, KNOWN)
            if "UC1" in use_cases:
                rows = flag_rows(rows, [c for c in critical_cols or names if c in names] or names, names, sentinels)
            if "UC4" in use_cases:
                rows = dedup(rows, [*names, FILE], "first", ROW)
            written = rows.join(names_of, F.col(FILE) == F.col("path")).drop(FILE, ROW, "path", *([] if reference is not None else [KNOWN]))
            write_processed(written, out, fmt, [OUTPUT], mode)
            mode = "append"
            one = judged(with_known, names, critical_cols, sentinels)
            counted = one if counted is None else counted.unionByName(one)
            lacks = [c for c in reference.columns if c not in names] if reference is not None else None
            extra = [c for c in names if c not in reference.columns] if reference is not None else None
        if counted is None:
            continue
        texts = lambda v: F.lit(None).cast("array<string>") if v is None else F.array(*[F.lit(c) for c in v]).cast("array<string>")
        zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("total_rows", "damaged_rows", "missing_cells", "incomplete_rows", "duplicate_groups", "duplicate_rows")}
        kept = "distinct_rows" if "UC4" in use_cases else "total_rows"
        results.append(
            done.join(counted, F.col("path") == F.col(FILE), "left").drop(FILE).join(names_of, "path").select(
                F.col("path").alias(FILE), OUTPUT, F.lit(g.kind).alias("kind"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"),
                *[v.alias(c) for c, v in zero.items() if c != "duplicate_groups" and c != "duplicate_rows"], "completeness_pct",
                zero["duplicate_groups"].alias("duplicate_groups"), zero["duplicate_rows"].alias("duplicate_rows"),
                F.coalesce(F.col(kept), F.lit(0)).cast("bigint").alias("rows_written"), F.col("known_rows").cast("bigint").alias("known_rows"),
                texts(lacks).alias("missing_columns"), texts(extra).alias("extra_columns"),
            )
        )
    bad = spark.createDataFrame(failed, "path string, error string").join(inputs, "path")
    rows = bad.select(F.col("path").alias(FILE), F.col("extension").alias("kind"), F.lit("failed").alias("status"), "error")
    for r in results:
        rows = rows.unionByName(r, allowMissingColumns=True)
    return materialised(rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in RESULT.items()]))

"""Questions to the job ledger, the activity log and the registry of reference files.

All three are append-only tables; the present state is always derived, nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truegrain.functions import bands
from truegrain.functions.missing import ref
from truegrain.functions.quantiles import exact_quantiles

# Status groups of the job ledger.
PENDING = ["uploaded", "pending", "queued"]
PROCESSING = [
    "processing", "processing_uc1", "processing_uc4", "analyzing_completeness", "detecting_duplicates", "cleaning_file",
]


def job_statistics(jobs: DataFrame) -> DataFrame:
    """Jobs in total and by state, with the average quality score."""
    s = F.col("status")
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(s.isin(PENDING)).alias("pending_jobs"),
        F.count_if(s.isin(PROCESSING)).alias("processing_jobs"),
        F.count_if(s == "completed").alias("completed_jobs"),
        F.count_if(s == "failed").alias("failed_jobs"),
        F.avg("quality_score").alias("average_quality_score"),
    )


def batch_status(jobs: DataFrame, by: Sequence[str] = (), ids: Sequence[int] | None = None) -> DataFrame:
    """Overall state of each set of jobs (or of the given ids)."""
    s = F.col("status")
    chosen = jobs if ids is None else jobs.filter(F.col("id").isin(list(ids)))
    return (
        chosen.groupBy(*[ref(c) for c in by])
        .agg(
            F.count(F.lit(1)).alias("total_jobs"),
            F.count_if(s == "completed").alias("completed_jobs"),
            F.count_if(s == "failed").alias("failed_jobs"),
            F.count_if(s.isin("processing", "queued")).alias("_open"),
        )
        .withColumn(
            "overall_status",
            F.when((F.col("total_jobs") > 0) & (F.col("completed_jobs") == F.col("total_jobs")), "completed")
            .when(F.col("failed_jobs") > 0, "partial_failure")
            .when(F.col("_open") > 0, "in_progress")
            .otherwise("unknown"),
        )
        .drop("_open")
    )


def list_jobs(jobs: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of jobs, newest first."""
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(limit)


def activity(log: DataFrame, agent: str | None = None, job: int | None = None, n: int = 50) -> DataFrame:
    """The latest n entries of the activity log."""
    if agent is not None:
        log = log.filter(F.col("agent_name") == agent)
    if job is not None:
        log = log.filter(F.col("job_id") == job)
    return log.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def active_reference(registry: DataFrame) -> DataFrame:
    """The active reference file per use case: the latest entry not switched off."""
    w = Window.partitionBy("uc_type").orderBy(F.desc("created_at"), F.desc("id"))
    return registry.filter("is_active").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def reference_history(registry: DataFrame, uc: str) -> DataFrame:
    """All entries of a use case, newest first, with the number of active ones."""
    own = registry.filter(F.col("uc_type") == uc)
    active = own.agg(F.count_if("is_active").alias("c")).scalar()
    return own.select("*", active.alias("active_count")).orderBy(F.desc("created_at"), F.desc("id"))


def register_reference(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Registry with new entries appended; older ones of the same use case count as replaced.

    `active_reference` derives the current one, so no row is rewritten.
    """
    return registry.unionByName(entries)


def stuck_jobs(jobs: DataFrame, now: Column | None = None, min_age_minutes: float | None = None) -> DataFrame:
    """Jobs in a working state (`stuck`) or waiting (`queued`), optionally only those older than an age."""
    found = jobs.filter(F.col("status").isin(PROCESSING + ["queued"])).withColumn(
        "state", F.when(F.col("status") == "queued", "queued").otherwise("stuck")
    )
    if min_age_minutes is not None:
        moment = F.current_timestamp() if now is None else now
        age = F.timestamp_diff("SECOND", F.col("created_at"), moment)
        found = found.filter(age > min_age_minutes * 60)
    return found


def missing_inputs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Waiting jobs whose input file is not among the files (column `path`)."""
    known = files.select(F.col("path").alias("file_path")).distinct()
    return jobs.filter(F.col("status").isin(PENDING)).join(known, "file_path", "left_anti")


def classify_durations(log: DataFrame, ms: str = "duration_ms") -> DataFrame:
    """Adds speed_class (fast, normal, slow) and is_warning to each logged operation."""
    return log.withColumns({"speed_class": bands.speed_class(ref(ms)), "is_warning": ref(ms) > 10000})


def processing_metrics(jobs: DataFrame, by: Sequence[str] = ("filename",)) -> DataFrame:
    """Runs, total and longest duration in milliseconds, and issues found, per file."""
    return jobs.groupBy(*[ref(c) for c in by]).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("longest_ms"),
        F.sum("issues_found").alias("issues_found"),
    )


def service_metrics(jobs: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Per time window: jobs, success and failure share, throughput per minute, 95th percentile of duration."""
    w = F.window("created_at", width)
    minutes = F.timestamp_diff("SECOND", F.col("w.start"), F.col("w.end")).cast("double") / F.lit(60.0)
    s = F.col("status")
    n = F.col("jobs").cast("double")
    slow = exact_quantiles(jobs.select(w["start"].alias("_at"), "duration_ms"), ["_at"], "duration_ms", [0.95])
    slow = slow.select("_at", F.col("quantile").alias("p95_ms"))
    return (
        jobs.groupBy(w.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            F.count_if(s == "completed").alias("completed"),
            F.count_if(s.isin("failed", "cleaning_failed")).alias("failed"),
        )
        .join(slow, F.col("w.start") == F.col("_at"), "left")
        .select(
            F.col("w.start").alias("window_start"),
            "jobs",
            (F.col("completed").cast("double") / n).alias("success_rate"),
            (F.col("failed").cast("double") / n).alias("failure_rate"),
            (n / minutes).alias("jobs_per_minute"),
            "p95_ms",
        )
    )


def error_frequencies(jobs: DataFrame) -> DataFrame:
    """How often each error message occurs."""
    return jobs.filter("error_message IS NOT NULL").groupBy("error_message").agg(F.count(F.lit(1)).alias("occurrences"))


def current_jobs(ledger: DataFrame, job: str = "job_id", updated: str = "updated_at", seq: str = "seq") -> DataFrame:
    """The latest entry of every job in an append-only ledger: the greatest (updated, seq).

    The latest entry is a mergeable maximum, kept per input partition before the shuffle, so a job with
    very many entries sends one row per partition.
    """
    latest = F.max_by(F.struct(*[ref(c) for c in ledger.columns]), F.struct(ref(updated), ref(seq)))
    return ledger.groupBy(ref(job).alias("_job")).agg(latest.alias("_l")).select(*[F.col("_l").getField(c).alias(c) for c in ledger.columns])


def append_entries(entries: DataFrame, path: str) -> None:
    """Add entries to the ledger below `path`; nothing there is changed. Two appends at a time don't disturb each other."""
    entries.write.mode("append").parquet(path)


def compacted(ledger: DataFrame, path: str, **names) -> None:
    """Write the latest entry of every job to a new ledger; the old one stays until its owner removes it."""
    current_jobs(ledger, **names).write.parquet(path)


def run_entries(results: DataFrame, job_type: str, at: Column | None = None, duration_ms: Column | None = None) -> DataFrame:
    """Ledger entries for the files of a directory run: job_id (from the path), seq, updated_at, status, results_json, and so on."""
    moment = F.current_timestamp() if at is None else at
    counts = ["output", "total_rows", "rows_written", "missing_cells", "incomplete_rows", "duplicate_rows", "known_rows"]
    told = F.to_json(F.struct(F.col("output").alias("output_file_path"), *counts[1:]))
    return results.select(
        F.xxhash64("source_file").alias("job_id"), F.unix_micros(moment).alias("seq"), moment.alias("updated_at"),
        F.col("source_file").alias("file_path"), F.element_at(F.split("source_file", "/"), -1).alias("filename"), F.lit(job_type).alias("job_type"),
        "status", F.when(F.col("status") == "completed", told).alias("results_json"), F.col("error").alias("error_message"),
        F.col("completeness_pct").alias("quality_score"), (F.coalesce("incomplete_rows", F.lit(0)) + F.coalesce("duplicate_rows", F.lit(0))).alias("issues_found"),
        (F.lit(None) if duration_ms is None else duration_ms).cast("bigint").alias("duration_ms"),
    )


def run_activity(entries: DataFrame, agent: str) -> DataFrame:
    """Activity log of ledger entries: id, job_id, agent_name, activity_details, timestamp."""
    return entries.select(
        F.xxhash64("job_id", "seq").alias("id"), "job_id", F.lit(agent).alias("agent_name"),
        F.concat_ws(": ", "filename", "status", "error_message").alias("activity_details"), F.col("updated_at").alias("timestamp"),
    )


def job_detail(jobs: DataFrame, schema: str = "output_file_path string, rows bigint") -> DataFrame:
    """Results parsed from JSON; results_raw keeps the text where it does not parse."""
    parsed = F.from_json("results_json", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = jobs.withColumn("_p", parsed)
    ok = F.col("results_json").isNotNull() & F.col("_p").isNotNull() & F.col("_p._bad").isNull()
    return out.select(
        *[ref(c) for c in jobs.columns if c != "results_json"],
        F.when(ok, F.col("_p").dropFields("_bad")).alias("results"),
        F.when(~ok, F.col("results_json")).alias("results_raw"),
    )


def job_result_row(report: DataFrame, job_id: int) -> DataFrame:
    """Ledger columns filled from a duplicate report."""
    return report.select(
        F.lit(job_id).cast("bigint").alias("job_id"),
        (F.col("duplicate_rows_removed") > 0).alias("has_duplicates"),
        F.col("duplicate_rows_removed").alias("duplicate_count"),
        "duplicate_percentage",
        "total_rows_original",
        "total_rows_processed",
    )


def list_outputs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Output files of completed jobs that exist, newest first, with the batch name from the path."""
    done = jobs.filter("status = 'completed' AND results_json IS NOT NULL").select(
        F.col("id").alias("job_id"),
        "filename",
        F.get_json_object("results_json", "$.output_file_path").alias("path"),
    )
    batch = F.regexp_extract("path", r"(?:^|/)(batch_[^/]+)/", 1)
    return (
        done.join(files, "path")
        .withColumn("batch_name", F.when(batch == "", "individual").otherwise(batch))
        .orderBy(F.desc("modified_at"), F.desc("job_id"))
    )

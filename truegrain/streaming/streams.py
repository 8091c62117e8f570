"""The same checks on files as they arrive (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from threading import Event
from uuid import UUID

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from truegrain.functions.missing import missing_count, missing_tests, ref
from truegrain.operators.rows import flag_rows
from truegrain.sources.tables import FORMATS, csv_options


def new_files(
    spark: SparkSession,
    folder: str,
    fmt: str,
    schema: T.StructType,
    glob: str | None = None,
    files_per_batch: int | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Stream of the rows of files not seen before; the stream's checkpoint is the manifest.

    CSV and TSV are read with the options of batches; `multiline` as there.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; choose from {', '.join(FORMATS)}")
    reader = spark.readStream.schema(schema).format("csv" if fmt == "tsv" else fmt)
    if fmt in ("csv", "tsv"):
        reader = reader.options(**csv_options(fmt, multiline))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


class _Counts(StreamingQueryListener):
    """Adds up what the progress of one query reports; batches are counted as they end, however many there are."""

    def __init__(self) -> None:
        self.query, self.ended = None, Event()
        self.waiting: list = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.waiting.append((p.runId, p.numInputRows, sum(s.numRowsDroppedByWatermark for s in p.stateOperators)))

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.query:
            self.ended.set()

    def onQueryIdle(self, event) -> None:
        pass

    def of(self, run) -> dict[str, int]:
        mine = [w for w in self.waiting if w[0] == run]
        return {"batches": len(mine), "input_rows": sum(w[1] for w in mine), "late_rows": sum(w[2] for w in mine)}


def process_new(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> dict[str, int]:
    """Process what has arrived since the last run, append it to the sink, and stop.

    Returns batches, input_rows and late_rows of the run; late rows are those that a stateful step dropped
    because they came after the watermark, which earlier runs of the checkpoint have set.
    """
    counts = _Counts()
    spark = stream.sparkSession
    spark.streams.addListener(counts)
    try:
        q = (
            stream.writeStream.format(fmt)
            .option("path", sink)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        counts.query = q.runId if isinstance(q.runId, UUID) else UUID(str(q.runId))
        q.awaitTermination()
        # events of a query arrive in order, the end last; one that was over before its id was known is waited for shortly
        counts.ended.wait(10)
    finally:
        spark.streams.removeListener(counts)
    return counts.of(counts.query)


def flag_stream(stream: DataFrame, critical_cols: Sequence[str] | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """Row flags on a stream: stateless, so it is the batch operator itself."""
    return flag_rows(stream, critical_cols, cols)


def distinct_stream(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """First row per key; a key is remembered for at least `delay` of event time, which bounds the state.

    Rows that arrive later than the watermark are dropped; `process_new` counts them.
    """
    timed = stream.withColumn("_event_time", ref(ts).cast("timestamp"))
    return timed.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(list(keys)).drop("_event_time")


def completeness_stream(
    stream: DataFrame,
    ts: str,
    cols: Sequence[str],
    width: str = "1 hour",
    slide: str | None = None,
    delay: str = "1 hour",
    sentinels: Iterable[str] = (),
) -> DataFrame:
    """Rows and missing cells per tumbling or sliding window of event time."""
    tests = missing_tests(stream, cols, sentinels)
    flagged = stream.select(
        ref(ts).cast("timestamp").alias("_event_time"), missing_count(tests.values()).alias("_m")
    ).withWatermark("_event_time", delay)
    n = len(tests)
    return (
        flagged.groupBy(F.window("_event_time", width, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("_m").alias("missing_cells"))
        .select(
            F.col("w.start").alias("window_start"),
            "rows",
            "missing_cells",
            (F.col("missing_cells").cast("double") / (F.col("rows") * n).cast("double")).alias("missing_ratio"),
        )
    )


def publish_updates(agg: DataFrame, sink: str, checkpoint: str) -> None:
    """Write every changed window with the number of its micro-batch; a batch run again replaces itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={batch_id}")

    q = (
        agg.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def latest_updates(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    """The present value of every key in the published updates."""
    w = Window.partitionBy(*[ref(k) for k in keys]).orderBy(F.desc("batch"))
    return (
        spark.read.parquet(sink)
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .drop("_rn", "batch")
    )


def as_batch(run: Callable[[str, str], None], spark: SparkSession, folder: str) -> DataFrame:
    """Run a stream to the end of the present input and read its sink."""
    sink, checkpoint = f"{folder}/sink", f"{folder}/checkpoint"
    run(sink, checkpoint)
    return spark.read.parquet(sink)

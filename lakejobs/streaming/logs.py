"""Live log follow and windowed rates as Structured Streaming jobs
(OBS-20, OBS-21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.operators.telemetry import grep
from lakejobs.schemas import LOG_LINE
from lakejobs.sources.raw import JSON_OPTIONS
from lakejobs.streaming.ingest import FILES_PER_BATCH, write_batch


def log_stream(spark: SparkSession, path: str, schema=LOG_LINE, max_files_per_batch=FILES_PER_BATCH) -> DataFrame:
    return (spark.readStream.schema(schema).options(**JSON_OPTIONS)
            .option("maxFilesPerTrigger", max_files_per_batch).json(path))


def follow(spark: SparkSession, path: str, checkpoint: str, sink_path: str,
           text: str | None = None, until_done: bool = True):
    """Lines matching ``text`` (case-insensitive; all lines when empty) as
    they arrive, written to ``sink_path``. ``until_done`` processes what is
    there and stops (availableNow); otherwise the query keeps running."""
    lines = grep(log_stream(spark, path), text)
    w = (lines.writeStream.foreachBatch(lambda df, bid: write_batch(df, bid, sink_path))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if until_done else w.trigger(processingTime="5 seconds")
    q = w.start()
    if until_done:
        q.awaitTermination()
    return q


def level_of(line_col: str = "line"):
    """First word of a log line, upper case (e.g. ERROR, PURCHASE)."""
    return F.upper(F.split(F.col(line_col), " ").getItem(0))


def rate(lines: DataFrame, every: str = "1 hour", ts_col: str = "ts", by: str = "level") -> DataFrame:
    """Count per event-time window and ``by`` value, over all given rows."""
    return (lines.groupBy(F.window(ts_col, every).alias("w"), F.col(by))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n"))


def run_rate(spark: SparkSession, path: str, checkpoint: str, sink_path: str,
             every: str = "1 hour", max_files_per_batch=FILES_PER_BATCH):
    """Work off the files present, in any order of time, and store each batch's
    own counts under its ``batch_id``; :func:`read_rate` adds them up. There is
    no watermark and no state, so no row is too late, and a replayed batch
    replaces its counts. Use a new checkpoint and sink for every ``every``."""
    stream = log_stream(spark, path, max_files_per_batch=max_files_per_batch).withColumn("level", level_of())
    q = (stream.writeStream
         .foreachBatch(lambda df, bid: write_batch(rate(df, every), bid, sink_path))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_rate(spark: SparkSession, sink_path: str, by: str = "level") -> DataFrame:
    """One row per window and ``by`` value: the sum of the batches' counts."""
    return (spark.read.parquet(sink_path).groupBy("window_start", "window_end", by)
            .agg(F.sum("n").alias("n")))

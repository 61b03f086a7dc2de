"""Incremental batches of events, as streams that take what is there and stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.plans.registry import query
from ledgerlake.sources.sinks import shared_path

DAYS = 7


def events(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream of event files; the schema is that of the files there. A stream's source is a folder or a pattern, so that one file is named by a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, home: str) -> DataFrame:
    """Run a streaming aggregate over all files not yet seen and return its whole table.

    home holds the checkpoint and a version of the table a batch. A batch that is run again after a failure writes the
    same version again, so no row counts twice.
    """

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{home}/table/batch={batch}")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    versions = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{home}/table")
    last = versions.agg(F.max("batch")).first()[0]
    return versions.where(F.col("batch") == F.lit(last)).drop("batch")


def admissions(stream: DataFrame) -> DataFrame:
    """(user_id, first_event, conflict): the first admission of a key stays; records that differ are told."""
    return stream.groupBy("user_id").agg(F.min("event_id").alias("first_event"), (F.min("props") != F.max("props")).alias("conflict"))


def windows(stream: DataFrame) -> DataFrame:
    """(start, close, n, value) of windows (start, close]: Spark's are [start, end), hence the shift by a microsecond."""
    at = F.window(F.col("ts").cast("timestamp") - F.expr("interval 1 microsecond"), f"{DAYS} days", startTime="4 days")
    g = stream.groupBy(at.alias("w")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("close"), "n", "cents")


@query("SELECT user_id, CAST(min(event_id) AS BIGINT) AS first_event, min(props) <> max(props) AS conflict FROM events GROUP BY user_id")
def stream_admissions(spark, sf_dir):
    """Keyed first admission in Structured Streaming; a second run would take up new files only."""
    return drain(admissions(events(spark, f"{sf_dir}/events.parque[t]")), shared_path(spark, "admissions"))


_AT = f"(epoch_us(ts) - 1 - {4 * 86400 * 10**6}) // {DAYS * 86400 * 10**6} * {DAYS * 86400} + {4 * 86400}"


@query(f"SELECT CAST({_AT} AS BIGINT) AS start, CAST({_AT} + {DAYS * 86400} AS BIGINT) AS close, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Weekly batches by event time; all are complete tables, for late rows must not be dropped."""
    return drain(windows(events(spark, f"{sf_dir}/events.parque[t]")), shared_path(spark, "windows"))

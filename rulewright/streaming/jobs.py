"""The event-time operators and the feedback job as Structured Streaming queries.

request_counts, first_requests and rates are for live streams: a watermark bounds their state, and rows later than that
are dropped. The queries read a backlog whose files may come in any order of time: each batch leaves partial results
without a watermark, and these are merged by key when all are there, so no row is late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright import operators
from rulewright.sources.files import scratch


def events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the events files in a folder."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return read.parquet(folder if folder.endswith("events.parquet") else f"{folder}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def request_counts(stream: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests by bucket, subject and fixed window; state is dropped when the watermark passes a window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("bucket"), F.col("user_id").alias("subject")).agg(F.count("*").alias("n"))


def first_requests(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each (tenant, request key) inside the watermark; later ones are dropped."""
    keyed = stream.select("event_id", "ts", (F.col("user_id") % 5).alias("tenant"), F.get_json_object("props", "$.k").alias("request_key"))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tenant", "request_key"])


def rates(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events per second over five minutes, every minute, by type."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), F.col("event_type").alias("bucket")).agg(F.count("*").alias("n"))


def drain(result: DataFrame, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there now; state and progress go to the shared folder."""
    at = scratch(result.sparkSession, "stream")
    result.writeStream.outputMode(mode).option("checkpointLocation", at).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def partials(stream: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What step makes of each batch of a stream, after it has been drained. A batch that is run again replaces its own part."""
    spark, path, schema = stream.sparkSession, scratch(stream.sparkSession, "partials"), step(stream).schema
    drain(stream, "append", lambda batch, n: step(batch).write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return spark.read.schema(schema).parquet(path).drop("batch")


def merged_counts(stream: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The counts n that step makes of each batch, summed by its other columns."""
    found = partials(stream, step)
    return found.groupBy(*[c for c in found.columns if c != "n"]).agg(F.sum("n").alias("n"))


def merged_firsts(stream: DataFrame) -> DataFrame:
    """The first event (by time, then id; without a time last) of each (tenant, request key) of a backlog."""
    order = F.struct(F.col("ts").isNull().alias("timeless"), "ts", "event_id")
    keys = (F.col("user_id") % 5).alias("tenant"), F.get_json_object("props", "$.k").alias("request_key")
    found = partials(stream, lambda batch: batch.groupBy(*keys).agg(F.min(order).alias("first")))
    return found.groupBy("tenant", "request_key").agg(F.min("first").alias("first")).select("first.event_id", "first.ts", "tenant", "request_key")


def str_01_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merged_counts(events(spark, sf_dir), request_counts)
    return found.select("bucket", "subject", F.col("w.start").alias("window_start"), "n")


def str_02_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_firsts(events(spark, sf_dir)).select("event_id", "tenant", "request_key")


def str_03_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merged_counts(events(spark, sf_dir), rates)
    return found.select("bucket", F.unix_seconds("w.start").alias("minute_start"), "n", F.round(F.col("n") / 300.0, 6).alias("per_second"))


QUERIES = {"str_01_stream": str_01_stream, "str_02_stream": str_02_stream, "str_03_stream": str_03_stream}
ORACLES = {
    "str_01_stream": "SELECT event_type AS bucket, user_id AS subject, date_trunc('day', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL",
    "str_02_stream": "SELECT event_id, tenant, request_key FROM (SELECT *, row_number() OVER (PARTITION BY tenant, request_key ORDER BY ts NULLS LAST, event_id) AS rn FROM (SELECT event_id, ts, user_id % 5 AS tenant, json_extract_string(props, '$.k') AS request_key FROM events) e) x WHERE rn = 1",
    "str_03_stream": operators.oracle("str_03_rates"),
}

"""Monitoring of a stream of attempts: success by window and type, with late data bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.registry import query
from switchyard.sources.shared import folder
from switchyard.sources.tables import table


def windowed(events: DataFrame, window: str = "1 day", late: str | None = None) -> DataFrame:
    """Events, errors and value by window and type, for batch and stream alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    counts = timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 20).cast("long")).alias("large"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "large", F.round("total", 2).alias("total"))


def run_once(spark: SparkSession, source: str, name: str = "monitor") -> DataFrame:
    """Everything that the folder of Parquet files holds, through the stream, to a table of the session."""
    schema = spark.read.parquet(source).schema
    stream = windowed(spark.readStream.schema(schema).parquet(source), late="2 days")
    job = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{folder(spark)}/switchyard-{uuid.uuid4().hex}-stream").start()
    job.awaitTermination()
    return spark.table(name)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(*) FILTER (value > 20) AS large, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(table(spark, sf_dir, "events"))

"""Streams of files: windowed totals with a watermark, and chain shards as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.sources.shards import scratch


def windowed(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(event_type, window, n, total) of a stream (ts, event_type, value); events later than the watermark allows are dropped."""
    return events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def read_files(spark: SparkSession, folder: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def run_once(stream: DataFrame, folder: str, checkpoint: str, partition: list[str] | None = None) -> None:
    """Everything there is now, appended to parquet files exactly once."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    (writer.partitionBy(*partition) if partition else writer).start().awaitTermination()


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals for each day and type, complete, from a stream over the events files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a glob names either the one file or the files of a folder
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    name = scratch(spark, "events").rsplit("/", 1)[-1].replace("-", "_")
    totals = windowed(stream)
    totals.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    out = spark.table(name)
    return out.select("event_type", F.col("window.start").alias("day"), "n", F.round("total", 4).alias("total"))


def ingest_shards(spark: SparkSession, source: str, target: str, schema, checkpoint: str, glob: str | None = None) -> None:
    """Files of chain rows into year and date folders, each file once; rows without a date go to <target>-rejected."""

    def batch(df: DataFrame, _: int) -> None:
        own = df.withColumns({"year": F.year("date"), "day": F.col("date")})
        own.where("date IS NOT NULL").write.partitionBy("year", "day").mode("append").parquet(target)
        df.where("date IS NULL").write.mode("append").parquet(f"{target}-rejected")

    read_files(spark, source, schema, glob).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

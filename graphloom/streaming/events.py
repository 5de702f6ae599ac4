"""Event-time windows, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import new_path

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in rows.columns if c != "w"])


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return _named(events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("event_id").alias("n"), F.round(F.sum("value"), 4).alias("value")))


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    return _named(events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("event_id").alias("n")))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return _named(events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("event_id").alias("n")))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key in a stream, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_to_end(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all data there is and return its last result, kept in the shared folder."""
    spark = stream.sparkSession
    out = new_path(spark, "stream-result")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint or new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, for the table may be a file or a folder
    return spark.readStream.schema(SCHEMA).parquet(f"{sf_dir}/event[s].parquet")

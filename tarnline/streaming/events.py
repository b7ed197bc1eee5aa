"""Structured Streaming over the events table: windows under a watermark, duplicates within it, and running totals with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 4) -> DataFrame:
    """The events as a stream; ts as an instant, since watermarks need one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    files = source.parquet(f"{sf_dir}/events.parquet")
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total: state is bounded by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without those whose event_id came before, as long as the watermark keeps it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total: after each batch the totals so far of the users in it; the state is two numbers a user."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for x in batches:
            n, total = n + len(x), total + float(x["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    slim = events.select("user_id", "value").groupBy("user_id")
    return slim.applyInPandasWithState(add, "user_id long, n long, total double", "n long, total double", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> None:
    """All that the sources have now, written to a Parquet sink exactly once, then stopped."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drained(df: DataFrame, folder: str) -> DataFrame:
    """What drain() of a streaming frame leaves in a folder that all executors share."""
    drain(df, f"{folder}/checkpoint", f"{folder}/rows")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")

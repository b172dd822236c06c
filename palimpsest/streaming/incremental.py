"""Scoring as rows arrive: each micro-batch goes through the batch functions, and what is scored is not scored again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.chains import unfinished


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Append scores of new keys to a Parquet table. A batch that is run again after a failure finds its keys done."""

    def batch(df: DataFrame, _id: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(keys)
        try:
            fresh = unfinished(fresh, spark.read.parquet(path), keys)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        score(fresh).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_scores(events: DataFrame, length: str = "7 days", late: str = "1 day") -> DataFrame:
    """Mean value per event type and window of event time, rows later than ``late`` left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))

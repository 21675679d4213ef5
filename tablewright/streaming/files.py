"""Continuous processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, folder: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "json") -> int:
    """Processes every file of ``folder`` once, over any number of calls; returns the rows of this call.

    The checkpoint is the record of what is done, so a restart goes on where the last call ended.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(folder)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(int(p["numInputRows"]) for p in query.recentProgress)


def windowed(events: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding windows; ``late`` bounds the state of a stream."""
    src = events if late is None else events.withWatermark(ts, late)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return src.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    src = events if late is None else events.withWatermark(ts, late)
    return src.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))


def previous_answers(turns: DataFrame, predict: Callable[[DataFrame], DataFrame], steps: int, folder: str) -> DataFrame:
    """Answers position by position: ``predict`` sees each position with the answers of the one before.

    Each position's answers are written to ``folder`` (shared, new or empty) and read again, so ``predict`` runs once for
    each and no plan holds an earlier one.
    """
    last: DataFrame | None = None
    for p in range(steps):
        here = turns.where(F.col("position") == p)
        if last is None:
            asked = here.withColumn("previous_answer", F.lit(None).cast("string"))
        else:
            asked = here.join(last.select("sequence_id", F.col("answer").alias("previous_answer")), "sequence_id", "left")
        path = f"{folder}/step={p}"
        predict(asked).write.mode("overwrite").parquet(path)
        last = turns.sparkSession.read.parquet(path)
    if last is None:
        return turns.limit(0).withColumn("answer", F.lit(None).cast("string"))
    return turns.sparkSession.read.schema(last.schema).parquet(*[f"{folder}/step={p}" for p in range(steps)])

"""Durable ingest: messages land as files, and a stream enriches them in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds before a failed row is tried again double up to this power, and never pass the cap.
BACKOFF_POWER, BACKOFF_CAP = 8, 300


def backoff(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), F.least(attempts, F.lit(BACKOFF_POWER))), F.lit(float(BACKOFF_CAP)))


def land(messages: DataFrame, path: str) -> None:
    """Appends messages to the landing folder; each is pending until a stream has taken it."""
    messages.withColumn("status", F.lit("pending")).write.mode("append").parquet(path)


def enrich_queue(spark: SparkSession, landing: str, schema: str, out: str, checkpoint: str, distill: Callable[[DataFrame], DataFrame], now: str, fail: Callable[[int], None] | None = None, files: int = 8) -> None:
    """Distills the queue's due messages (id, content, attempts, next_attempt_at) in micro-batches to id, status, attempts, wait, content.

    distill gives id and content of the facts it found. A due message without a fact failed: it
    is tried again after a wait that doubles; others are done, and what is not due waits as it is. fail, in
    tests, is called before a batch is done.
    """

    def one(batch: DataFrame, number: int) -> None:
        due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
        facts = distill(batch.where(due)).groupBy("id").agg(F.first("content").alias("found"))
        tried = batch.join(facts, "id", "left")
        status = F.when(~due, "waiting").when(F.col("found").isNotNull(), "done").otherwise("retry")
        attempts = (F.col("attempts") + F.when(due, 1).otherwise(0)).cast("int")
        rows = tried.select("id", status.alias("status"), attempts.alias("attempts"), F.when(status == "retry", backoff(attempts)).alias("wait"), F.col("found").alias("content"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if fail is not None:
            fail(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landing)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _retry(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    attempts, done = state.get if state.exists else (0, False)
    for frame in frames:
        for ok in frame["ok"]:
            if not done:
                attempts, done = attempts + 1, bool(ok)
    state.update((attempts, done))
    wait = 0.0 if done else float(min(2 ** min(attempts, BACKOFF_POWER), BACKOFF_CAP))
    yield pd.DataFrame({"id": [key[0]], "attempts": [attempts], "status": ["done" if done else "retry"], "wait": [wait]})


def retries(outcomes: DataFrame) -> DataFrame:
    """id, attempts, status, wait of a stream of outcomes (id long, ok boolean); attempts after a success don't count."""
    return outcomes.groupBy("id").applyInPandasWithState(_retry, "id long, attempts int, status string, wait double", "attempts int, done boolean", "update", "NoTimeout")


def windowed_counts(stream: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """start, event, n of a stream's time windows; rows later than the watermark are left out."""
    counted = stream.withWatermark("created_at", late).groupBy(F.window("created_at", size), "event").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event", "n")

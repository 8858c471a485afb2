"""Enrichment as a closed loop: one running stream in which failed messages come back by themselves.

The stream reads what has landed and the outcomes of its own work. For each message it keeps
how often it was tried, and a timer while it waits. A landed message, or one whose timer has run
out, is due; every micro-batch distills its due messages at once, as a DataFrame, and writes their
outcomes, which the stream reads in one of its next batches: a failed one waits again, twice as long.

Each batch writes folders of its own number. One that is run again after a crash writes the same
ones anew, so nothing is lost, and no outcome counts twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from reverie.streaming.ingest import BACKOFF_CAP, BACKOFF_POWER

EVENT = "id string, kind string, attempts int, content string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Schedule(StatefulProcessor):
    """Of each message: when it is due, and when it is done. Events landed, failed and done come in; due and done go out."""

    def __init__(self, second: float = 1.0):
        self.second = second  # of the waits, in seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "content string, attempts int, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for r in (r for frame in rows for r in frame.itertuples(index=False)):
            content, attempts, done = self.job.get() if self.job.exists() else (None, None, False)
            if r.kind == "landed" and attempts is None:  # once, however often it lands
                self.job.update((r.content, 0, False))
                out.append((key[0], "due", 1, r.content))
            elif r.kind in ("failed", "done") and attempts is not None and not done and r.attempts == attempts + 1:
                if r.kind == "done":
                    self.job.update((None, r.attempts, True))
                    out.append((key[0], "done", r.attempts, r.content))
                else:
                    self.job.update((content, r.attempts, False))
                    wait = min(2 ** min(r.attempts, BACKOFF_POWER), BACKOFF_CAP) * self.second
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * wait))
        if out:
            yield pd.DataFrame(out, columns=["id", "kind", "attempts", "content"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        content, attempts, done = self.job.get()
        if not done:
            yield pd.DataFrame([(key[0], "due", attempts + 1, content)], columns=["id", "kind", "attempts", "content"])

    def close(self) -> None:
        pass


def loop(spark: SparkSession, landing: str, path: str, distill: Callable[[DataFrame], DataFrame], second: float = 1.0, fail: Callable[[int], None] | None = None, files: int = 8) -> StreamingQuery:
    """Starts the loop over messages (id, content) that land; its tables are under path.

    distill gets the due messages (id, attempts, content) and gives id and content of those it
    could do; the others failed. second is the length of a second of the waits. fail, in tests,
    is called when a batch has written its outcomes and is not yet done.
    """
    spark.createDataFrame([], EVENT).write.mode("append").parquet(f"{path}/outcomes/none")

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/emitted/{number}")  # the state's work is done once
        due = spark.read.schema(EVENT).parquet(f"{path}/emitted/{number}").where("kind = 'due'")
        if due.isEmpty():
            return
        done = distill(due.select("id", "attempts", "content")).groupBy("id").agg(F.first("content").alias("found"))
        outcomes = due.join(done, "id", "left").select("id", F.when(F.col("found").isNotNull(), "done").otherwise("failed").alias("kind"), "attempts", F.col("found").alias("content"))
        outcomes.write.mode("overwrite").parquet(f"{path}/outcomes/{number}")
        if fail is not None:
            fail(number)

    landed = spark.readStream.schema("id string, content string").option("maxFilesPerTrigger", files).parquet(landing)
    outcomes = spark.readStream.schema(EVENT).parquet(f"{path}/outcomes/*")
    events = landed.select("id", F.lit("landed").alias("kind"), F.lit(0).alias("attempts"), "content").unionByName(outcomes)
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, PROVIDER)  # timers need it; a query keeps what it was started with
    try:
        emitted = events.groupBy("id").transformWithStateInPandas(Schedule(second), EVENT, "Update", "ProcessingTime")
        return emitted.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", f"{path}/state").trigger(processingTime="200 milliseconds").start()
    finally:
        spark.conf.set(key, before)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """id, attempts, content of the messages that are done."""
    return spark.read.schema(EVENT).parquet(f"{path}/emitted/*").where("kind = 'done'").select("id", "attempts", "content")


def wait_for(query: StreamingQuery, path: str, n: int, seconds: float = 300) -> None:
    """Waits until n messages are done, and stops the loop; a query that failed raises what it failed of.

    seconds is how long the loop may go on without a batch that had events: many messages take long, but not in silence.
    """
    spark, end, batch = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active(), time.time() + seconds, None
    try:
        while time.time() < end:
            if query.exception() is not None:
                raise query.exception()
            last = query.lastProgress
            if last is not None and last["batchId"] != batch:
                batch = last["batchId"]
                if finished(spark, path).count() >= n:
                    return
                if last["numInputRows"]:
                    end = time.time() + seconds
            time.sleep(0.5)
        raise TimeoutError(f"{n} messages were not done, and no event came for {seconds} seconds")
    finally:
        query.stop()

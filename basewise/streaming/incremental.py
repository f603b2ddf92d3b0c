"""Counts that grow with a stream of reads, and mates that wait for each other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def running_counts(cells: DataFrame) -> DataFrame:
    """Counts and coverage of a stream of cells (sample, id, pos, hit) so far; for update or complete mode."""
    return cells.groupBy("sample", "id", "pos").agg(F.sum("hit").alias("count"), F.count(F.lit(1)).alias("coverage"))


def late_counts(cells: DataFrame, time: str, delay: str, window: str) -> DataFrame:
    """The same by time window, with windows closed (for append mode) once the watermark has passed."""
    return cells.withWatermark(time, delay).groupBy(F.window(time, window), "id", "pos").agg(F.sum("hit").alias("count"), F.count(F.lit(1)).alias("coverage"))


def last_counts(cells: DataFrame, checkpoint: str) -> DataFrame:
    """The running counts in complete mode once all that is there has passed, read by tasks from the stream's state in checkpoint.

    In complete mode the state is the whole result, so no sink need hold it. It is in RocksDB, whose memory is bounded;
    neither driver nor executors hold the result."""
    spark = cells.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = running_counts(cells).writeStream.outputMode("complete").format("noop").option("checkpointLocation", checkpoint).start()
    finally:
        spark.conf.set(STATE_STORE, before)
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", F.col("value.sum").alias("count"), F.col("value.count").alias("coverage"))


FRAGMENT = "pair_id long, id long, start long, end long, mates int"


def paired(mates: DataFrame, time: str = "ts", wait: str = "1 minute", wait_ms: int = 60_000) -> DataFrame:
    """Fragments of a stream of mates (pair_id, id, start, end and an event time): a pair as soon as both are there, a lone mate once the watermark has passed its time by wait_ms.

    The state of a pair is one mate, and goes with the fragment."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["pair_id", "id", "start", "end", "mates"]
        if state.hasTimedOut:
            low, high = state.get
            state.remove()
            yield pd.DataFrame([(*key, low, high, 1)], columns=names)
            return
        rows, last = [], 0
        for f in frames:
            rows += zip(f["start"].tolist(), f["end"].tolist(), strict=True)
            last = max(last, *(int(x.timestamp() * 1000) for x in f[time]))
        if state.exists:
            rows.insert(0, state.get)
            state.remove()
        while len(rows) >= 2:
            a, b = rows.pop(0), rows.pop(0)
            yield pd.DataFrame([(*key, min(a[0], b[0]), max(a[1], b[1]), 2)], columns=names)
        if rows:
            state.update(rows[0])
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait_ms)

    return mates.withWatermark(time, wait).groupBy("pair_id", "id").applyInPandasWithState(step, FRAGMENT, "start long, end long", "append", GroupStateTimeout.EventTimeTimeout)


def add_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Writes the counts of each batch as a part of its own (by batch number, so that a batch that is run again replaces itself); readers add parts up."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("sample", "id", "pos").agg(F.sum("hit").alias("count"), F.count(F.lit(1)).alias("coverage")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Structured Streaming over job events: windows with watermarks, first snapshots, and per-key state with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, at: str, width: str, late: str, by: list[str]) -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, late: str, by: list[str]) -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.window(at, width, step), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, at: str, gap: str, late: str, by: list[str]) -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def first_snapshots(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """One row for each key within the watermark: later ones don't replace it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def job_states(events: DataFrame, key: str, at: str, ttl_ms: int, late: str = "1 hour") -> DataFrame:
    """Per key: number of events, highest value, last type; state goes ``ttl_ms`` of event time after the last event."""
    kind = dict(events.dtypes)[key]

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, high, last = state.get
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "n": [n], "high": [high], "last_type": [last], "status": ["expired"]})
            return
        n, high, last = state.get if state.exists else (0, float("-inf"), None)
        latest = 0
        for batch in batches:
            batch = batch.sort_values([at, "event_id"])
            n, high, last = n + len(batch), max(high, batch["value"].max()), batch["event_type"].iloc[-1]
            latest = max(latest, int(batch[at].iloc[-1].timestamp() * 1000))
        state.update((n, float(high), last))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({key: [keys[0]], "n": [n], "high": [high], "last_type": [last], "status": ["active"]})

    out = f"{key} {kind}, n long, high double, last_type string, status string"
    keyed = events.withWatermark(at, late).groupBy(key)
    return keyed.applyInPandasWithState(step, out, "n long, high double, last string", "update", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, root: str) -> DataFrame:
    """Run all that is there, append its results to files under ``root`` beside the checkpoint, and read them. Nothing passes through the driver."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def joined(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: str, late: str) -> DataFrame:
    """Stream-stream join: each left event with the right events of its key at most ``within`` later. Both sides' watermarks bound the state."""
    a = left.withWatermark(left_at, late).select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.withWatermark(right_at, late).select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & F.col(f"r_{right_at}").between(F.col(f"l_{left_at}"), F.col(f"l_{left_at}") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on)


def commit_batches(stream: DataFrame, path: str, checkpoint: str):
    """A sink that a repeated batch can't double: each batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

"""Sessions, windowed counts and idempotent logging over a stream of events (user_id, event_type, ts, value, event_id)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)


def once(events: DataFrame, key: str = "event_id", lateness: str = "10 minutes") -> DataFrame:
    """Events without those that come again within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "60 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(user_id, started_at, ended_at, n_events): append mode gives a session once its gap is past."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    s = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n_events"))
    return s.select("user_id", "started_at", "ended_at", "n_events")


def counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) by tumbling or sliding windows."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def limited(events: DataFrame, rate: float = 1.0, burst: int = 3) -> DataFrame:
    """(user_id, event_id, ts, allowed): a token bucket for each user, kept as streaming state.

    A bucket holds ``burst`` tokens and gains ``rate`` a second; an event that finds none is refused.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (float(burst), None)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for e, t in zip(rows["event_id"], rows["at"], strict=True):
            tokens = min(float(burst), tokens + (max(0.0, t - at) * rate if at is not None else 0.0))
            at = t if at is None else max(at, t)
            ok = tokens >= 1
            tokens -= ok
            out.append((key[0], e, t, bool(ok)))
        state.update((float(tokens), float(at)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "at", "allowed"])

    e = events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, at double, allowed boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over what there is, into a table in memory (for tests and small results)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)

"""State that forgets: sessions with a time to live, a cache of answers with a time to live and a capacity, and feedback
joined to the log as it arrives.

The stores are ``transformWithState`` processors (value and map state, event-time timers); they need the RocksDB state store, which ``use_rocksdb`` sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.keyed import Keyed

SESSION_TTL, ANSWER_TTL, ANSWERS = 3600, 1800, 500


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Sessions(StatefulProcessor):
    """Output: a row for each session whose time to live has passed."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.of = handle.getValueState("session", "started long, used long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = sorted(t for b in rows for t in b["at"])
        ended = []
        started, used, n = self.of.get() if self.of.exists() else (at[0], at[0], 0)
        for t in at:
            if t - used > self.ttl_ms:  # it had gone before this came
                ended.append((key[0], started, used, n))
                started, n = t, 0
            used, n = max(used, t), n + 1
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(used + self.ttl_ms + 1)
        self.of.update((started, used, n))
        yield _ended(ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(key[0], *self.of.get())] if self.of.exists() else []
        self.of.clear()
        yield _ended(rows)

    def close(self) -> None:
        pass


def _ended(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session_id", "started", "used", "n"]).astype({"started": "int64", "used": "int64", "n": "int64"})


def ended_sessions(events: DataFrame, ttl_seconds: int = SESSION_TTL, lateness: str = "10 minutes") -> DataFrame:
    """(session_id, started_at, last_used, n) of a stream (session_id, ts): sessions unused for longer than the time to live, once the watermark has passed it."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = events.select(F.col("session_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), ms.alias("at")).withWatermark("ts", lateness)
    out = e.groupBy("session_id").transformWithStateInPandas(_Sessions(ttl_seconds * 1000), "session_id string, started long, used long, n long", "append", "EventTime")
    return out.select("session_id", F.timestamp_millis("started").alias("started_at"), F.timestamp_millis("used").alias("last_used"), "n")


class _Answers(StatefulProcessor):
    """A map of question to (answer, when it was put, when it was last used), of at most ``most`` entries."""

    def __init__(self, ttl_ms: int, most: int):
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.of = handle.getMapState("answers", "question string", "answer string, put long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: list(v) for k, v in self.of.iterator()}  # bounded by the capacity
        before, out = dict(known), []
        for r in sorted((x for b in rows for x in b.itertuples(index=False)), key=lambda x: (x.at, x.event_id)):
            known = {q: v for q, v in known.items() if r.at - v[1] < self.ttl_ms}
            if r.answer is None or r.answer != r.answer:
                hit = known.get(r.question)
                if hit:
                    known[r.question] = [hit[0], hit[1], r.at]
                out.append((key[0], r.event_id, r.question, hit is not None, hit[0] if hit else None))
            else:
                known[r.question] = [r.answer, r.at, r.at]
                if len(known) > self.most:
                    del known[min(known, key=lambda q: (known[q][2], q))]
        for q in before.keys() - known.keys():
            self.of.removeKey((q,))
        for q, v in known.items():
            if before.get(q) != v:
                self.of.updateValue((q,), tuple(v))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "question", "hit", "answer"]).astype({"hit": bool})

    def close(self) -> None:
        pass


def cached_answers(events: DataFrame, ttl_seconds: int = ANSWER_TTL, most: int = ANSWERS) -> DataFrame:
    """(user_id, event_id, question, hit, answer): lookups of a stream (user_id, event_id, ts, question, answer or null) in each user's cache.

    An event with an answer puts it; one without looks it up. An answer is valid for the time to live from its putting;
    beyond the capacity the least recently used one goes. Events of a batch count in order of time.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = events.select(F.col("user_id").cast("string").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), ms.alias("at"), "question", "answer")
    return e.groupBy("user_id").transformWithStateInPandas(_Answers(ttl_seconds * 1000, most), "user_id string, event_id long, question string, hit boolean, answer string", "append", "None")


def joined_feedback(log: DataFrame, feedback: DataFrame, within: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(public_id, ts, rating, comment, rated_at): a log (public_id, ts) with the feedback (ref, ts, rating, comment) that comes within a time of it.

    A stream-stream left join: state is kept for as long as watermarks and the bound ask for; a row without feedback comes
    out with nulls once none can come any more.
    """
    a = log.select("public_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    b = feedback.select("ref", F.col("ts").cast("timestamp").alias("rated_at"), "rating", "comment").withWatermark("rated_at", lateness)
    met = (F.col("public_id") == F.col("ref")) & (F.col("rated_at") >= F.col("ts")) & (F.col("rated_at") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, met, "left").select("public_id", "ts", "rating", "comment", "rated_at")


def newest_feedback(spark: SparkSession, path: str) -> Keyed:
    """The newest feedback of each log row, as ``joined_feedback`` brings it (nulls are older than all)."""
    newest = lambda a, b: F.greatest(a, b)
    return Keyed(spark, path, ["public_id"], {"ts": lambda a, b: F.coalesce(a, b), "newest": newest})


def keep_newest(stream: DataFrame, path: str, checkpoint: str):
    """Write ``joined_feedback`` to a table, a row for each log row; a batch that runs again changes nothing. Returns the query."""

    def put(rows: DataFrame, batch: int) -> None:
        one = F.when(F.col("rated_at").isNotNull(), F.struct("rated_at", "rating", "comment"))
        newest_feedback(rows.sparkSession, path).merge(rows.groupBy("public_id").agg(F.min("ts").alias("ts"), F.max(one).alias("newest")), batch)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

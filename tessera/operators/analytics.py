"""Usage analytics over question logs, sessions, users and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------
STOP_WORDS = (
    "и а в во на по из к с со от до за над под при о об для как что это или если то же ли так также "
    "у бы чтобы где когда после перед можно нужно еще уже все всё весь вся они оно она он мы вы ты я "
    "который которая которые такой только более менее через"
).split()
PHRASE_WEIGHTS = {3: 1.5, 2: 1.0, 1: 0.5}
# --------------------------------------------------------------------------------------------------


def phrases(rows: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """(keep.., phrase, weight): word triples, pairs, and single words of more than five letters.

    Words are lower-cased; stop words and words under three letters are left out first."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit("[а-яёa-z0-9]+"), 0)
    stop = F.array(*map(F.lit, STOP_WORDS))
    t = rows.select(*keep, F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)).alias("t"))

    def grams(n: int) -> Column:
        at = F.when(F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - n + 1)).otherwise(F.array().cast("array<int>"))
        made = F.transform(at, lambda i: F.array_join(F.slice("t", i, n), " ")) if n > 1 else F.filter("t", lambda w: F.length(w) > 5)
        return F.transform(made, lambda p: F.struct(p.alias("phrase"), F.lit(PHRASE_WEIGHTS[n]).alias("weight")))

    return t.select(*keep, F.explode(F.concat(*map(grams, PHRASE_WEIGHTS))).alias("p")).select(*keep, "p.phrase", "p.weight")


def topics(log: DataFrame, text_col: str = "question") -> DataFrame:
    """(topic, hits, total_weight, avg_confidence, avg_processing_time, last_used) over ``log`` (.., confidence, processing_time, ts)."""
    p = phrases(log, text_col, "confidence", "processing_time", "ts")
    return p.groupBy(F.col("phrase").alias("topic")).agg(F.count("*").alias("hits"), F.sum("weight").alias("total_weight"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.round(F.avg("processing_time"), 6).alias("avg_processing_time"), F.max("ts").alias("last_used"))


def top_topics(topics: DataFrame, n: int = 15) -> DataFrame:
    return topics.orderBy(F.desc("total_weight"), F.desc("last_used"), "topic").limit(n)


def running_mean(values: Column) -> Column:
    """The mean as an upsert keeps it: each value updates (mean * n + x) / (n + 1)."""
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("n"))
    return F.aggregate(values, zero, lambda a, x: F.struct(((a.m * a.n + x) / (a.n + 1)).alias("m"), (a.n + 1).alias("n")), lambda a: F.when(a.n > 0, a.m))


def sessions(log: DataFrame, compat: bool = False) -> DataFrame:
    """(session_id, started_at, ended_at, message_count, avg_confidence, avg_grounding) over ``log``
    (session_id, ts, confidence, grounding, seq).

    ``compat``: the first message opens a session without being counted, as the upsert does it.
    """
    if not compat:
        return log.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("message_count"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.round(F.avg("grounding"), 6).alias("avg_grounding"))
    n = F.row_number().over(W.partitionBy("session_id").orderBy("ts", "seq"))
    late = F.col("n") > 1
    x = log.withColumn("n", n)
    return x.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count_if(late).alias("message_count"), F.round(F.avg(F.when(late, F.col("confidence"))), 6).alias("avg_confidence"), F.round(F.avg(F.when(late, F.col("grounding"))), 6).alias("avg_grounding"))


def sessionized(log: DataFrame, gap: str = "60 minutes", user: str = "user_id") -> DataFrame:
    """(user, started_at, ended_at, n_events): activity without a pause as long as ``gap``."""
    s = log.groupBy(user, F.session_window("ts", gap)).agg(F.max("ts").alias("ended_at"), F.min("ts").alias("started_at"), F.count("*").alias("n_events"))
    return s.select(user, "started_at", "ended_at", "n_events")


def user_hash(domain: Column, computer: Column) -> Column:
    """One hash for a user, wherever it is made."""
    return F.md5(F.concat_ws("_", F.coalesce(domain, F.lit("unknown")), F.coalesce(computer, F.lit("unknown"))).cast("binary"))


def users(log: DataFrame, compat: bool = False) -> DataFrame:
    """(user_hash, first_seen, last_seen, query_count) over ``log`` (domain, computer_name, ts). ``compat`` doesn't count the first query."""
    h = user_hash(F.col("domain"), F.col("computer_name"))
    return log.groupBy(h.alias("user_hash")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), (F.count("*") - int(compat)).alias("query_count"))


def history(log: DataFrame, by: str, n: int = 10, tie: str = "id") -> DataFrame:
    """The newest ``n`` visible rows of each user or session, numbered."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("ts"), F.desc(tie)))
    return visible(log).withColumn("pos", rank).where(F.col("pos") <= n)


def user_history(log: DataFrame, users: DataFrame, wanted: DataFrame, n: int = 50, include_hidden: bool = False) -> DataFrame:
    """(user_hash, pos, columns of ``log``): the newest ``n`` rows of every wanted user (domain, computer_name), whose hash names a row
    of ``users`` (id, user_hash), whose id is the log's user_id. Users without rows, and rows without a user, give none."""
    asked = wanted.select(user_hash(F.col("domain"), F.col("computer_name")).alias("user_hash")).distinct()
    known = users.join(asked, "user_hash", "left_semi").select(F.col("id").alias("_user"), "user_hash").distinct()
    rows = (log if include_hidden else visible(log)).join(known, F.col("user_id") == F.col("_user")).drop("_user")
    rank = F.row_number().over(W.partitionBy("user_hash").orderBy(F.desc("ts"), F.desc("id")))
    return rows.withColumn("pos", rank).where(F.col("pos") <= n).select("user_hash", "pos", *log.columns)


def page_after(rows: DataFrame, after, size: int, key: str = "id") -> DataFrame:
    """The next ``size`` rows beyond the key ``after`` (None: from the start), in order: paging that reads no row twice."""
    rest = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(size)


def visible(log: DataFrame) -> DataFrame:
    return log.where("NOT coalesce(is_hide, false)") if "is_hide" in log.columns else log


def hidden(log: DataFrame, session_ids: DataFrame) -> DataFrame:
    """``log`` with the rows of the given sessions hidden."""
    s = session_ids.select(F.col("session_id").alias("_s"), F.lit(True).alias("_hide")).distinct()
    return log.join(s, log.session_id == F.col("_s"), "left").withColumn("is_hide", F.coalesce("_hide", "is_hide", F.lit(False))).drop("_s", "_hide")


def with_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """``log`` (id, public_id, ..) with feedback_rating and feedback_comment of the newest feedback (ref, rating, comment, ts).

    A reference is a public id, or else a numeric id."""
    newest = feedback.withColumn("n", F.row_number().over(W.partitionBy("ref").orderBy(F.desc("ts"), F.desc("rating")))).where("n = 1")
    f = newest.select("ref", F.col("rating").alias("feedback_rating"), F.col("comment").alias("feedback_comment"))
    by_public = log.join(f, log.public_id == f.ref, "left_semi").join(f, F.col("public_id") == f.ref).drop("ref")
    rest = log.join(f, log.public_id == f.ref, "left_anti").join(f, F.col("id").cast("string") == f.ref, "left").drop("ref")
    return by_public.unionByName(rest)


def stats(log: DataFrame, last: int = 5000) -> DataFrame:
    """One row: n, avg_time, median_time, n_rated, avg_rating over the newest ``last`` rows (ts, processing_time, rating, id)."""
    x = log.orderBy(F.desc("ts"), F.desc("id")).limit(last)
    return x.agg(F.count("*").alias("n"), F.round(F.avg("processing_time"), 6).alias("avg_time"), F.round(F.median("processing_time"), 6).alias("median_time"), F.count("rating").alias("n_rated"), F.round(F.avg("rating"), 6).alias("avg_rating"))


def snapshot(log: DataFrame, topics: DataFrame, held: DataFrame | None = None, n_topics: int = 15, n_recent: int = 10, last: int = 5000) -> DataFrame:
    """One row: ``stats`` (averages 0 where there is nothing to average), popular_topics (topic, score) and recent_queries, newest first.

    ``held`` (topic, weight) are weights that aren't stored yet; they are added to the stored ``n_topics`` best before these are ranked again.
    """
    numbers = stats(log, last).select("n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_time", "median_time", "avg_rating")], "n_rated")
    best = top_topics(topics, n_topics).select("topic", F.col("total_weight").cast("double").alias("score"))
    if held is not None:
        best = best.unionByName(held.select("topic", F.col("weight").cast("double").alias("score"))).groupBy("topic").agg(F.sum("score").alias("score"))
    best = best.orderBy(F.desc("score"), "topic").limit(n_topics)
    best = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("key"), "topic"))).alias("t"))
    best = best.select(F.transform("t", lambda x: F.struct(x.topic.alias("topic"), (-x.key).alias("score"))).alias("popular_topics"))
    newest = log.orderBy(F.desc("ts"), F.desc("id")).limit(n_recent).agg(F.sort_array(F.collect_list(F.struct("ts", "id", "question")), False).alias("r"))
    newest = newest.select(F.transform("r", lambda x: x.question).alias("recent_queries"))
    # three single rows become one without a join
    parts = numbers.unionByName(best, allowMissingColumns=True).unionByName(newest, allowMissingColumns=True)
    return parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns])


def suggestions(log: DataFrame, topics: DataFrame, term: str, n: int = 10, last: int = 100) -> DataFrame:
    """(suggestion, source, pos): of the newest ``last`` distinct questions those that contain ``term``, then topics."""
    q = log.groupBy("question").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "question").limit(last)
    q = q.where(F.contains(F.lower("question"), F.lit(term.lower()))).select(F.col("question").alias("suggestion"), F.lit("history").alias("source"), F.lit(0).alias("part"), (-F.unix_micros(F.col("ts").cast("timestamp"))).cast("double").alias("key"))
    t = topics.where(F.contains(F.lower("topic"), F.lit(term.lower()))).orderBy(F.desc("total_weight"), "topic").limit(n)
    t = t.select(F.col("topic").alias("suggestion"), F.lit("topic").alias("source"), F.lit(1).alias("part"), (-F.col("total_weight")).cast("double").alias("key"))
    return q.unionByName(t).orderBy("part", "key", "suggestion").limit(n).withColumn("pos", F.row_number().over(W.orderBy("part", "key", "suggestion"))).select("suggestion", "source", "pos")


def actions(log: DataFrame) -> DataFrame:
    """(action_type, n, n_sessions, first_at, last_at)."""
    return log.groupBy("action_type").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("n_sessions"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def evicted(state: DataFrame, now: Column, ttl_seconds: int = 3600, most: int = 500) -> DataFrame:
    """Sessions (session_id, last_used) that go: unused for the time to live, or beyond the ``most`` newest."""
    alive = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_used").cast("timestamp")) <= ttl_seconds
    newest = state.where(alive).orderBy(F.desc("last_used"), "session_id").limit(most).select("session_id")
    return state.join(newest, "session_id", "left_anti")

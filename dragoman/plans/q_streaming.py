"""Streaming jobs run to the end of the available data, next to SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from dragoman.operators import usage as U
from dragoman.plans import views as V
from dragoman.plans.q_chunking import with_structure
from dragoman.plans.q_dialogue import ROUTED
from dragoman.plans.q_service import ingest_sql
from dragoman.plans.registry import query
from dragoman.session import scratch_dir
from dragoman.streaming import jobs as J

SQUEEZE = 20_000  # divides event times so that clients send many requests within a minute
REQUESTS = (
    f"req AS (SELECT user_id AS client, event_id AS seq, (epoch_us(ts) - 1704067200000000) // {SQUEEZE} AS us FROM events)"
)


def requests(events):
    us = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / SQUEEZE)
    return events.select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), us.alias("us"))


def timed(spark, sf):
    """The event turns of the batch view as a stream."""
    e = J.read_table_stream(spark, sf, "events")
    return V.as_event_turns(e)


# events are answered once the watermark has passed them, so the newest are still waiting at the end
@query(
    "stream_rate_limit",
    f"WITH RECURSIVE {REQUESTS}, o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY us, seq) AS i FROM req), "
    "f AS (SELECT DISTINCT client, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BIGINT AS us, []::BIGINT[] AS times, FALSE AS accepted FROM o UNION ALL "
    "SELECT client, i, seq, us, CASE WHEN len(live) < 30 THEN list_append(live, us) ELSE live END, len(live) < 30 FROM "
    "(SELECT o.client, o.i, o.seq, o.us, list_filter(f.times, lambda t: o.us - t < 60000000) AS live FROM f JOIN o ON o.client = f.client AND o.i = f.i + 1)) "
    "SELECT client, seq, us, accepted FROM f WHERE i > 0 AND us < (SELECT 1000 * (max(us) // 1000 - 5000) FROM req)",
)
def stream_rate_limit(spark, sf):
    r = requests(J.read_table_stream(spark, sf, "events"))
    return J.run_to_files(J.stream_rate_limit(r, late="5 seconds"), scratch_dir(spark, "rate"))


@query(
    "rate_window_counts",
    f"WITH {REQUESTS}, w AS (SELECT client, us, count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_window FROM req) "
    "SELECT client, us, count(*) AS n, max(in_window) AS in_window FROM w GROUP BY ALL",
)
def rate_window_counts(spark, sf):
    r = requests(V.table(spark, sf, "events"))
    return U.rate_window_counts(r.withColumn("ts", F.timestamp_micros("us")))


@query(
    "stream_sessions",
    f"WITH {V.EVENT_TURNS}, g AS (SELECT *, coalesce(ts - INTERVAL 30 MINUTE >= lag(ts) OVER (PARTITION BY session_id ORDER BY ts, seq), TRUE)::INT AS fresh FROM event_turns), "
    "n AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM g) "
    "SELECT session_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS turns FROM n GROUP BY session_id, s "
    "HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM event_turns) - INTERVAL 10 MINUTE",
)
def stream_sessions(spark, sf):
    out = J.run_to_files(J.stream_sessions(timed(spark, sf)), scratch_dir(spark, "sessions"))
    return out.select("session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "turns")


@query(
    "stream_routing",
    f"WITH RECURSIVE {ROUTED} SELECT session_id, seq, reason, reason NOT LIKE 'rag:%' AS handled FROM routed "
    "WHERE epoch_us(ts) < (SELECT 1000 * (epoch_us(max(ts)) // 1000 - 600000) FROM event_turns)",
)
def stream_routing(spark, sf):
    return J.run_to_files(J.stream_routing(timed(spark, sf)), scratch_dir(spark, "routing"))


@query(
    "stream_ingest",
    f"WITH RECURSIVE {ingest_sql('FALSE')} SELECT doc_name, count(*) AS n, sum(length(t))::BIGINT AS n_chars, max(chunk_index)::INT AS last FROM kept_rows GROUP BY doc_name",
)
def stream_ingest(spark, sf):
    d = J.read_table_stream(spark, sf, "documents")
    docs = with_structure(d).select(F.concat(F.lit("doc"), "doc_id").alias("doc_name"), "text")
    store = J.stream_ingest(docs, scratch_dir(spark, "ingest"))
    return store.groupBy("doc_name").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.max("chunk_index").alias("last"))


# every copy lies in the first trigger, so one row per hash is left, whichever arrives first
@query(
    "stream_dedup",
    f"WITH {V.EVENT_TURNS} SELECT md5(session_id || ':' || intent || ':' || (k % 10)) AS content_hash, count(DISTINCT k % 10) AS n FROM event_turns GROUP BY ALL",
)
def stream_dedup(spark, sf):
    t = timed(spark, sf)
    h = F.md5(F.concat_ws(":", "session_id", "intent", F.col("k") % 10).cast("binary"))
    out = J.run_to_files(J.stream_dedup(t.withColumn("content_hash", h)), scratch_dir(spark, "dedup"))
    return out.groupBy("content_hash").agg(F.count("*").alias("n"))


@query(
    "stream_stats",
    f"WITH {V.EVENT_TURNS} SELECT epoch_us(date_trunc('hour', ts)) AS start_us, intent, count(*) AS n FROM event_turns GROUP BY ALL",
)
def stream_stats(spark, sf):
    out = J.stats_to_files(J.stream_stats(timed(spark, sf)), scratch_dir(spark, "stats"), ["start", "intent"])
    return out.select(F.unix_micros("start").alias("start_us"), "intent", "n")

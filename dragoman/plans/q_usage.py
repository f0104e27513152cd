"""Usage analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.operators import usage as U
from dragoman.plans import views as V
from dragoman.plans.registry import query

EVENT_CHAT = (
    "chat AS (SELECT event_id AS turn_id, user_id AS session_id, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, "
    "CASE WHEN event_id % 13 <> 0 THEN event_type END AS intent FROM events), "
    "feedback AS (SELECT event_id AS turn_id, CASE event_type WHEN 'purchase' THEN 'up' ELSE 'down' END AS rating FROM events WHERE event_type IN ('purchase', 'error'))"
)


def chat(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("turn_id"), F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("intent"),
    )


def feedback(spark, sf):
    e = V.table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "error"))
    return e.select(
        F.col("event_id").alias("turn_id"),
        F.when(F.col("event_type") == "purchase", "up").otherwise("down").alias("rating"),
    )


SESSIONS_SQL = (
    "sessions AS (SELECT conv_id AS session_id, conv_id % 7 AS user_id, CASE WHEN conv_id % 5 = 0 THEN 'Title ' || conv_id WHEN conv_id % 5 = 1 THEN '' END AS preview, "
    "(TIMESTAMP '2024-01-01 00:00:00' + to_hours(((conv_id * 37) % 1000)::INT))::VARCHAR AS created_at FROM (SELECT DISTINCT conv_id FROM conversations))"
)


def sessions(spark, sf):
    c = V.table(spark, sf, "conversations").select("conv_id").distinct()
    hours = ((F.col("conv_id") * 37) % 1000).cast("int")
    return c.select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") % 7).alias("user_id"),
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("Title "), "conv_id"))
        .when(F.col("conv_id") % 5 == 1, "").alias("preview"),
        F.date_format(
            F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(hours=hours), "yyyy-MM-dd HH:mm:ss"
        ).alias("created_at"),
    )


@query("total_queries", "SELECT count_if(role = 'user')::BIGINT AS total_queries FROM conversations")
def total_queries(spark, sf):
    return U.total_queries(V.turns(spark, sf))


@query("intent_breakdown", f"WITH {EVENT_CHAT} SELECT intent, count(*) AS n FROM chat WHERE role = 'assistant' AND intent IS NOT NULL GROUP BY intent")
def intent_breakdown(spark, sf):
    return U.intent_breakdown(chat(spark, sf))


@query(
    "intent_ranking",
    f"WITH {EVENT_CHAT}, b AS (SELECT intent, count(*) AS n FROM chat WHERE role = 'assistant' AND intent IS NOT NULL GROUP BY intent) "
    "SELECT intent, n, row_number() OVER (ORDER BY n DESC, intent)::INT AS rank, round(100 * n / max(n) OVER ())::INT AS bar FROM b",
)
def intent_ranking(spark, sf):
    return U.intent_ranking(U.intent_breakdown(chat(spark, sf)))


@query(
    "feedback_summary",
    f"WITH {EVENT_CHAT} SELECT count(*) AS total, count_if(rating = 'up')::BIGINT AS positive, count_if(rating = 'down')::BIGINT AS negative, "
    "round(count_if(rating = 'up') / count(*), 2) AS ratio FROM feedback",
)
def feedback_summary(spark, sf):
    return U.feedback_summary(feedback(spark, sf))


@query(
    "session_list",
    f"WITH {V.TURNS}, {SESSIONS_SQL}, h AS (SELECT session_id, arg_min(content, seq) AS c FROM turns WHERE role = 'user' GROUP BY session_id) "
    f"SELECT s.session_id, user_id, created_at, coalesce(nullif(preview, ''), c[1:36] || CASE WHEN length(c) > 36 THEN '…' ELSE '' END, '{dims.DEFAULT_PREVIEW}') AS preview "
    "FROM sessions s LEFT JOIN h USING (session_id)",
)
def session_list(spark, sf):
    return U.session_list(sessions(spark, sf), V.turns(spark, sf))


@query("session_history", f"WITH {V.TURNS} SELECT session_id, seq, role, content FROM turns")
def session_history(spark, sf):
    return U.session_history(V.turns(spark, sf))


@query(
    "rename_sessions",
    f"WITH {SESSIONS_SQL} SELECT session_id, user_id, created_at, CASE WHEN session_id % 3 = 0 THEN repeat('New name ' || session_id || ' ', 20)[1:120] ELSE preview END AS preview FROM sessions",
)
def rename_sessions(spark, sf):
    s = sessions(spark, sf)
    name = F.repeat(F.concat(F.lit("New name "), "session_id", F.lit(" ")), F.lit(20))
    updates = s.filter("session_id % 3 = 0").select("session_id", name.alias("preview"))
    return U.rename_sessions(s, updates)


@query(
    "delete_sessions",
    f"WITH {EVENT_CHAT}, gone AS (SELECT DISTINCT session_id FROM chat WHERE session_id % 4 = 1), "
    "s AS (SELECT DISTINCT session_id FROM chat) "
    "SELECT 'sessions' AS what, count(*) AS n FROM s WHERE session_id NOT IN (FROM gone) UNION ALL "
    "SELECT 'turns', count(*) FROM chat WHERE session_id NOT IN (FROM gone) UNION ALL "
    "SELECT 'feedback', count(*) FROM feedback WHERE turn_id NOT IN (SELECT turn_id FROM chat WHERE session_id IN (FROM gone))",
)
def delete_sessions(spark, sf):
    c = chat(spark, sf)
    s = c.select("session_id").distinct()
    kept = U.delete_sessions(s, c, feedback(spark, sf), s.filter("session_id % 4 = 1"))
    out = None
    for name, df in zip(("sessions", "turns", "feedback"), kept, strict=True):
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "turn_pairs",
    f"WITH {V.TURNS}, l AS (SELECT *, lead(role) OVER w AS nrole, lead(content) OVER w AS reply FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY seq)) "
    "SELECT session_id, seq, md5(content) AS question, md5(reply) AS reply FROM l WHERE role = 'user' AND nrole = 'assistant'",
)
def turn_pairs(spark, sf):
    p = U.turn_pairs(V.turns(spark, sf))
    return p.select("session_id", "seq", *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("question", "reply")])


@query(
    "feedback_by_intent",
    f"WITH {EVENT_CHAT} SELECT intent, rating, count(*) AS n FROM feedback JOIN chat USING (turn_id) GROUP BY ALL",
)
def feedback_by_intent(spark, sf):
    return U.feedback_by_intent(chat(spark, sf), feedback(spark, sf))

"""Conversation windows and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.operators import dialogue as D
from dragoman.plans import views as V
from dragoman.plans.q_filters import ANY_AR
from dragoman.plans.registry import query

MARKS = "(?i)error occurred|sorry, an error|حدث خطأ|عذراً، حدث"
EST = r"(len(regexp_extract_all({0}, '[\x{{0600}}-\x{{06FF}}]')) + (length({0}) - len(regexp_extract_all({0}, '[\x{{0600}}-\x{{06FF}}]'))) // 4)"


@query(
    "history_window",
    f"WITH {V.TURNS}, w AS (SELECT session_id, seq, list({{'seq': seq, 'role': role, 'content': trim(content)}}) OVER "
    "(PARTITION BY session_id ORDER BY seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS w FROM turns) "
    "SELECT session_id, seq, coalesce(array_to_string(list_transform(list_filter(w, lambda t: t.role <> 'system'), lambda t: t.role || '=' || md5(t.content)), ','), '') AS history, "
    "list_last(list_filter(w, lambda t: t.role = 'system')).content AS system FROM w",
)
def history_window(spark, sf):
    h = D.history_window(V.turns(spark, sf))
    parts = F.transform("history", lambda t: F.concat(t["role"], F.lit("="), F.md5(t["content"].cast("binary"))))
    return h.select("session_id", "seq", F.array_join(parts, ",").alias("history"), "system")


@query(
    "truncate_message",
    "WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN text || text || text ELSE text END AS t FROM conversations) "
    "SELECT conv_id, turn, md5(CASE WHEN length(t) > 2000 THEN t[1:1000] || '... [truncated]' ELSE t END) AS digest FROM m",
)
def truncate_message(spark, sf):
    c = V.table(spark, sf, "conversations")
    t = F.when(F.col("turn") % 2 == 1, F.concat("text", "text", "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.md5(D.truncate_message(t).cast("binary")).alias("digest"))


RECENT = f"{V.TURNS}, recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM turns) WHERE back <= 6)"


@query(
    "token_budget",
    f"WITH {RECENT}, t AS (SELECT session_id, seq, role, {EST.format('trim(content)')} AS tokens, max(CASE WHEN role = 'system' THEN seq END) OVER (PARTITION BY session_id) AS sys FROM recent), "
    "u AS (SELECT *, coalesce(sum(CASE WHEN role = 'system' THEN tokens END) OVER (PARTITION BY session_id), 0) AS reserved, "
    "sum(CASE WHEN role = 'system' THEN 0 ELSE tokens END) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS used "
    "FROM t WHERE role <> 'system' OR seq = sys) "
    "SELECT session_id, seq, role, tokens::INT AS tokens FROM u WHERE role = 'system' OR used <= 1000 - reserved",
)
def token_budget(spark, sf):
    return D.token_budget(V.turns(spark, sf), max_tokens=1000).select("session_id", "seq", "role", "tokens")


@query(
    "last_user_message",
    f"WITH {V.TURNS} SELECT session_id, arg_max(content, seq) AS content FROM turns WHERE role = 'user' GROUP BY session_id",
)
def last_user_message(spark, sf):
    return D.last_user_message(V.turns(spark, sf))


@query(
    "recent_context",
    f"WITH {V.TURNS}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM turns WHERE role <> 'system') WHERE back <= 2) "
    "SELECT session_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || trim(content), chr(10) ORDER BY seq) AS context FROM r GROUP BY session_id",
)
def recent_context(spark, sf):
    return D.recent_context(V.turns(spark, sf))


@query(
    "clean_history",
    f"WITH RECURSIVE {V.TURNS}, t2 AS (SELECT session_id, seq, role, CASE WHEN (session_id + seq) % 4 = 0 THEN 'Error occurred' ELSE content END AS content FROM turns), "
    "recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM t2) WHERE back <= 6), "
    f"s AS (SELECT session_id, role, seq, regexp_matches(content, '{MARKS}') AS err, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i, "
    f"coalesce(lead(regexp_matches(content, '{MARKS}')) OVER (PARTITION BY session_id ORDER BY seq), FALSE) AS nerr FROM recent), "
    "f AS (SELECT DISTINCT session_id, 0::BIGINT AS i, []::BIGINT[] AS kept, []::VARCHAR[] AS roles, FALSE AS skip FROM s UNION ALL "
    "SELECT f.session_id, s.i, CASE WHEN skip THEN kept WHEN err AND list_last(roles) = 'user' THEN kept[1:len(kept) - 1] WHEN err OR nerr THEN kept ELSE list_append(kept, s.seq) END, "
    "CASE WHEN skip THEN roles WHEN err AND list_last(roles) = 'user' THEN roles[1:len(roles) - 1] WHEN err OR nerr THEN roles ELSE list_append(roles, s.role) END, "
    "NOT skip AND NOT err AND nerr FROM f JOIN s ON s.session_id = f.session_id AND s.i = f.i + 1) "
    "SELECT session_id, coalesce(array_to_string(arg_max(kept, i), ','), '') AS kept FROM f GROUP BY session_id",
)
def clean_history(spark, sf):
    bad = (F.col("session_id") + F.col("seq")) % 4 == 0
    t = V.turns(spark, sf).withColumn("content", F.when(bad, "Error occurred").otherwise(F.col("content")))
    turn = F.struct("seq", "role", "content")
    h = D.recent_turns(t).groupBy("session_id").agg(F.sort_array(F.collect_list(turn)).alias("h"))
    kept = F.transform(D.clean_history(F.col("h")), lambda x: x["seq"].cast("string"))
    return h.select("session_id", F.array_join(kept, ",").alias("kept"))


POOL_SIZES = "CASE pool " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.REPLY_POOL_SIZES.items()) + " END"
# the sequential state machine, one recursion step per turn of a session
ROUTED = f"""{V.EVENT_TURNS},
 o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS i FROM event_turns),
 f AS (
  SELECT DISTINCT session_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::TIMESTAMP AS ts, ''::VARCHAR AS intent, 0::DOUBLE AS confidence,
    0::INT AS low, 0::INT AS fb, FALSE AS greeted, 0::BIGINT AS turn_count, 0::BIGINT AS helped, NULL::TIMESTAMP AS active,
    ''::VARCHAR AS last_intent, 0::DOUBLE AS last_confidence, ''::VARCHAR AS reason, NULL::VARCHAR AS pool, []::VARCHAR[] AS last_helped, ''::VARCHAR AS text FROM o
  UNION ALL
  SELECT session_id, i, seq, ts, intent, confidence,
    CASE WHEN esc THEN 0 ELSE low1 END, CASE WHEN esc OR reason = 'fallback_escalation' THEN 0 ELSE fb1 END,
    CASE WHEN esc THEN greeted0 ELSE greeted0 OR intent = 'greeting' END, CASE WHEN esc THEN turns0 ELSE turns0 + 1 END,
    CASE WHEN esc OR reason LIKE 'rag:%' THEN helped0 ELSE helped0 + 1 END, CASE WHEN esc THEN active0 ELSE ts END,
    CASE WHEN esc THEN last_intent ELSE intent END, CASE WHEN esc THEN last_confidence ELSE confidence END, reason,
    CASE WHEN reason IN ('escalation', 'fallback_escalation') THEN 'escalation'
      WHEN reason = 'canned:greeting' THEN CASE WHEN greeted0 AND turns0 > 2 THEN 'return_greeting' ELSE 'greeting' END
      WHEN reason = 'canned:goodbye' THEN CASE WHEN helped0 > 0 THEN 'after_help_goodbye' ELSE 'goodbye' END
      WHEN reason = 'canned:thanks' THEN 'thanks' WHEN reason = 'canned:capabilities' THEN 'capabilities_lines'
      WHEN reason LIKE 'low_confidence:%' THEN CASE WHEN low1 >= 2 THEN 'fallback' ELSE 'low_confidence' END
      WHEN reason = 'fallback' THEN 'fallback' END,
    CASE WHEN esc OR reason LIKE 'rag:%' THEN last0 ELSE list_append(last0, intent)[-3:] END, text
  FROM (SELECT *, CASE WHEN esc THEN 'escalation'
      WHEN intent IN {V.sql_in(dims.CANNED_INTENTS)} AND confidence >= 0.35 THEN 'canned:' || intent
      WHEN intent IN {V.sql_in(dims.CAPABILITY_INTENTS)} THEN 'capabilities'
      WHEN confidence < 0.55 THEN 'low_confidence:' || low1
      WHEN intent = 'fallback' THEN CASE WHEN fb1 >= 2 THEN 'fallback_escalation' ELSE 'fallback' END
      WHEN intent = 'unknown' THEN 'unknown_intent' ELSE 'rag:' || intent END AS reason
    FROM (SELECT *, low0 >= 3 AS esc, CASE WHEN intent IN ('fallback', 'unknown') OR confidence < 0.4 THEN low0 + 1 ELSE 0 END AS low1,
        CASE WHEN intent = 'fallback' THEN fb0 + 1 ELSE 0 END AS fb1
      FROM (SELECT o.session_id, o.i, o.seq, o.ts, o.intent, o.confidence, o.text, f.last_intent, CASE WHEN exp THEN [] ELSE last_helped END AS last0, f.last_confidence,
          CASE WHEN exp THEN 0 ELSE low END AS low0, CASE WHEN exp THEN 0 ELSE fb END AS fb0, CASE WHEN exp THEN FALSE ELSE greeted END AS greeted0,
          CASE WHEN exp THEN 0 ELSE turn_count END AS turns0, CASE WHEN exp THEN 0 ELSE helped END AS helped0, active AS active0
        FROM (SELECT f.*, o2.ts - INTERVAL 30 MINUTE > f.active AS exp FROM f JOIN o o2 ON o2.session_id = f.session_id AND o2.i = f.i + 1) f
        JOIN o ON o.session_id = f.session_id AND o.i = f.i + 1)))
 ),
 routed AS (SELECT *, ('0x' || md5(session_id || ':' || seq)[1:4])::INT % {POOL_SIZES} AS reply_index FROM f WHERE i > 0)"""


def routed(spark, sf):
    return D.route_turns(V.event_turns(spark, sf))


@query(
    "route_turns",
    f"WITH RECURSIVE {ROUTED} SELECT session_id, seq, reason, reason NOT LIKE 'rag:%' AS handled, pool, reply_index::INT AS reply_index, "
    f"CASE WHEN regexp_matches(text, '{ANY_AR}') THEN 'ar' ELSE 'en' END AS reply_language, last_helped FROM routed",
)
def route_turns(spark, sf):
    return routed(spark, sf).select("session_id", "seq", "reason", "handled", "pool", "reply_index", "reply_language", "last_helped")


@query(
    "session_state",
    f"WITH RECURSIVE {ROUTED}, last AS (SELECT session_id, max(i) AS i FROM routed GROUP BY session_id) "
    "SELECT session_id, last_intent, last_confidence, low AS low_confidence_turns, fb AS fallbacks, greeted, helped, turn_count, last_helped, "
    "epoch_us(active) AS last_activity FROM routed JOIN last USING (session_id, i)",
)
def session_state(spark, sf):
    s = D.session_state(routed(spark, sf))
    return s.withColumn("last_activity", F.unix_micros("last_activity")).withColumn(
        "low_confidence_turns", F.col("low_confidence_turns").cast("int")
    )


SESSIONS = f"""{V.EVENT_TURNS}, g AS (SELECT *, coalesce(ts - INTERVAL 30 MINUTE > lag(ts) OVER (PARTITION BY session_id ORDER BY ts, seq), TRUE)::INT AS fresh FROM event_turns),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM g)"""


@query(
    "sessionize",
    f"WITH {SESSIONS} SELECT session_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS turns FROM n GROUP BY session_id, s",
)
def sessionize(spark, sf):
    s = D.sessionize(V.event_turns(spark, sf))
    return s.select("session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "turns")


@query(
    "route_report",
    f"WITH RECURSIVE {ROUTED} SELECT reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM routed GROUP BY reason",
)
def route_report(spark, sf):
    return D.route_report(routed(spark, sf))

"""Usage analytics over sessions, turns and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.operators.scale import running, with_halo


def total_queries(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count_if(F.col("role") == "user").alias("total_queries"))


def intent_breakdown(turns: DataFrame) -> DataFrame:
    """Assistant turns per intent, nulls left out."""
    known = turns.filter((F.col("role") == "assistant") & F.col("intent").isNotNull())
    return known.groupBy("intent").agg(F.count("*").alias("n"))


def intent_ranking(breakdown: DataFrame) -> DataFrame:
    """Rank and bar length. The windows run over one row per intent, not over turns."""
    w = W.orderBy(F.desc("n"), "intent")
    bar = F.round(100 * F.col("n") / F.max("n").over(W.partitionBy())).cast("int")
    return breakdown.withColumn("rank", F.row_number().over(w)).withColumn("bar", bar)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    up = F.count_if(F.col("rating") == "up")
    n = F.count("*")
    return feedback.agg(
        n.alias("total"),
        up.alias("positive"),
        F.count_if(F.col("rating") == "down").alias("negative"),
        F.when(n > 0, F.round(up / n, 2)).otherwise(0.0).alias("ratio"),
    )


def session_list(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions per user, newest first, with a preview from the title or the first user turn."""
    first = (
        turns.filter("role = 'user'")
        .groupBy("session_id")
        .agg(F.min_by(F.substring("content", 1, 37), "seq").alias("head"))
    )
    auto = F.concat(
        F.substring("head", 1, 36), F.when(F.length("head") > 36, "…").otherwise("")
    )
    blank = F.when(F.col("preview") != "", F.col("preview"))
    out = sessions.join(first, "session_id", "left").withColumn(
        "preview", F.coalesce(blank, auto, F.lit(dims.DEFAULT_PREVIEW))
    )
    return out.drop("head").orderBy("user_id", F.desc("created_at"), "session_id")


def session_history(turns: DataFrame) -> DataFrame:
    return turns.orderBy("session_id", "seq")


def rename_sessions(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """Set previews, cut to 120 characters, for the sessions named in ``updates``."""
    new = updates.select("session_id", F.substring("preview", 1, 120).alias("_new"))
    out = sessions.join(new, "session_id", "left")
    return out.withColumn("preview", F.coalesce("_new", "preview")).drop("_new")


def delete_sessions(
    sessions: DataFrame, turns: DataFrame, feedback: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, turns and feedback without the doomed sessions. ``feedback`` is keyed by turn."""
    ids = doomed.select("session_id").distinct()
    gone = turns.join(ids, "session_id", "left_semi").select("turn_id")
    return (
        sessions.join(ids, "session_id", "left_anti"),
        turns.join(ids, "session_id", "left_anti"),
        feedback.join(gone, "turn_id", "left_anti"),
    )


def turn_pairs(turns: DataFrame, block: int = 4096) -> DataFrame:
    """Each user turn with the turn after it when that is the assistant's.

    The next turn is looked up by position in blocks of a session; a copy of the last row of a block
    stands in front of the next one.
    """
    base = turns.withColumn("_b", F.floor(F.col("seq") / block))
    placed = running(base, ["session_id"], ["seq"], "_b", sums={"_pos": F.lit(1)}).drop("_b")
    haloed = with_halo(placed, "_pos", block, 1)
    w = W.partitionBy("session_id", "_halo_block").orderBy("_pos")
    before = F.lag(F.struct("role", "seq", "content")).over(w)
    pairs = haloed.withColumn("_before", before).filter(
        ~F.col("_halo") & (F.col("role") == "assistant") & (F.col("_before.role") == "user")
    )
    return pairs.select(
        "session_id",
        F.col("_before.seq").alias("seq"),
        F.col("_before.content").alias("question"),
        F.col("content").alias("reply"),
        *[c for c in ("intent", "confidence") if c in turns.columns],
    )


def feedback_by_intent(turns: DataFrame, feedback: DataFrame) -> DataFrame:
    joined = feedback.join(turns.select("turn_id", "intent"), "turn_id")
    return joined.groupBy("intent", "rating").agg(F.count("*").alias("n"))


def rate_window_counts(requests: DataFrame, seconds: int = dims.RATE_WINDOW) -> DataFrame:
    """Requests per client in the trailing window, this one included.

    Rows fall into blocks of one window length; a window reaches into the block before it only, so
    each row is also shown to the next block, and a busy client is spread over its blocks. Rows of
    equal time are counted together first.
    """
    at = F.unix_micros("ts")
    width = seconds * 1_000_000
    counted = requests.groupBy("client", at.alias("us")).agg(F.count("*").alias("n"))
    block = F.floor(F.col("us") / width)
    copies = counted.select("*", F.posexplode(F.array(block, block + 1)).alias("_copy", "_block"))
    w = W.partitionBy("client", "_block").orderBy("us").rangeBetween(1 - width, 0)
    sums = copies.withColumn("in_window", F.sum("n").over(w)).filter("_copy = 0")
    return sums.select("client", "us", "n", "in_window")

"""Structured Streaming jobs: the per-key states of the chat service as streams.

Every job writes files below a given path on a shared file system with its checkpoint next to it, so a
restarted query continues where it stopped. A trigger reads a bounded number of files.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.operators import service
from dragoman.operators.routing import Router, read_state
from dragoman.operators.scale import running, with_previous
from dragoman.streaming.ordered import in_order, state_on_disk

LATE = "10 minutes"
FILES_PER_TRIGGER = 16
RATE_SCHEMA = "client long, seq long, us long, accepted boolean"
ROUTE_SCHEMA = "session_id long, seq long, reason string, handled boolean"


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream of a parquet table's files, where the table is one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER)
    return reader.parquet(f"{folder}/{name}.parquet*")


def run_to_files(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything available, then return what was written."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
    )
    with state_on_disk(stream.sparkSession):
        writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], mode: str) -> None:
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# ---------------------------------------------------------------- windows


def stream_sessions(events: DataFrame, idle: str = f"{dims.SESSION_MINUTES} minutes") -> DataFrame:
    """Idle-split sessions of (session_id, ts), sent out once the watermark has passed their end."""
    return (
        events.withWatermark("ts", LATE)
        .groupBy("session_id", F.session_window("ts", idle).alias("w"))
        .agg(F.count("*").alias("turns"))
        .select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")
    )


def stream_stats(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Intent counts per tumbling window of (intent, ts)."""
    counts = events.withWatermark("ts", LATE).groupBy(F.window("ts", width).alias("w"), "intent")
    return counts.agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "intent", "n"
    )


def stream_dedup(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """First arrival per content hash, remembered for at least ``within``."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["content_hash"])


# ---------------------------------------------------------------- rate limit


class Gate:
    """Trailing-window limit: a request passes unless the ``limit``-th last accepted one is still inside the
    window. Only accepted times are held, at most ``limit`` of them."""

    def __init__(self, limit: int, width: int, accepted: list[int] | None = None):
        self.width, self.ring = width, deque(accepted or [], maxlen=limit)

    def __call__(self, at: int) -> bool:
        full = len(self.ring) == self.ring.maxlen and at - self.ring[0] < self.width
        if not full:
            self.ring.append(at)
        return not full


def stream_rate_limit(
    requests: DataFrame, limit: int = dims.RATE_LIMIT, seconds: int = dims.RATE_WINDOW, late: str = LATE
) -> DataFrame:
    """Accept at most ``limit`` requests per client in the trailing window; rejected ones do not count.

    ``requests`` has (client, seq, us). A request is judged once the watermark, ``late`` behind the newest one, has passed
    it. What is remembered is the accepted times of the window, at most ``limit``.
    """
    width = seconds * 1_000_000

    def walk(key: tuple, accepted: list[int] | None, events: list[tuple]) -> tuple[list[int], list[tuple], int]:
        gate = Gate(limit, width, accepted)
        rows = [(key[0], seq, us, gate(us)) for us, seq in events]
        return list(gate.ring), rows, gate.ring[-1] + width

    return in_order(requests, "client", "us long, seq long", RATE_SCHEMA, walk, late)


def rate_limit(
    requests: DataFrame, limit: int = dims.RATE_LIMIT, seconds: int = dims.RATE_WINDOW, block_seconds: int = 3600
) -> DataFrame:
    """Batch twin. A pause of a whole window forgets everything, so each client's stretch between
    such pauses is on its own; stretches are spread by hash and walked in order with only the accepted
    times of one window in memory."""
    width = seconds * 1_000_000
    base = requests.withColumn("_block", F.floor(F.col("us") / (block_seconds * 1_000_000)))
    lagged = with_previous(base, ["client"], ["us", "seq"], "_block", F.col("us"))
    new = F.coalesce(F.col("us") - F.col("prev1") >= width, F.lit(True))
    placed = running(
        lagged.withColumn("_new", new), ["client"], ["us", "seq"], "_block",
        maxes={"stretch": F.when(F.col("_new"), F.col("us"))},
    ).select("client", "stretch", "seq", "us")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gate = None, None
        for rows in batches:
            passed = []
            for client, stretch, at in zip(rows["client"], rows["stretch"], rows["us"], strict=True):
                if (client, stretch) != current:
                    current, gate = (client, stretch), Gate(limit, width)
                passed.append(gate(int(at)))
            yield rows.assign(accepted=passed)[["client", "seq", "us", "accepted"]]

    ordered = placed.repartition("client", "stretch").sortWithinPartitions("client", "stretch", "us", "seq")
    return ordered.mapInPandas(walk, RATE_SCHEMA)


# ---------------------------------------------------------------- routing


def stream_routing(
    turns: DataFrame, threshold: float = dims.LOW_CONFIDENCE, minutes: int = dims.SESSION_MINUTES, patience: int = 3, late: str = LATE
) -> DataFrame:
    """Routing with live state per session: (session_id, seq, ts, intent, confidence) to reasons.

    A turn is routed once the watermark has passed it, by the router of the batch job. The state goes when the session
    has been idle past the watermark.
    """
    router = Router(threshold, patience, minutes * 60_000_000)

    def walk(key: tuple, known: list | None, events: list[tuple]) -> tuple[list, list[tuple], int]:
        state, rows = read_state(known), []
        for us, seq, intent, confidence in events:
            state, reason = router.step(state, us, intent, confidence)
            rows.append((key[0], seq, reason, not reason.startswith("rag:")))
        return list(state), rows, state.active + router.idle

    timed = turns.withColumns({"us": F.unix_micros("ts"), "confidence": F.coalesce("confidence", F.lit(0.0))})
    return in_order(timed, "session_id", "us long, seq long, intent string, confidence double", ROUTE_SCHEMA, walk, late)


# ---------------------------------------------------------------- ingest


def stream_ingest(documents: DataFrame, path: str, strategy: str = "contextual") -> DataFrame:
    """Ingest uploads (doc_name, text, ...) as they arrive; returns the current chunks.

    Each trigger cuts its documents into chunks, gates them, and writes one row per upload to a folder named by its
    number, rewritten whole on a retry. Which upload of a name holds, which copy of a text comes first, and the numbers
    of chunks are decided over all uploads when the chunks are read, so they do not depend on the triggers. Of two
    uploads of a name the one with the later ``uploaded_at`` holds, where documents have that column, else the one
    of the later trigger.
    """

    def write(batch: DataFrame, number: int) -> None:
        at = F.col("uploaded_at").cast("timestamp") if "uploaded_at" in batch.columns else F.lit(None).cast("timestamp")
        rows = service.described(batch).select(*service.META, at.alias("uploaded_at"), F.xxhash64("text").alias("version"), "text")
        service.gated_documents(rows, strategy).write.mode("overwrite").parquet(f"{path}/documents/batch={number}")

    run_batches(documents, path, write, "append")
    return current_chunks(documents.sparkSession, path)


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the newest upload of each document."""
    uploads = spark.read.parquet(f"{path}/documents")
    newest = W.partitionBy("doc_name").orderBy(F.desc_nulls_last("uploaded_at"), F.desc("batch"), "version")
    current = uploads.withColumn("age", F.row_number().over(newest)).filter("age = 1")
    return service.numbered_chunks(current)


def stats_to_files(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Update-mode results: each trigger writes the rows that changed, a reader takes the newest of each key.
    A retried trigger rewrites its own folder, and windows behind the watermark leave the state."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    run_batches(stream, path, write, "update")
    rows = stream.sparkSession.read.parquet(f"{path}/data")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")

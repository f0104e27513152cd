"""Streams over several files, stopped and continued, next to the batch jobs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dragoman.operators import dialogue, service
from dragoman.streaming import jobs as J


def write_files(df, folder, name, numbers, parts=5):
    """Parts of a table as files of one stream folder, part by a number in the rows."""
    for n in numbers:
        df.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet-{n}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(4), 1704067200 + i * 40, rng.choice(["fallback", "greeting", "faq_fees"]), i * 5 // 300) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, session_id long, at long, intent string, part int")
    return df.withColumn("ts", F.timestamp_seconds("at")).cache()


def test_stats_continue_after_a_stop(spark, events, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = events.drop("part").schema
    write_files(events, folder, "e", range(3))
    J.stats_to_files(J.stream_stats(stream(spark, folder, schema)), out, ["start", "intent"])
    write_files(events, folder, "e", range(3, 5))
    got = J.stats_to_files(J.stream_stats(stream(spark, folder, schema)), out, ["start", "intent"]).collect()
    want = events.groupBy(F.date_trunc("hour", "ts").alias("start"), "intent").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def shuffled(rows, reach, parts, seed):
    """Rows out of order by up to ``reach`` seconds (``at``), cut into parts."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r["at"] + rng.randrange(reach))
    return [[r for i, r in enumerate(order) if i * parts // len(order) == n] for n in range(parts)]


def run_files(spark, folder, parts, schema, job):
    """The job over part after part, stopped and continued between them."""
    out = None
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/f{n}")
        out = J.run_to_files(job(stream(spark, f"{folder}/in", schema)), f"{folder}/out")
    return out.collect()


@pytest.mark.parametrize(("reach", "parts"), [(1, 1), (1, 4), (500, 3)])
def test_rate_limit_does_not_depend_on_files_or_order(spark, events, tmp_path, reach, parts):
    rows = [(r.session_id, r.seq, r.at * 1_000_000, r.at) for r in events.collect()]
    table = spark.createDataFrame(rows, "client long, seq long, us long, at long")
    files = [[tuple(r)[:3] for r in part] for part in shuffled(table.collect(), reach, parts, 1)]
    got = run_files(spark, str(tmp_path), files, "client long, seq long, us long", lambda s: J.stream_rate_limit(s, 3, 400))
    ring, want, last = defaultdict(list), {}, max(r[2] for r in rows)
    for client, seq, us, _ in sorted(rows, key=lambda r: r[2]):
        live = [t for t in ring[client] if us - t < 400_000_000]
        if us < last - 600_000_000:
            want[seq] = len(live) < 3
        ring[client] = live + [us] * (len(live) < 3)
    assert {r.seq: r.accepted for r in got} == want and len(got) == len(want) and not all(want.values())


@pytest.mark.parametrize(("reach", "parts"), [(1, 1), (500, 4)])
def test_routing_does_not_depend_on_files_or_order(spark, events, tmp_path, reach, parts):
    turns = events.select("session_id", "seq", "ts", "intent", (F.col("seq") % 10 / 10).alias("confidence"), "at")
    files = [[tuple(r)[:5] for r in part] for part in shuffled(turns.collect(), reach, parts, 2)]
    schema = turns.drop("at").schema
    got = run_files(spark, str(tmp_path), files, schema, lambda s: J.stream_routing(s, patience=2))
    batch = dialogue.route_turns(turns.drop("at"), patience=2).join(turns.select("session_id", "seq", "at"), ["session_id", "seq"])
    last = turns.agg(F.max("at")).first()[0]
    want = {(r.session_id, r.seq): (r.reason, r.handled) for r in batch.collect() if r.at < last - 600}
    assert {(r.session_id, r.seq): (r.reason, r.handled) for r in got} == want and len(got) == len(want)
    assert "escalation" in {r.reason for r in got}


def test_upload_replaces_the_earlier_text(spark, tmp_path):
    long = "This is a sentence of the first upload with enough words. " * 40
    short = "A later upload says something else, in a single paragraph that is long enough to stay. " * 3
    rows = [("a", long, 0), ("b", long.replace("first", "other"), 1), ("a", short, 2)]
    docs = spark.createDataFrame(rows, "doc_name string, text string, part int")
    folder = str(tmp_path / "in")
    schema = docs.drop("part").schema
    for n in range(3):
        write_files(docs, folder, "d", [n])
        got = J.stream_ingest(stream(spark, folder, schema), str(tmp_path / "out"))
    last = spark.createDataFrame([rows[1][:2], rows[2][:2]], schema)
    want, _ = service.ingest_corpus(last)
    assert sorted((r.chunk_id, r.text) for r in got.collect()) == sorted((r.chunk_id, r.text) for r in want.collect())


def test_uploads_in_any_triggers_give_the_same_chunks(spark, tmp_path):
    shared = "The same passage stands in several documents and is kept once, in the first of them by name. " * 6
    own = "Document {} has a part of its own that nobody else has, and it is long enough to stay. " * 4
    uploads = [(f"d{i % 5}", f"{own.replace("{}", str(i))}\n\n{shared}", f"2024-01-{1 + (i * 7) % 20:02d}") for i in range(12)]
    schema = "doc_name string, text string, uploaded_at string"
    newest = {}
    for row in uploads:
        if row[0] not in newest or row[2] > newest[row[0]][2]:
            newest[row[0]] = row
    want, _ = service.ingest_corpus(spark.createDataFrame(list(newest.values()), schema))
    want = sorted((r.chunk_id, r.text, r.total_chunks) for r in want.collect())
    for n, parts in enumerate(([uploads], [uploads[8:], uploads[:3], uploads[3:8]])):
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{n}/in/f{k}")
            got = J.stream_ingest(stream(spark, f"{tmp_path}/{n}/in", spark.createDataFrame([], schema).schema), f"{tmp_path}/{n}/out")
        assert sorted((r.chunk_id, r.text, r.total_chunks) for r in got.collect()) == want


@pytest.mark.parametrize("files", [1, 5])
def test_a_table_may_be_a_folder_of_files(spark, tmp_path, files):
    rows = spark.range(100).withColumn("text", F.concat(F.lit("Some words about the library, number "), F.col("id").cast("string")))
    rows.repartition(files).write.parquet(f"{tmp_path}/in/documents.parquet")
    rows.limit(3).write.parquet(f"{tmp_path}/in/labels.parquet")
    table = J.read_table_stream(spark, f"{tmp_path}/in", "documents")
    docs = table.select(F.concat(F.lit("doc"), "id").alias("doc_name"), "text")
    store = J.stream_ingest(docs, f"{tmp_path}/out")
    assert store.select("doc_name").distinct().count() == 100

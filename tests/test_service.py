import json

from pyspark.sql import functions as F

from dragoman.operators import corpus as C
from dragoman.operators import intents as I
from dragoman.operators import service as P
from dragoman.sources import readers as R

LONG = "The office of the registrar answers questions about the admission of students every day."


def test_records_from_json_lines(spark, tmp_path):
    lines = [
        json.dumps({"id": "a-0", "text": LONG, "category": "jobs", "chunk_index": 0}),
        "",
        "{broken",
        json.dumps({"id": "b-0", "text": LONG, "lang": "en"}),
        json.dumps({"url": "http://x/y", "text": "  " + LONG.upper() + " ", "lang": "fr", "chunk_index": 4}),
        json.dumps({"id": "c-0", "text": "short"}),
    ]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(lines))
    raw = R.read_chunk_records(spark, str(path))
    assert tuple(R.bad_record_counts(raw).first())[:2] == (4, 1)
    rows = P.ingest_records(R.good_records(raw)).collect()
    # the copy in b goes, c is too short, the record without id is named by its url
    assert {r.chunk_id for r in rows if r.doc_name == "a"} == {"a-0"} and len(rows) == 2
    other = next(r for r in rows if r.doc_name != "a")
    assert len(other.doc_name) == 8 and other.text == LONG.upper() and other.category == "general"
    english = P.ingest_records(R.good_records(raw), lang="en").collect()
    assert len(english) == 1  # unknown passes the language filter, fr does not


def test_ingest_statuses_and_dense_indexes(spark):
    body = "\n\n".join(f"Paragraph {i} says: {LONG} It ends here, number {i}." for i in range(20))
    docs = spark.createDataFrame(
        [("a", body), ("b", body), ("c", " \n "), ("d", "0 0 0 1 2 3 4 5 6 7 8 9 . . . . . . . . ."), ("e", body)],
        "doc_name string, text string",
    )
    chunks, status = P.ingest_corpus(docs, docs.filter("doc_name = 'e'").select("doc_name"))
    got = {r.doc_name: r.status for r in status.collect()}
    assert got == {"a": "ok", "b": "no_quality_chunks", "c": "empty", "d": "no_quality_chunks", "e": "already_indexed"}
    rows = sorted(chunks.collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in rows] == list(range(rows[0].total_chunks))
    again = C.upsert_chunks(chunks, chunks)
    assert again.count() == len(rows) and len({r.chunk_id for r in rows}) == len(rows)


def test_split_is_exact_with_one_large_label(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(3000)]
    df = spark.createDataFrame(rows, "item_id long, label string")
    got = {(r.label, r.split): r.n for r in I.stratified_split(df, buckets=8).groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {("big", "val"): 405, ("big", "train"): 2295, ("small", "val"): 45, ("small", "train"): 255}


def test_evaluation_of_a_fixture_file(spark, tmp_path):
    examples = [
        {"text": "fees of the computer science department", "intent": "faq_fees", "entities": [{"type": "DEPARTMENT", "value": "Computer Science"}], "relevant_chunk_ids": ["1"]},
        {"text": "hello there friend", "intent": "greeting"},
    ]
    path = tmp_path / "f.json"
    path.write_text(json.dumps(examples))
    fixture = R.read_eval_fixture(spark, str(path))
    train = spark.createDataFrame(
        [("fees of study and tuition", "faq_fees"), ("hello hello friend", "greeting")] * 20, "text string, label string"
    )
    labels = spark.createDataFrame([("faq_fees",), ("greeting",)], "label string")
    model = I.train_intent(train, labels, features=256, iterations=5, regs=(0.01,))
    chunks = spark.createDataFrame(
        [(1, "fees of computer science", "academics", "high", ""), (2, "library hours", "library", "normal", "")],
        "chunk_id long, text string, category string, priority string, scraped_at string",
    )
    got = {r.metric: r.value for r in P.run_evaluation(fixture, model, chunks, "2025-01-01").collect()}
    assert got["num_examples"] == 2 and got["intent_accuracy"] == 1.0 and got["ner_f1"] == 1.0
    assert got["retrieval_mrr"] == 1.0 and got["retrieval_precision_at_k"] == 0.3333


def test_rows_of_a_label_are_not_gathered(spark):
    """Texts meet the label set where they lie, whatever is known of its size."""
    from dragoman.operators import intents as I

    texts = spark.createDataFrame([("en", "a"), ("en", "b"), ("fr", "c"), (None, "d")], "label string, text string")
    labels = spark.createDataFrame([("en",)], "label string")
    known, rejected = I.known_labels(texts, labels)
    for df, want in ((known, ["a", "b"]), (rejected, ["c", "d"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert sorted(r["text"] for r in df.collect()) == want


def test_tasks_write_one_text_file_per_row(spark, tmp_path):
    """The files are there when the tasks are done; no checksums, nothing half written, every row once."""
    header = "URL: http://a\nTITLE: t\nLANGUAGE: en\nCATEGORY: library\n=====\nbody"
    rows = [("folder1/xx", header), ("folder1/xx", " plain \n"), ("folder2/xx", None), ("folder2/xx", "نص"), ("folder2/xx", "نص")]
    files = spark.createDataFrame(rows, "folder string, value string").repartition(3)
    R.write_text_files(files, str(tmp_path / "corpus"))
    made = [f for f in (tmp_path / "corpus").rglob("*") if f.is_file()]
    assert len(made) == 5 and all(f.suffix == ".txt" for f in made)
    (tmp_path / "corpus" / "folder1" / "xx" / "_part-00009-9").mkdir()
    (tmp_path / "corpus" / "folder1" / "xx" / "_part-00009-9" / "0000000.txt").write_text("of a failed task")
    got = sorted((r.category, r.lang, r.source, r.text) for r in R.read_text_corpus(spark, str(tmp_path / "corpus")).collect())
    assert got == sorted([("library", "en", "", "body"), ("folder1", "xx", "html", "plain"), ("folder2", "xx", "html", ""), ("folder2", "xx", "html", "نص"), ("folder2", "xx", "html", "نص")])


def test_intermediate_tables_leave_no_shuffles(spark):
    import time
    from pathlib import Path

    from dragoman.operators.scale import CLEANUP, cut

    folder = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])

    def shuffles():
        return {f.name for f in folder.rglob("shuffle_*.data")}

    before = shuffles()
    out = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-cut")
    # they are removed in the background
    waited = time.time() + 20
    while shuffles() - before and time.time() < waited:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(CLEANUP) == "false"
    assert out.agg(F.sum("count")).first()[0] == 1000


def test_tasks_list_and_read_what_spark_does(spark, tmp_path):
    """Folders of any depth, odd names, links, empty and hidden files; the driver's list of files is not needed."""
    root = tmp_path / "corpus"
    for name in (
        "top.txt", "a/b/1.txt", "a/b/empty.txt", "a/b/_hidden.txt", "a/b/.dot.txt", "a/b/_k=1.txt", "a/b/9.md", "a/b/_metadata.txt", "_x/2.txt", ".h/3.txt",
        "_metadata/4.txt", "_q=2/5.txt", "k=v/en/6.txt", "sp ace/a%20b+c.txt", "a/#h?/7.txt", "a/b/ü.txt", "a/b/c/d/8.txt", "a/x._COPYING_/9.txt", "none/deep/10.md",
    ):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "empty" in name else f"نص {name}\r\n".encode() + b"\xff")
    (root / "linked").symlink_to(root / "a" / "b" / "c")
    (root / "a" / "l.txt").symlink_to(root / "top.txt")
    (root / "a" / "gone.txt").symlink_to(root / "nothing")

    def rows(df):
        return sorted((r.path, r.value) for r in df.selectExpr("path", "hex(value) AS value").collect())

    assert R._local_folder(spark, str(root)) == str(root) and R._local_folder(spark, f"{root}/a*") is None and R._local_folder(spark, f"{root}/top.txt") is None
    got = R._files_by_tasks(spark, str(root))
    assert rows(got) == rows(R._files_by_spark(spark, str(root))) and got.count() == 12
    plan = R.read_text_corpus(spark, str(root))._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" not in plan and "FileScan text" not in plan


def test_context_needs_no_more_of_a_text_than_the_budget(spark):
    """Texts cut to what the budget can use give the same context, whichever overflows it and wherever."""
    from dragoman.functions import dims
    from dragoman.operators import ranking

    n = dims.CONTEXT_CHARS
    sizes = [0, 1, 299, n // 2, n - dims.CONTEXT_TAIL - 1, n - dims.CONTEXT_TAIL, n - 1, n, n + 1, n + 2, 3 * n]
    rows = [(100 * i + j, k, 1.0 - k / 10, "نx" * (size // 2) + "y" * (size % 2)) for i, a in enumerate(sizes) for j, b in enumerate(sizes) for k, size in enumerate((a, b, 40))]
    hits = spark.createDataFrame([*rows, (9999, 1, 0.5, None)], "query_id long, chunk_id long, score double, document string")
    whole = sorted(map(str, ranking.context_budget(hits).collect()))
    assert sorted(map(str, ranking.context_budget(hits.withColumn("document", ranking.budgeted("document"))).collect())) == whole and len(whole) > 200

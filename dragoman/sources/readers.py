"""Readers for chunk records, text corpora, page text, evaluation fixtures and training sets."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.functions import text as X
from dragoman.operators.scale import cut

RECORD_SCHEMA = (
    "id string, url string, title string, lang string, category string, source string, "
    "text string, chunk_index int, scraped_at string, _bad string"
)
FIXTURE_SCHEMA = (
    "text string, intent string, entities array<struct<type: string, value: string>>, "
    "relevant_chunk_ids array<string>"
)
# Folders that hold no pages.
SKIPPED_FOLDERS = ["_metadata", "_pdfs", "_chunks.jsonl", "_progress.json", "_scraper.log"]


def read_chunk_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with defaults for missing fields; unreadable lines keep their text in ``_bad``."""
    raw = (
        spark.read.schema(RECORD_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )
    text_default = {"url": "", "title": "", "text": "", "scraped_at": "", "id": ""}
    named_default = {"lang": "unknown", "category": "general", "source": "html"}
    return raw.na.fill({**text_default, **named_default, "chunk_index": 0})


def good_records(records: DataFrame) -> DataFrame:
    """Readable records with their document name (the id up to the first dash)."""
    name = F.split("id", "-")[0]
    return records.filter("_bad IS NULL").drop("_bad").withColumn("doc_name", name)


def bad_record_counts(records: DataFrame) -> DataFrame:
    """Readable and unreadable lines, and the characters of text in the readable ones. (Spark refuses
    a scan that asks for nothing but the unreadable lines.)"""
    return records.agg(
        F.count_if(F.col("_bad").isNull()).alias("good"),
        F.count_if(F.col("_bad").isNotNull()).alias("bad"),
        F.sum(F.length("text")).alias("n_chars"),
    )


_HEADER = (
    "(?m)^URL:[ \\t]*(.+)\\nTITLE:[ \\t]*(.*)\\nLANGUAGE:\\s*(\\w+)\\nCATEGORY:\\s*(\\w+)\\n"
    "(?:SCRAPED_AT:[ \\t]*(.+)\\n)?(?:SOURCE:[ \\t]*(.+)\\n)?(?:HEADINGS:[ \\t]*(.*)\\n)?=+\\n"
)


#: Files that a task reads.
FILES = 1 << 15
#: Rows and bytes of files that a task hands on at a time.
ROWS_READ, BYTES_READ = 4096, 1 << 23


def _local_folder(spark: SparkSession, root: str) -> str | None:
    """Path of ``root`` on a mounted file system; None for other file systems, single files, patterns and what is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.makeQualified(where).toUri()
    if uri.getScheme() != "file" or any(c in root for c in "*?[]{}\\") or not system.exists(where) or not system.getFileStatus(where).isDirectory():
        return None
    return uri.getPath()


def _files_by_spark(spark: SparkSession, root: str) -> DataFrame:
    """(value, path) of every ``*.txt`` below ``root``; the driver holds the list of them."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    return files.select("value", F.col("_metadata.file_path").alias("path"))


def _files_by_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows; tasks list the folders, level by level, and read the files, so the driver holds counts only.

    As in Spark's reader, empty files and names that begin with a dot or an underscore are left out, but ``_name=value`` and
    folders ``_metadata...`` are not.
    """

    def hidden(name: str, is_dir: bool) -> bool:
        kept = "=" in name or is_dir and name.startswith(("_metadata", "_common_metadata"))
        return name.startswith(".") or name.startswith("_") and not kept or name.endswith("._COPYING_")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column(0).to_pylist():
                some: list[tuple[bytes, bool]] = []
                with os.scandir(top) as entries:
                    for entry in entries:
                        name, is_dir = os.fsdecode(entry.name), entry.is_dir()
                        if not hidden(name, is_dir) and (is_dir or name.endswith(".txt") and entry.is_file()):
                            some.append((entry.path, is_dir))
                        if len(some) == ROWS_READ:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*some, strict=True)], ["path", "is_dir"])
                            some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*some, strict=True)], ["path", "is_dir"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, paths, size = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    value = f.read()
                if not value:
                    continue
                values.append(value)
                # as a URI tells it: letters beyond ASCII stay
                name = os.fsencode(path).decode(errors="replace")
                paths.append("file:" + "".join(c if ord(c) > 127 and not c.isspace() and c.isprintable() else quote(c, safe="/_-!.~'()*,;:$&+=@") for c in name))
                size += len(value)
                if len(values) == ROWS_READ or size >= BYTES_READ:
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(paths, pa.string())], ["value", "path"])
                    values, paths, size = [], [], 0
        if values:
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(paths, pa.string())], ["value", "path"])

    tasks = 2 * spark.sparkContext.defaultParallelism
    dirs, levels, n = spark.createDataFrame([(bytearray(os.fsencode(folder)),)], "path binary"), [], 0
    while True:
        found = cut(dirs.repartition(tasks, "path").mapInArrow(listed, "path binary, is_dir boolean"), "corpus-paths")
        levels.append(found.filter("NOT is_dir").select("path"))
        counts = found.agg(F.count("*"), F.count_if("is_dir")).first()
        n += counts[0] - counts[1]
        if not counts[1]:
            break
        dirs = found.filter("is_dir").select("path")
    files = reduce(DataFrame.unionAll, levels).repartition(max(tasks, -(-n // FILES)), "path")
    return files.mapInArrow(read, "value binary, path string").select(F.col("value").cast("string").alias("value"), "path")


def read_text_corpus(spark: SparkSession, root: str, category: str | None = None) -> DataFrame:
    """Every ``*.txt`` below ``root`` as one row: header fields, else values from the folders.

    Folders are ``category/lang``; a ``name=value`` folder counts by its value. With ``category``
    only files of that top folder are taken.
    """
    local = _local_folder(spark, root)
    files = _files_by_spark(spark, root) if local is None else _files_by_tasks(spark, local)
    base = root.rstrip("/").split("/")[-1]
    parts = F.transform(
        F.split(F.substring_index("path", f"/{base}/", -1), "/"),
        lambda p: F.regexp_replace(p, "^[^=]*=", ""),
    )
    files = files.withColumn("parts", parts)
    files = files.filter(~F.arrays_overlap("parts", F.array(*[F.lit(s) for s in SKIPPED_FOLDERS])))
    depth = F.size("parts")
    folder = F.when(depth >= 2, F.get("parts", 0)).otherwise("general")
    if category:
        files = files.filter(folder == category)
    has_header = F.col("value").rlike(_HEADER)

    def field(i: int) -> F.Column:
        return F.nullif(X.strip(F.regexp_extract("value", _HEADER, i)), F.lit(""))

    # the body starts after the header; a text without one is a body as a whole
    body = F.when(has_header, F.regexp_replace("value", f"(?s)^.*?{_HEADER}", "")).otherwise(F.col("value"))
    doc_name = F.element_at("parts", -1)
    return files.select(
        doc_name.alias("doc_name"),
        F.coalesce(field(1), F.lit("")).alias("url"),
        F.when(has_header, F.coalesce(field(2), F.lit(""))).otherwise(doc_name).alias("title"),
        F.coalesce(field(3), F.when(depth >= 3, F.get("parts", 1)), F.lit("unknown")).alias("lang"),
        F.coalesce(field(4), folder).alias("category"),
        F.coalesce(field(5), F.lit("")).alias("scraped_at"),
        F.when(has_header, F.coalesce(field(6), F.lit(""))).otherwise("html").alias("source"),
        F.coalesce(field(7), F.lit("")).alias("headings"),
        X.strip(body).alias("text"),
    )


def write_text_files(files: DataFrame, root: str) -> None:
    """A text file of its own below ``root`` for each row (folder, value), as ``read_text_corpus`` reads them.

    On a mounted file system the tasks create the files themselves: there Hadoop, without its native library, starts a process for the
    mode of every file and checksum, and the driver moves the files one by one. A task's folder gets its name when the task is done;
    until then, and after a failure, readers pass over it. On other file systems Spark writes the files.
    """
    spark = files.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    if uri.getScheme() != "file":
        parts = F.split("folder", "/")
        rows = files.select("value", F.get(parts, 0).alias("top"), F.get(parts, 1).alias("second"))
        rows.write.option("maxRecordsPerFile", 1).partitionBy("top", "second").text(root)
        return
    base = uri.getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, n, made = f"part-{task.partitionId():05d}", 0, {}
        for batch in batches:
            for folder, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if folder not in made:
                    made[folder] = f"{base}/{folder}/_{part}-{task.taskAttemptId()}"
                    os.makedirs(made[folder])
                with open(f"{made[folder]}/{n:07d}.txt", "wb") as f:
                    f.write((value or b"") + b"\n")
                n += 1
        for folder, path in made.items():
            try:
                os.rename(path, f"{base}/{folder}/{part}")
            except OSError:
                # another attempt was first
                if not os.path.isdir(f"{base}/{folder}/{part}"):
                    raise
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    files.select("folder", F.col("value").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def assemble_documents(pages: DataFrame) -> DataFrame:
    """Page texts (doc_name, page, text, n_bytes) joined by blank lines in page order.

    Empty and reversed pages are left out of the text; a document of one row per file is what the
    chunkers read.
    """
    clean = X.strip(F.regexp_replace("text", "[ \\t]+", " "))
    used = pages.withColumn("clean", clean)
    usable = (F.col("clean") != "") & ~X.is_reversed(F.col("clean"))
    page = F.when(usable, F.struct("page", "clean"))
    docs = used.groupBy("doc_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(page)), lambda p: p["clean"]), "\n\n").alias("text"),
        F.count("*").alias("pages"),
        F.max("n_bytes").alias("n_bytes"),
    )
    ratio = F.length("text") / F.greatest("n_bytes", F.lit(1))
    empty = F.trim("text") == ""
    return docs.withColumn("yield_ratio", ratio).select(
        "doc_name", "text", "pages", "yield_ratio",
        (empty | (F.col("yield_ratio") < dims.MIN_YIELD)).alias("is_scanned"),
        F.when(empty, "empty").otherwise("ok").alias("status"),
    )


def read_eval_fixture(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON arrays of examples; absent arrays are empty. ``multi_line`` is for one array per file."""
    raw = spark.read.schema(FIXTURE_SCHEMA).option("multiLine", multi_line).json(path)
    return raw.select(
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("intent", F.lit("unknown")).alias("intent"),
        F.coalesce("entities", F.expr("cast(array() AS array<struct<type: string, value: string>>)")).alias("entities"),
        F.coalesce("relevant_chunk_ids", F.expr("cast(array() AS array<string>)")).alias("relevant_chunk_ids"),
    )


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, label string").json(path)

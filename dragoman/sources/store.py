"""The chunk store: buckets of documents, deltas, and one manifest per version.

A chunk lies in the bucket of its document's name. A change writes new files for its own buckets only: rows for inserted or
replaced chunks, tombstones for deleted documents. A manifest lists the files of every bucket; writing one under the next
number, by a rename that fails if the number is taken, is the commit. So a reader sees the version it opened, a failed
write leaves files that no manifest names, and of two writers at a time one has to start again.

Reading merges a bucket's files by the numbers of their commits: the newest row of a chunk holds, unless its document
was deleted later. Buckets without deltas are read as they are. Compaction rewrites single buckets.

What a search needs (vectors, the inverted index) belongs to a version and is built by ``refresh``. A chunk id must belong
to one document.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from dragoman.functions import dims
from dragoman.functions import text as X
from dragoman.functions.arrow import hash_vector
from dragoman.operators.inverted import build_index, read_index
from dragoman.operators.ranking import merge_candidates
from dragoman.operators.search import bm25_over, plain_terms, vector_topk

BUCKETS = 16
#: Files that one commit writes for a bucket at most.
FILES = 8


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Stale(RuntimeError):
    """The store has changed since its search tables were built."""


class ChunkStore:
    """One version of a store; methods that change it commit the next version and return it."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        numbers = self._numbers()
        if not numbers or version is not None and version not in numbers:
            raise FileNotFoundError(f"no version {version or ''} in {root}")
        self.version = numbers[-1] if version is None else version
        path = f"{self.root}/manifests/{self.version:012d}.json"
        self.manifest = json.loads(spark.read.text(path, wholetext=True).first()[0])
        self.schema = StructType.fromJson(self.manifest["schema"])

    # ---------------------------------------------------------------- files

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _listed(self, path: str) -> list[str]:
        where = self._path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._listed(f"{self.root}/manifests") if n.endswith(".json")]

    def _commit(self, manifest: dict, version: int) -> ChunkStore:
        """Publish a manifest under a number that nobody has taken."""
        spark, jvm = self.spark, self.spark._jvm
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{version:012d}.json")
        conf = spark._jsc.hadoopConfiguration()
        fs = draft.getFileSystem(conf)
        fs.mkdirs(final.getParent())
        out = fs.create(draft)
        out.write(json.dumps(manifest).encode())
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), conf)
        options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Conflict(f"version {version} of {self.root} is there") from error
            raise
        return ChunkStore(spark, self.root, version)

    def _write(self, rows: DataFrame, kind: str, seq: int, buckets: int, split: str) -> dict[str, str]:
        """Files of one commit: the folder of each bucket that has rows."""
        folder = f"{self.root}/data/{seq:012d}-{uuid.uuid4().hex[:12]}/{kind}"
        rows = rows.withColumns({"_bucket": bucket(buckets), "_seq": F.lit(seq).cast("long")})
        rows = rows.repartition("_bucket", F.pmod(F.xxhash64(split), F.lit(FILES)))
        rows.write.partitionBy("_bucket").parquet(folder)
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._listed(folder) if n.startswith("_bucket=")}

    # ---------------------------------------------------------------- changes

    def _change(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> ChunkStore:
        seq, buckets = self.version + 1, self.manifest["buckets"]
        parts = {b: {k: list(v) for k, v in p.items()} for b, p in self.manifest["parts"].items()}
        if rows is not None:
            one = W.partitionBy("doc_name", "chunk_id").orderBy(F.xxhash64(*self.schema.names))
            rows = rows.select(self.schema.names).withColumn("_one", F.row_number().over(one)).filter("_one = 1").drop("_one")
        for kind, frame, split in (("rows", rows, "chunk_id"), ("gone", gone, "doc_name")):
            if frame is not None:
                for b, folder in self._write(frame, kind, seq, buckets, split).items():
                    parts.setdefault(b, {"rows": [], "gone": []})[kind].append(folder)
        return self._commit(self.manifest | {"parts": parts}, seq)

    def upsert(self, chunks: DataFrame) -> ChunkStore:
        """Insert chunks, or replace those of the same document and id."""
        return self._change(rows=chunks)

    def delete(self, documents: DataFrame) -> ChunkStore:
        """Remove all chunks of the documents named in ``doc_name``."""
        return self._change(gone=documents.select("doc_name").filter("doc_name IS NOT NULL").distinct())

    def reingest(self, chunks: DataFrame) -> ChunkStore:
        """Replace whole documents in one commit, so that a document that shrank leaves no chunk behind."""
        return self._change(rows=chunks, gone=chunks.select("doc_name").filter("doc_name IS NOT NULL").distinct())

    def compact(self, buckets: Iterable[str] | None = None) -> ChunkStore:
        """Rewrite buckets (default: all with deltas) as one set of files each. Other buckets stay as they are."""
        chosen = [b for b, p in self.manifest["parts"].items() if (b in set(buckets) if buckets is not None else dirty(p))]
        if not chosen:
            return self
        seq = self.version + 1
        written = self._write(self._live(chosen), "rows", seq, self.manifest["buckets"], "chunk_id")
        parts = {b: p for b, p in self.manifest["parts"].items() if b not in chosen}
        parts |= {b: {"rows": [folder], "gone": []} for b, folder in written.items()}
        search = self.manifest.get("search")
        if search and search["of"] >= self.content:
            search = search | {"of": seq}  # the same chunks in other files
        return self._commit(self.manifest | {"parts": parts, "search": search}, seq)

    def refresh(self) -> ChunkStore:
        """Build what a search reads for this version's chunks."""
        seq, folder = self.version + 1, f"{self.root}/search/{self.version + 1:012d}-{uuid.uuid4().hex[:12]}"
        live = self.chunks()
        build_index(live, plain_terms, f"{folder}/index", postings=False)
        live.select("chunk_id", hash_vector(X.search_terms(F.col("text"))).alias("embedding")).write.parquet(f"{folder}/vectors")
        return self._commit(self.manifest | {"search": {"folder": folder, "of": seq}}, seq)

    def vacuum(self, keep: int = 1) -> None:
        """Remove versions but the last ``keep`` up to this one, and files that no later manifest names. For times without writers."""
        kept = [n for n in self._numbers() if n > self.version - keep]
        named: set[str] = set()
        for n in kept:
            manifest = ChunkStore(self.spark, self.root, n).manifest
            named |= {f.split("/data/")[1].split("/")[0] for p in manifest["parts"].values() for v in p.values() for f in v}
            named |= {manifest["search"]["folder"].rsplit("/", 1)[1]} if manifest.get("search") else set()
        fs = self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for n in self._numbers():
            if n not in kept:
                fs.delete(self._path(f"{self.root}/manifests/{n:012d}.json"), False)
        for top in ("data", "search"):
            for name in self._listed(f"{self.root}/{top}"):
                if name not in named:
                    fs.delete(self._path(f"{self.root}/{top}/{name}"), True)

    # ---------------------------------------------------------------- reading

    @property
    def content(self) -> int:
        """The commit that changed the chunks last, as the manifest tells it."""
        folders = [f for p in self.manifest["parts"].values() for v in p.values() for f in v]
        return max([int(f.split("/data/")[1][:12]) for f in folders], default=0)

    def _read(self, folders: list[str], schema: StructType) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _live(self, buckets: list[str]) -> DataFrame:
        """Merged rows of buckets."""
        parts = self.manifest["parts"]
        stamped = StructType([*self.schema.fields]).add("_seq", LongType())
        rows = self._read([f for b in buckets for f in parts[b]["rows"]], stamped)
        gone = self._read([f for b in buckets for f in parts[b]["gone"]], StructType().add(self.schema["doc_name"]).add("_seq", LongType()))
        newest = W.partitionBy("doc_name", "chunk_id").orderBy(F.desc("_seq"))
        rows = rows.withColumn("_age", F.row_number().over(newest)).filter("_age = 1").drop("_age")
        gone = gone.groupBy("doc_name").agg(F.max("_seq").alias("_gone"))
        rows = rows.join(gone, "doc_name", "left").filter("_gone IS NULL OR _gone <= _seq")
        return rows.select(self.schema.names)

    def chunks(self) -> DataFrame:
        """The chunks of this version."""
        parts = self.manifest["parts"]
        clean = [f for p in parts.values() if not dirty(p) for f in p["rows"]]
        merged = [b for b, p in parts.items() if dirty(p)]
        out = [self._read(clean, self.schema)]
        if merged:
            out.append(self._live(merged))
        return reduce(DataFrame.unionByName, out)

    def _search(self, part: str) -> str:
        search = self.manifest.get("search")
        if not search or search["of"] < self.content:
            raise Stale(f"{self.root}: refresh() after a change, then search")
        return f"{search['folder']}/{part}"

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(self._search("vectors"))

    def index(self):
        return read_index(self.spark, self._search("index"))

    def search(self, queries: DataFrame, k: int = dims.POOL_SIZE) -> DataFrame:
        """Merged keyword and vector hits over what is stored: no text is read or tokenised again."""
        asks = queries.select("query_id", hash_vector(X.search_terms(F.col("text"))).alias("embedding"))
        return merge_candidates(bm25_over(self.index(), queries, k), vector_topk(self.vectors(), asks, k))


def dirty(part: dict[str, list[str]]) -> bool:
    return len(part["rows"]) > 1 or bool(part["gone"])


def bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_name"), F.lit(buckets)).cast("int")


def create_store(chunks: DataFrame, root: str, buckets: int = BUCKETS) -> ChunkStore:
    """A new store of (chunk_id, doc_name, text, ...) rows. A change keeps one row of a repeated id."""
    store = object.__new__(ChunkStore)
    store.spark, store.root, store.version, store.schema = chunks.sparkSession, root.rstrip("/"), 0, chunks.schema
    store.manifest = {"buckets": buckets, "schema": json.loads(chunks.schema.json()), "parts": {}, "search": None}
    if store._numbers():
        raise Conflict(f"{root} is there")
    return store.upsert(chunks)


def rewrite_corpus(records: DataFrame, root: str, version: str) -> str:
    """Write a new version next to the old ones, which stay as the backup; an existing version is
    never overwritten."""
    path = f"{root}/version={version}"
    records.write.mode("errorifexists").json(path)
    return path

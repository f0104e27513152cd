"""Keyword search over an impact-ordered inverted index.

The index has four tables. ``forward``: a document's distinct terms with their counts, and its length. ``blocks``: the
postings of a term by falling weight, cut into blocks of bounded size, each with its largest weight; a term of any
frequency is spread over many blocks, and the build sorts postings in ranges, so no task holds a whole term. ``terms``: how
many documents hold a term, its largest weight and its first block. ``shape``: number and mean length of documents.

A search streams ``forward``: a task holds a block of queries and sums, stretch by stretch, what the asked terms add to
each document. It keeps the best k per query, so pairs of a query and a document are neither shuffled nor held, and its
work grows with the documents whatever their ids and weights.

``thresholds``, ``planned`` and ``candidates`` read the postings, and skip documents that cannot be among the best k:

1. The first blocks of the asked terms give sums that are lower bounds of scores; the k-th largest is the query's threshold.
2. Terms are ordered by what they can add at most. Those whose bounds together stay below the threshold only ever
   complete a score: documents are drawn from the other terms. Of their blocks, one is left out if its largest weight and
   the bounds of all other terms together stay below the threshold.
3. The sums so found raise the threshold again. Documents whose sum, with all that the completing terms can add,
   reaches it are candidates; no other can be among the best.

They shuffle pairs of a query and a document, which pays for few queries with rare terms only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.operators.blocks import Parts, score_blocks
from dragoman.operators.scale import cut
from dragoman.session import scratch_dir

#: Postings of a block.
BLOCK = 256
#: Share of the threshold that completing terms may reach. Less reads more postings and scores fewer documents in full.
COMPLETING = 0.5
#: Queries of a block, and those of them that meet a stretch of documents at a time.
HELD, ROWS = 32768, 1024
#: Most blocks of documents; a query is copied to each.
SPREAD = 32
#: Copies of documents that lie on disk at a time.
COPIED = 1 << 17
#: Terms of a stretch that are dense columns at most, and additions of a product that cost what one posting does.
COLUMNS, CHEAPER = 2048, 50
#: Hits of a stretch that are held before the best are kept.
WAITING = 1 << 18
#: Scores are ranked at nine digits; what could tie at that precision is not skipped.
DIGITS, SLACK = 9, 1e-8


@dataclass
class Index:
    forward: DataFrame
    blocks: DataFrame | None
    terms: DataFrame
    shape: DataFrame


def read_index(spark: SparkSession, path: str) -> Index:
    """The index below ``path``; only one with postings knows the largest weight of a term."""
    terms = spark.read.parquet(f"{path}/terms")
    blocks = spark.read.parquet(f"{path}/blocks") if "top" in terms.columns else None
    return Index(spark.read.parquet(f"{path}/forward"), blocks, terms, spark.read.parquet(f"{path}/shape"))


def hashed(analyzer: Callable[[Column], Column], text: str = "text") -> Column:
    return F.transform(analyzer(F.col(text)), lambda t: F.xxhash64(t))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms with counts, a row per document; all rows of a stretch are counted by one sort."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            some = batch.slice(a, 1024)
            lists = some.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            if lists.null_count:
                sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(some)), sizes)
            order = np.lexsort((flat, row))
            flat, row = flat[order], row[order]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(flat)))
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(row[first], minlength=len(some)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat[first], pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                ],
                ["chunk_id", "dl", "terms", "tfs"],
            )


def _blocked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of postings sorted by term and falling weight; a block never spans two batches."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            term, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(n, bool)
            new[1:] = term[1:] != term[:-1]
            start = np.flatnonzero(new)
            place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
            heads = np.flatnonzero(place % size == 0)
            offsets = pa.array(np.append(heads, n), pa.int32())
            ids = batch.column(2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(term[heads]), pa.array(weight[heads]), ids.take(pa.array(heads)), pa.array(np.diff(np.append(heads, n)), pa.int64()),
                    pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(weight)),
                ],
                ["term", "top", "head", "n", "ids", "weights"],
            )

    return run


def weight_of(tf, dl, mean):
    """What an occurrence count adds to a score, before the term's own weight, of columns or of arrays."""
    return tf / (tf + dims.BM25_K1 * (1 - dims.BM25_B + dims.BM25_B * dl / mean))


def build_index(
    chunks: DataFrame, analyzer: Callable[[Column], Column], path: str | None = None, id_col: str = "chunk_id", block: int = BLOCK, postings: bool = True
) -> Index:
    """Write the index of (id, text) rows below ``path``, or the scratch folder. Texts are read and analysed once. Without
    ``postings`` there are no blocks, and of a term the index knows the number of documents only."""
    spark = chunks.sparkSession
    path = path or scratch_dir(spark, "inverted")
    kind = dict(chunks.dtypes)[id_col]
    analysed = chunks.select(F.col(id_col).alias("chunk_id"), hashed(analyzer).alias("terms"))
    counted = analysed.mapInArrow(_counted, f"chunk_id {kind}, dl long, terms array<long>, tfs array<int>")
    counted.filter("dl > 0").write.parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    forward.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("mean")).coalesce(1).write.parquet(f"{path}/shape")
    if not postings:
        terms = forward.select(F.explode_outer("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        terms.write.parquet(f"{path}/terms")
        return read_index(spark, path)
    mean = spark.read.parquet(f"{path}/shape").select("mean").scalar()
    rows = forward.select("chunk_id", "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    rows = rows.select("term", weight_of(F.col("tf"), F.col("dl"), mean).alias("weight"), "chunk_id")
    order = ["term", F.desc("weight"), "chunk_id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = rows.mapInArrow(_blocked(block), f"term long, top double, head {kind}, n long, ids array<{kind}>, weights array<double>")
    blocks.write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    terms = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.min(F.struct((-F.col("top")).alias("top"), "head")).alias("lead"))
    terms.select("term", "df", (-F.col("lead.top")).alias("top"), F.col("lead.head").alias("head")).write.parquet(f"{path}/terms")
    return read_index(spark, path)


def weighed(index: Index, queries: DataFrame, analyzer: Callable[[Column], Column], *more: str) -> DataFrame:
    """(query_id, term, w): weight of a query's term, and ``more`` that the index knows of it."""
    asked = queries.select("query_id", F.explode_outer(hashed(analyzer)).alias("term")).filter("term IS NOT NULL")
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    n = index.shape.select("n").scalar()
    w = F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(index.terms, "term").select("query_id", "term", w.alias("w"), *more)


def asked_terms(index: Index, queries: DataFrame, analyzer: Callable[[Column], Column]) -> DataFrame:
    """(query_id, term, w, bound, top, head): weight of a query's term, the most it can add, and its first block."""
    met = weighed(index, queries, analyzer, "top", "head")
    return met.select("query_id", "term", "w", (F.col("w") * F.col("top")).alias("bound"), "top", "head")


def thresholds(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, theta): what at least k documents of the first blocks score."""
    leads = index.blocks.select("term", F.col("top").alias("b_top"), F.col("head").alias("b_head"), "ids", "weights")
    rows = asked.join(leads, (asked["term"] == leads["term"]) & (F.col("top") == F.col("b_top")) & (F.col("head") == F.col("b_head")))
    rows = rows.select("query_id", "w", F.inline(F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("weights").alias("weight"))))
    sums = rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("weight")).alias("low"))
    return kth(sums, k, "low")


def kth(sums: DataFrame, k: int, column: str) -> DataFrame:
    """(query_id, theta): the k-th largest sum of each query that has so many."""
    by = W.partitionBy("query_id").orderBy(F.desc(column), "chunk_id")
    best = sums.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return best.filter(F.col("rank") == k).select("query_id", F.col(column).alias("theta"))


def planned(asked: DataFrame, theta: DataFrame) -> DataFrame:
    """(query_id, term, w, completes, need, least, rest). Documents are drawn from the terms that do not only complete. ``need``
    is the largest weight that a block must have to be read, ``rest`` what the completing terms can add, ``least`` the sum
    over the others without which a document cannot win."""
    query = W.partitionBy("query_id")
    rows = asked.join(theta, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)) - SLACK)
    rows = rows.withColumn("upto", F.sum("bound").over(query.orderBy("bound", "term").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("all", F.sum("bound").over(query)).withColumn("completes", F.col("upto") < COMPLETING * F.col("theta"))
    rows = rows.withColumn("rest", F.max(F.when(F.col("completes"), F.col("upto")).otherwise(0.0)).over(query))
    need = (F.col("theta") - (F.col("all") - F.col("bound"))) / F.col("w")
    return rows.select("query_id", "term", "w", "completes", need.alias("need"), (F.col("theta") - F.col("rest")).alias("least"), "rest")


def candidates(index: Index, plan: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, seen) of documents that may be among the best, with their sums over the drawing terms.

    The sums over the drawing terms are lower bounds as well, of better documents than the first blocks know, so the
    threshold is raised once more before documents are scored in full.
    """
    blocks = index.blocks.select("term", F.col("top").alias("b_top"), "ids", "weights")
    rows = plan.filter("NOT completes").join(blocks, "term").filter(F.col("b_top") >= F.col("need"))
    rows = rows.select("query_id", "w", "least", "rest", F.inline(F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("weights").alias("weight"))))
    sums = rows.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("w") * F.col("weight")).alias("seen"), F.max("least").alias("least"), F.max("rest").alias("rest")
    )
    sums = cut(sums.filter(F.col("seen") >= F.col("least")).drop("least"), "bm25-sums")
    raised = kth(sums, k, "seen").withColumnRenamed("theta", "raised")
    enough = F.col("seen") + F.col("rest") >= F.coalesce(F.col("raised") - SLACK, F.lit(0.0))
    return sums.join(raised, "query_id", "left").filter(enough).select("query_id", "chunk_id", "seen")


class Keywords(Parts):
    """BM25 of a stream of documents for a block of queries.

    A term asked by many queries and held by many documents of a stretch is a column of two dense matrices, whose product
    gives its part of all scores; postings of the others are added one by one. Both are exact.
    """

    def __init__(self, queries: pa.Table, k: int, mean: float):
        super().__init__(queries["query_id"].combine_chunks(), k, ROWS)
        self.HITS = WAITING
        asked = queries["asked"].combine_chunks()
        flat = asked.flatten()
        self.mean, self.w = mean, flat.field("w").to_numpy()
        self.edge = np.append(0, np.cumsum(asked.value_lengths().to_numpy()))
        self.terms, self.term = np.unique(flat.field("term").to_numpy(), return_inverse=True)
        self.asks = np.bincount(self.term, minlength=len(self.terms))

    def add(self, items: pa.Table) -> None:
        n, size = len(items), len(self.terms)
        lists, tfs = items["terms"].combine_chunks(), items["tfs"].combine_chunks()
        flat = lists.flatten().to_numpy()
        term = np.minimum(np.searchsorted(self.terms, flat), size - 1)
        met = np.flatnonzero(self.terms[term] == flat)
        doc, term = np.repeat(np.arange(n), lists.value_lengths().to_numpy())[met], term[met]
        weight = weight_of(tfs.flatten().to_numpy()[met], items["dl"].to_numpy()[doc], self.mean)
        order = np.argsort(term, kind="stable")
        doc, term, weight = doc[order], term[order], weight[order]
        held = np.bincount(term, minlength=size)
        start = np.cumsum(held) - held
        # of the terms for which the product is cheaper those of most pairs
        pairs = self.asks * held
        dense = np.flatnonzero(pairs * CHEAPER > self.n * n)
        dense = dense[np.argsort(-pairs[dense], kind="stable")[:COLUMNS]]
        column = np.full(size, -1)
        column[dense] = np.arange(len(dense))
        theirs = np.zeros((len(dense), n))
        own = column[term] >= 0
        theirs[column[term[own]], doc[own]] = weight[own]
        ids = items["chunk_id"].combine_chunks()
        for a, best in self.parts:
            rows = len(best.floor)
            part = slice(self.edge[a], self.edge[a + rows])
            row, asked, w = np.repeat(np.arange(rows), np.diff(self.edge[a : a + rows + 1])), self.term[part], self.w[part]
            own = column[asked] >= 0
            ours = np.zeros((rows, len(dense)))
            ours[row[own], column[asked[own]]] = w[own]
            score = ours @ theirs
            row, asked, w = row[~own], asked[~own], w[~own]
            many = held[asked]
            at = np.arange(many.sum()) + np.repeat(start[asked] - np.cumsum(many) + many, many)
            np.add.at(score.reshape(-1), np.repeat(row, many) * n + doc[at], np.repeat(w, many) * weight[at])
            floor = best.floor
            if n > self.k and np.isneginf(floor).any():
                floor = np.maximum(floor, np.partition(score, n - self.k, axis=1)[:, n - self.k])
            # documents of one score are many where texts are copies
            for r, c in self.groups((score > 0) & (score >= floor[:, None] - SLACK)):
                best.keep(r, np.round(score[r, c], DIGITS), ids.take(pa.array(c)))


def scored(index: Index, asked: DataFrame, k: int, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, chunk_id, score): the best k documents per query of each block of documents, or what ``finish`` makes of them."""
    queries = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("asked"))
    queries = cut(queries, "bm25-queries")
    items = index.forward.filter("chunk_id IS NOT NULL")
    mean = index.shape.first()["mean"]

    def scorer(block: pa.Table) -> Keywords:
        return Keywords(block, k, mean)

    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(items.dtypes)['chunk_id']}, score double"
    return score_blocks(items, queries, scorer, schema, per_query_block=HELD, held=HELD, spread=SPREAD, finish=finish, copied=COPIED, stored=True)


def search(
    index: Index, queries: DataFrame, k: int, analyzer: Callable[[Column], Column], finish: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Documents among which the best k of every query are: (query_id, chunk_id, score), or what ``finish`` makes of them."""
    return scored(index, weighed(index, queries, analyzer), k, finish)

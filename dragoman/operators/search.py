"""Keyword and vector search of whole query tables.

Queries and items are dealt to blocks by hash, and every task holds one block of queries and reads one block of items
as a stream (``blocks.score_blocks``), keeping the best k per query. Only these are shuffled again. A term that
occurs in every document never becomes a hot join key, neither side passes through the driver, and more queries
mean more blocks, not fewer results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.functions import text as X
from dragoman.functions.arrow import english_terms
from dragoman.operators import inverted
from dragoman.operators.blocks import Parts, score_blocks
from dragoman.operators.inverted import Index, build_index

DIGITS = 9  # scores are ranked at this precision so that equal texts tie in every task


class Nearest(Parts):
    """The k best items of each query of a block, by cosine at nine digits, ties by id.

    Products are looked over in single precision; what could be among the best within its error is computed in double.
    """

    ROWS = 1024
    #: Items that give a query without k results its first bound.
    FIRST = 1024

    def __init__(self, queries: pa.Table, k: int, exclude_self: bool):
        super().__init__(queries["query_id"].combine_chunks(), k, self.ROWS)
        self.asks = queries["query_id"].to_numpy() if exclude_self else None
        self.unit = units(queries)
        self.rough = self.unit.astype(np.float32)

    def add(self, items: pa.Table) -> None:
        unit = units(items)
        if unit.shape[1] != self.unit.shape[1]:
            raise ValueError("vectors differ in width")
        ids, rough = items["chunk_id"].combine_chunks(), unit.astype(np.float32)
        names = ids.to_numpy(zero_copy_only=False) if self.asks is not None else None
        slack = 2.5e-7 * (unit.shape[1] + 8) + 10.0**-DIGITS
        for a, best in self.parts:
            near = self.rough[a : a + self.ROWS] @ rough.T
            if self.asks is not None:
                near[self.asks[a : a + self.ROWS, None] == names[None, :]] = -np.inf
            floor = best.floor
            first = near[:, : self.FIRST]
            if first.shape[1] > self.k and np.isneginf(floor).any():
                floor = np.maximum(floor, np.partition(first, first.shape[1] - self.k, axis=1)[:, first.shape[1] - self.k])
            # no cosine is below -2, so the query itself is never taken
            hit = near >= np.maximum(floor - slack, -2.0).astype(np.float32)[:, None]
            for row, col in self.groups(hit):
                score = np.empty(len(row))
                for b in range(0, len(row), 1 << 14):
                    some = slice(b, b + (1 << 14))
                    score[some] = np.einsum("ij,ij->i", self.unit[row[some] + a], unit[col[some]])
                best.keep(row, np.round(score, DIGITS), ids.take(pa.array(col)))


def units(t: pa.Table) -> np.ndarray:
    rows = np.asarray(t["v"].combine_chunks().flatten(), np.float64).reshape(len(t), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _schema(items: DataFrame, queries: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(items.dtypes)['chunk_id']}, score double"


def _numbers(df: DataFrame, vector: str) -> Column:
    """The vector as it lies in the table where that is floating; it is computed with in double precision."""
    return F.col(vector) if dict(df.dtypes)[vector] in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")


def top_per_query(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- vectors


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    doc_filter: Column | None = None,
    vector: str = "embedding",
    id_col: str = "chunk_id",
    exclude_self: bool = False,
) -> DataFrame:
    """k nearest vectors per query by cosine distance: (query_id, chunk_id, distance, rank).

    ``doc_filter`` restricts the collection before the search; k is capped by what is left. ``exclude_self``
    leaves out the item that has the query's own id. ``queries`` has (query_id, embedding).
    """
    if doc_filter is not None:
        vectors = vectors.filter(doc_filter)
    items = vectors.select(F.col(id_col).alias("chunk_id"), _numbers(vectors, vector).alias("v"))
    queries = queries.select("query_id", _numbers(queries, "embedding").alias("v"))

    def scorer(block: pa.Table) -> Nearest:
        return Nearest(block, k, exclude_self)

    top = score_blocks(items, queries, scorer, _schema(items, queries), finish=lambda hits: top_per_query(hits, k))
    return top.select("query_id", "chunk_id", F.round(1.0 - F.col("score"), DIGITS).alias("distance"), "rank")


def similarity(distance: Column) -> Column:
    # greatest and least skip nulls, so a missing distance is tested first
    clipped = F.greatest(F.lit(0.0), F.least(1.0 - distance, F.lit(1.0)))
    return F.when(distance.isNull(), 0.0).otherwise(clipped)


# ---------------------------------------------------------------- keywords


def plain_terms(text: Column) -> Column:
    return X.search_terms(text)


def english_field(text: Column) -> Column:
    return english_terms(X.search_terms(text))


def bm25_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = dims.POOL_SIZE,
    analyzer: Callable[[Column], Column] = plain_terms,
    id_col: str = "chunk_id",
) -> DataFrame:
    """BM25 top k per query: (query_id, chunk_id, bm25_score, rank).

    ``chunks`` has (chunk_id, text), ``queries`` (query_id, text). The texts are analysed first, into an index without
    postings; over a stored index use ``bm25_over``.
    """
    return bm25_over(build_index(chunks, analyzer, id_col=id_col, postings=False), queries, k, analyzer)


def bm25_over(
    index: Index, queries: DataFrame, k: int = dims.POOL_SIZE, analyzer: Callable[[Column], Column] = plain_terms
) -> DataFrame:
    """The same over an index that is there."""

    def best(hits: DataFrame) -> DataFrame:
        hits = hits.select("query_id", "chunk_id", F.round("score", DIGITS).alias("bm25_score")).filter("bm25_score > 0")
        return top_per_query(hits, k, "bm25_score")

    return inverted.search(index, queries, k, analyzer, best)


def bm25_best_field(chunks: DataFrame, queries: DataFrame, k: int = dims.POOL_SIZE) -> DataFrame:
    """Score = the better of the plain and the English field.

    A row among the best k by maximum is among the best k of the field it is best in, so the union
    of the two field results is enough.
    """
    plain = bm25_topk(chunks, queries, k, plain_terms)
    english = bm25_topk(chunks, queries, k, english_field)
    best = plain.unionByName(english).groupBy("query_id", "chunk_id").agg(
        F.max("bm25_score").alias("bm25_score")
    )
    return top_per_query(best, k, "bm25_score")


def postings(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Inverted index rows (field, term, chunk_id, tf) for both fields, counted inside the document's row."""
    per_doc = chunks.select(
        F.col(id_col).alias("chunk_id"), X.search_terms(F.col("text")).alias("plain")
    ).withColumn("english", english_terms(F.col("plain")))
    fields = F.map_from_arrays(
        F.array(F.lit("document"), F.lit("document.english")), F.array("plain", "english")
    )
    rows = per_doc.select("chunk_id", F.explode_outer(fields).alias("field", "terms"))
    rows = rows.select("chunk_id", "field", F.explode_outer(X.counted("terms")).alias("t")).filter("t IS NOT NULL")
    return rows.select("field", "t.term", "chunk_id", "t.tf")


def doc_lengths(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return chunks.select(
        F.col(id_col).alias("chunk_id"), F.size(X.search_terms(F.col("text"))).alias("dl")
    )

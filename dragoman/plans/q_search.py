"""Keyword and vector search."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dragoman.operators import embedding as E
from dragoman.operators import search as S
from dragoman.plans import views as V
from dragoman.plans.registry import query

TERMS = (
    r"regexp_extract_all(translate(regexp_replace(lower(text), '[\x{064B}-\x{0652}\x{0640}]', '', 'g'), 'أإآىة', 'ااايه'), '[\p{L}\p{N}_]+')"
)
QUERIES_SQL = (
    "queries AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 "
    "THEN text || ' who is the current dean' ELSE text END AS text FROM benchmark)"
)
BM25_SQL = f"""{QUERIES_SQL},
 dtf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL),
 dl AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM dtf GROUP BY doc_id),
 st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
 df AS (SELECT term, count(*) AS df FROM dtf GROUP BY term),
 qtf AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TERMS}) AS term FROM queries) GROUP BY ALL),
 bm AS (SELECT query_id, doc_id AS chunk_id,
   round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS bm25_score
   FROM qtf JOIN df USING (term) JOIN dtf USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL),
 bmk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 25)"""
NEAR_SQL = (
    "near AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, q.label AS q_label, v.label AS label, "
    "round(1 - round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9), 9) AS distance FROM embeddings q, embeddings v), "
    "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM near) WHERE rank <= 10)"
)


def queries(spark, sf):
    b = V.table(spark, sf, "benchmark")
    text = F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" who is the current dean")))
    return b.select(F.col("item_id").alias("query_id"), text.otherwise(F.col("text")).alias("text"))


def chunks(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), "text")


def vectors(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.withColumnRenamed("vec_id", "chunk_id")


def as_queries(v):
    return v.select(F.col("chunk_id").alias("query_id"), "embedding", F.col("label").alias("q_label"))


@query("vector_topk", f"WITH {NEAR_SQL} SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM top")
def vector_topk(spark, sf):
    v = vectors(spark, sf)
    return S.vector_topk(v, as_queries(v), 10).withColumn("distance", F.round("distance", 6))


@query(
    "vector_topk_filtered",
    f"WITH {NEAR_SQL.replace('embeddings v)', 'embeddings v WHERE v.label = 3)')} SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM top",
)
def vector_topk_filtered(spark, sf):
    v = vectors(spark, sf)
    top = S.vector_topk(v, as_queries(v), 10, doc_filter=F.col("label") == 3)
    return top.withColumn("distance", F.round("distance", 6))


@query("vector_topk_approx")
def vector_topk_approx(spark, sf):
    v = vectors(spark, sf)
    return E.vector_topk_approx(v, as_queries(v), 10)


@query(
    "similarity_from_distance",
    f"WITH {NEAR_SQL} SELECT query_id, chunk_id, round(greatest(0, least(1 - distance, 1)), 6) AS embed_score FROM top",
)
def similarity_from_distance(spark, sf):
    v = vectors(spark, sf)
    top = S.vector_topk(v, as_queries(v), 10)
    return top.select("query_id", "chunk_id", F.round(S.similarity(F.col("distance")), 6).alias("embed_score"))


@query(
    "build_postings",
    f"WITH t AS (SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL) "
    "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, min(chunk_id) AS first_chunk, max(tf) AS max_tf FROM t GROUP BY term",
)
def build_postings(spark, sf):
    p = S.postings(chunks(spark, sf)).filter("field = 'document'")
    return p.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("chunk_id").alias("first_chunk"),
        F.max("tf").alias("max_tf"),
    )


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, chunk_id, round(bm25_score, 6) AS bm25_score, rank FROM bmk")
def bm25_topk(spark, sf):
    top = S.bm25_topk(chunks(spark, sf), queries(spark, sf))
    return top.withColumn("bm25_score", F.round("bm25_score", 6))


@query("bm25_best_field")
def bm25_best_field(spark, sf):
    return S.bm25_best_field(chunks(spark, sf), queries(spark, sf))


@query("embed_corpus")
def embed_corpus(spark, sf):
    c = chunks(spark, sf)
    v = E.embed_corpus(c, E.fit_embedder(c))
    return v.select("chunk_id", vector_to_array("embedding").alias("embedding"))

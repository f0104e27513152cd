"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from dragoman.operators import metrics as M
from dragoman.operators import search as S
from dragoman.plans import views as V
from dragoman.plans.q_search import as_queries, vectors
from dragoman.plans.registry import query

# a rule-based prediction of the quality label from the text, to be scored against the truth
PAIRS = (
    "pairs AS (SELECT 'q' || CASE WHEN n_chars < 300 THEN 0 WHEN n_chars % 7 = 0 THEN 2 ELSE 1 END AS predicted, 'q' || quality AS truth "
    "FROM labels JOIN documents USING (doc_id))"
)


def pairs(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars")
    guess = F.when(n < 300, "q0").when(n % 7 == 0, "q2").otherwise("q1")
    return V.table(spark, sf, "labels").join(d, "doc_id").select(
        guess.alias("predicted"), F.concat(F.lit("q"), "quality").alias("truth")
    )


PER_CLASS = f"""{PAIRS}, l AS (SELECT DISTINCT truth AS label FROM pairs),
 c AS (SELECT label, count_if(predicted = label AND truth = label) AS tp, count_if(predicted = label AND truth <> label) AS fp,
   count_if(predicted <> label AND truth = label) AS fn FROM l CROSS JOIN pairs GROUP BY label),
 pr AS (SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, (tp + fn)::BIGINT AS support FROM c),
 per_class AS (SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, support FROM pr)"""


@query("intent_accuracy", f"WITH {PAIRS} SELECT round(avg((predicted = truth)::INT), 4) AS accuracy FROM pairs")
def intent_accuracy(spark, sf):
    return M.intent_accuracy(pairs(spark, sf))


@query("per_class_f1", f"WITH {PER_CLASS} SELECT * FROM per_class")
def per_class_f1(spark, sf):
    return M.per_class_f1(pairs(spark, sf))


@query("macro_f1", f"WITH {PER_CLASS} SELECT round(avg(f1::DECIMAL(20,12)), 4) AS macro_f1 FROM per_class")
def macro_f1(spark, sf):
    return M.macro_f1(M.per_class_f1(pairs(spark, sf)))


# entities of two kinds of extraction over the same texts: capitalised words against long words
SPANS = (
    "p AS (SELECT DISTINCT doc_id AS example, 'T' || length(v) % 3 AS type, lower(trim(v)) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS v FROM documents)), "
    "t AS (SELECT DISTINCT doc_id AS example, 'T' || length(v) % 3 AS type, lower(trim(v)) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]?[a-z]{6,}')) AS v FROM documents)), "
    "s AS (SELECT count(*) FILTER (p.example IS NOT NULL AND t.example IS NOT NULL) AS tp, count(*) FILTER (t.example IS NULL) AS fp, count(*) FILTER (p.example IS NULL) AS fn "
    "FROM p FULL OUTER JOIN t ON p.example = t.example AND p.type = t.type AND p.value = t.value)"
)


def spans(spark, sf, pattern):
    d = V.table(spark, sf, "documents")
    v = d.select(F.col("doc_id").alias("example"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("value"))
    return v.withColumn("type", F.concat(F.lit("T"), F.length("value") % 3))


@query(
    "ner_micro_f1",
    f"WITH {SPANS}, r AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM s) SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM r",
)
def ner_micro_f1(spark, sf):
    return M.ner_micro_f1(spans(spark, sf, "[A-Z][a-z]+"), spans(spark, sf, "[A-Z]?[a-z]{6,}"))


RANKED = """near AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, q.label = v.label AS relevant,
   row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9), 9), v.vec_id) AS rank
   FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id),
 hits AS (SELECT * FROM near WHERE rank <= 10), nrel AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label),
 per AS (SELECT query_id, count_if(relevant AND rank <= 3) AS h, min(CASE WHEN relevant THEN rank END) AS first,
   coalesce(sum(CASE WHEN relevant AND rank <= 3 THEN 1 / log2(rank + 1) END), 0) AS dcg FROM hits GROUP BY query_id),
 sc AS (SELECT query_id, h / 3 AS precision, CASE WHEN n > 0 THEN h / n ELSE 0 END AS recall, coalesce(1 / first, 0) AS rr,
   CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(3, n) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg
   FROM per JOIN embeddings e ON e.vec_id = query_id JOIN nrel USING (label))"""


def scores(spark, sf):
    """Scores of each vector as a query for its label; the vector itself is left out before the top k."""
    v = vectors(spark, sf)
    q = as_queries(v)
    top = S.vector_topk(v, q, 10, exclude_self=True)
    labelled = top.join(q.select("query_id", "q_label"), "query_id").join(v.select("chunk_id", "label"), "chunk_id")
    hits = labelled.select("query_id", "rank", "chunk_id", (F.col("q_label") == F.col("label")).alias("relevant"))
    counts = v.groupBy("label").agg((F.count("*") - 1).alias("n"))
    n = q.join(counts, F.col("q_label") == F.col("label")).select("query_id", "n")
    return M.retrieval_scores(hits, q, n)


@query("precision_at_k", f"WITH {RANKED} SELECT round(avg(precision::DECIMAL(20,12)), 4) AS precision_at_k FROM sc")
def precision_at_k(spark, sf):
    return M.mean_of(scores(spark, sf), "precision", "precision_at_k")


@query("recall_at_k", f"WITH {RANKED} SELECT round(avg(recall::DECIMAL(20,12)), 4) AS recall_at_k FROM sc")
def recall_at_k(spark, sf):
    return M.mean_of(scores(spark, sf), "recall", "recall_at_k")


@query("mrr", f"WITH {RANKED} SELECT round(avg(rr::DECIMAL(20,12)), 4) AS mrr FROM sc")
def mrr(spark, sf):
    return M.mean_of(scores(spark, sf), "rr", "mrr")


@query("ndcg_at_k", f"WITH {RANKED} SELECT round(avg(ndcg::DECIMAL(20,12)), 4) AS ndcg_at_k FROM sc")
def ndcg_at_k(spark, sf):
    return M.mean_of(scores(spark, sf), "ndcg", "ndcg_at_k")


@query(
    "evaluation_report",
    f"WITH {PER_CLASS}, {SPANS.replace('p AS', 'ep AS', 1).replace(', t AS', ', et AS').replace('p.example', 'ep.example').replace('t.example', 'et.example').replace('p.type = t.type', 'ep.type = et.type').replace('p.value = t.value', 'ep.value = et.value').replace('FROM p FULL OUTER JOIN t', 'FROM ep FULL OUTER JOIN et').replace('s AS (SELECT count', 'es AS (SELECT count')}, {RANKED}, "
    "er AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM es) "
    "SELECT 'intent_accuracy' AS metric, round(avg((predicted = truth)::INT), 4) AS value FROM pairs UNION ALL "
    "SELECT 'intent_macro_f1', round(avg(f1::DECIMAL(20,12)), 4) FROM per_class UNION ALL "
    "SELECT 'ner_precision', round(p, 4) FROM er UNION ALL SELECT 'ner_recall', round(r, 4) FROM er UNION ALL SELECT 'ner_f1', round(2 * p * r / (p + r), 4) FROM er UNION ALL "
    "SELECT 'retrieval_precision_at_k', round(avg(precision::DECIMAL(20,12)), 4) FROM sc UNION ALL SELECT 'retrieval_recall_at_k', round(avg(recall::DECIMAL(20,12)), 4) FROM sc UNION ALL "
    "SELECT 'retrieval_mrr', round(avg(rr::DECIMAL(20,12)), 4) FROM sc UNION ALL SELECT 'retrieval_ndcg_at_k', round(avg(ndcg::DECIMAL(20,12)), 4) FROM sc UNION ALL SELECT 'num_examples', count(*)::DOUBLE FROM pairs",
)
def evaluation_report(spark, sf):
    p = pairs(spark, sf)
    ner = M.ner_micro_f1(spans(spark, sf, "[A-Z][a-z]+"), spans(spark, sf, "[A-Z]?[a-z]{6,}"))
    retrieval = scores(spark, sf).agg(
        *[M.mean(c).alias(f"retrieval_{c}{at}") for c, at in (("precision", "_at_k"), ("recall", "_at_k"), ("rr", ""), ("ndcg", "_at_k"))]
    )
    retrieval = retrieval.withColumnRenamed("retrieval_rr", "retrieval_mrr")
    parts = [
        M.intent_accuracy(p).withColumnRenamed("accuracy", "intent_accuracy"),
        M.macro_f1(M.per_class_f1(p)).withColumnRenamed("macro_f1", "intent_macro_f1"),
        ner.select(*[F.col(c).alias(f"ner_{c}") for c in ner.columns]),
        retrieval,
        p.agg(F.count("*").alias("num_examples")),
    ]
    return M.evaluation_report([M.as_rows(x) for x in parts])

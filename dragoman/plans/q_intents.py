"""Intent classification jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dragoman.operators import intents as I
from dragoman.plans import views as V
from dragoman.plans.registry import query

LABELS = ["de", "en", "es", "fr", "it"]


def examples(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("label"), "text")


def label_set(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(LABELS)], "idx int, label string")


@query(
    "stratified_split",
    "WITH o AS (SELECT lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n, doc_id FROM documents) "
    "SELECT doc_id AS item_id, label, CASE WHEN rn <= floor(0.15::DOUBLE * n) THEN 'val' ELSE 'train' END AS split FROM o",
)
def stratified_split(spark, sf):
    return I.stratified_split(examples(spark, sf)).select("item_id", "label", "split")


@query(
    "class_weights",
    f"WITH l AS (SELECT unnest({V.sql_list(LABELS)}) AS label), c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang), "
    "w AS (SELECT label, 1 / coalesce(n, 1) AS w FROM l LEFT JOIN c USING (label)) SELECT label, round(w / avg(w) OVER (), 6) AS weight FROM w",
)
def class_weights(spark, sf):
    w = I.class_weights(examples(spark, sf), label_set(spark))
    return w.withColumn("weight", F.round("weight", 6))


def model_for(spark, sf):
    return I.train_intent(examples(spark, sf), label_set(spark))


@query("train_intent")
def train_intent(spark, sf):
    p = I.predict_intent(examples(spark, sf), model_for(spark, sf))
    return p.groupBy("label", "intent").agg(F.count("*").alias("n"))


@query("predict_intent")
def predict_intent(spark, sf):
    p = I.predict_intent(examples(spark, sf), model_for(spark, sf))
    return p.select("item_id", "intent", "confidence", "below_threshold", F.to_json("all_scores").alias("all_scores"))


@query(
    "threshold_intent",
    f"WITH {V.EVENT_TURNS} SELECT seq, CASE WHEN confidence < 0.3 THEN 'fallback' ELSE intent END AS intent, confidence < 0.3 AS below_threshold FROM event_turns",
)
def threshold_intent(spark, sf):
    e = V.event_turns(spark, sf)
    return e.select(
        "seq", I.threshold_intent(F.col("intent"), F.col("confidence")).alias("intent"),
        (F.col("confidence") < 0.3).alias("below_threshold"),
    )


@query(
    "top_k_intents",
    "WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS i, embedding FROM embeddings), x AS (SELECT vec_id, 'intent_' || i AS top_intent, round(embedding[i + 1]::DOUBLE, 6) AS score FROM s) "
    "SELECT * FROM (SELECT vec_id, top_intent, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, top_intent)::INT AS rank FROM x) WHERE rank <= 3",
)
def top_k_intents(spark, sf):
    e = V.table(spark, sf, "embeddings")
    vals = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    names = F.transform("embedding", lambda _, i: F.concat(F.lit("intent_"), i.cast("string")))
    p = e.select("vec_id", F.map_from_arrays(names, vals).alias("all_scores"))
    return I.top_k_intents(p)


@query(
    "prediction_stats",
    f"WITH {V.EVENT_TURNS}, c AS (SELECT CASE WHEN confidence < 0.3 THEN 'fallback' ELSE intent END AS intent, count(*) AS n FROM event_turns GROUP BY ALL) "
    "SELECT intent, n, sum(n) OVER ()::BIGINT AS total, count(*) OVER () AS unique_intents, round(sum(CASE WHEN intent = 'unknown' THEN n ELSE 0 END) OVER () / sum(n) OVER (), 6) AS unknown_rate, "
    "round(sum(CASE WHEN intent = 'fallback' THEN n ELSE 0 END) OVER () / sum(n) OVER (), 6) AS fallback_rate FROM c",
)
def prediction_stats(spark, sf):
    e = V.event_turns(spark, sf)
    return I.prediction_stats(e.withColumn("intent", I.threshold_intent(F.col("intent"), F.col("confidence"))))


@query(
    "label_check",
    "WITH m AS (SELECT (row_number() OVER (ORDER BY lang) - 1)::INT AS idx, lang AS model_label FROM (SELECT DISTINCT lang FROM documents)), "
    f"c AS (SELECT unnest(range(5))::INT AS idx, unnest({V.sql_list(sorted(LABELS, reverse=True))}) AS config_label) "
    "SELECT idx, model_label, config_label FROM m FULL OUTER JOIN c USING (idx) WHERE model_label IS DISTINCT FROM config_label",
)
def label_check(spark, sf):
    from pyspark.sql import Window as W

    seen = V.table(spark, sf, "documents").select(F.col("lang").alias("label")).distinct()
    model = seen.withColumn("idx", F.row_number().over(W.orderBy("label")) - 1)  # one row per label
    config = spark.createDataFrame(list(enumerate(sorted(LABELS, reverse=True))), "idx int, label string")
    return I.label_check(model, config)

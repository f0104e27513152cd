"""Text and vector featurisers fitted with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dragoman.functions import text as X
from dragoman.operators import ivf


def fit_embedder(df: DataFrame, text: str = "text", width: int = 384) -> PipelineModel:
    """Hashed term counts, inverse document frequency, unit length."""
    stages = [
        HashingTF(inputCol="terms", outputCol="tf", numFeatures=width),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="embedding", p=2.0),
    ]
    return Pipeline(stages=stages).fit(df.withColumn("terms", X.search_terms(F.col(text))))


def embed_corpus(df: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """One unit vector per text."""
    out = model.transform(df.withColumn("terms", X.search_terms(F.col(text))))
    return out.drop("terms", "tf", "tfidf")


def vector_topk_approx(
    vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, pool: int | None = None, **index: int
) -> DataFrame:
    """Approximate nearest neighbours: inverted lists with product-quantised residuals, built for this search (``ivf``).

    (query_id, chunk_id, distance, rank) with exact distances; every query gets k rows if the collection has them.
    Over a stored index use ``ivf.search``.
    """
    return ivf.search(ivf.build(vectors, **index), queries, k, probes, pool)

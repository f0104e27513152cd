"""Evaluation metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def intent_accuracy(pairs: DataFrame) -> DataFrame:
    """Share of rows of (predicted, truth) that agree; 0 for no rows."""
    hit = F.avg(F.col("predicted").eqNullSafe(F.col("truth")).cast("double"))
    return pairs.agg(F.coalesce(F.round(hit, 4), F.lit(0.0)).alias("accuracy"))


def per_class_f1(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per truth label, from the confusion counts."""
    cells = pairs.groupBy("predicted", "truth").agg(F.count("*").alias("n"))
    # each cell counts for its truth label and, when they differ, for its predicted label
    sides = cells.select(
        F.explode(
            F.when(
                F.col("predicted") == F.col("truth"),
                F.array(F.struct(F.col("truth").alias("label"), F.lit("tp").alias("kind"))),
            ).otherwise(
                F.array(
                    F.struct(F.col("truth").alias("label"), F.lit("fn").alias("kind")),
                    F.struct(F.col("predicted").alias("label"), F.lit("fp").alias("kind")),
                )
            )
        ).alias("s"),
        "n",
    )

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("s.kind") == kind, F.col("n"))), F.lit(0))

    sums = sides.groupBy("s.label").agg(
        total("tp").alias("tp"), total("fp").alias("fp"), total("fn").alias("fn")
    )
    if labels is None:
        sums = sums.filter(F.col("tp") + F.col("fn") > 0)
    else:
        named = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        sums = named.join(sums, "label", "left").na.fill(0)
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        "label",
        F.round(p, 4).alias("precision"),
        F.round(r, 4).alias("recall"),
        F.round(_f1(p, r), 4).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def macro_f1(per_class: DataFrame) -> DataFrame:
    return per_class.agg(mean("f1").alias("macro_f1"))


def ner_micro_f1(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Micro scores over distinct (example, type, value) of two entity tables."""

    def spans(df: DataFrame, flag: str) -> DataFrame:
        value = F.trim(F.lower("value")).alias("value")
        return df.select("example", "type", value).distinct().withColumn(flag, F.lit(1))

    both = spans(predicted, "p").join(spans(truth, "t"), ["example", "type", "value"], "full_outer")
    s = both.agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
    )
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select(
        F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(_f1(p, r), 4).alias("f1")
    )


def retrieval_scores(hits: DataFrame, relevant: DataFrame, n_relevant: DataFrame, k: int = 3) -> DataFrame:
    """Per query: precision, recall, reciprocal rank and NDCG, from ranked hits.

    ``hits`` has (query_id, rank, chunk_id, relevant boolean) for every evaluated query with hits,
    ``relevant`` names the evaluated queries, ``n_relevant`` is (query_id, n) with the number of
    relevant chunks. Queries without hits score 0.
    """
    good, top = F.col("relevant"), F.col("rank") <= k
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    per = hits.groupBy("query_id").agg(
        F.count_if(good & top).alias("hits"),
        F.min(F.when(good, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(good & top, gain)), F.lit(0.0)).alias("dcg"),
    )
    q = relevant.select("query_id").distinct().join(per, "query_id", "left").join(
        n_relevant, "query_id", "left"
    )
    n = F.coalesce("n", F.lit(0))
    ideal = F.aggregate(
        F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= n),
        F.lit(0.0),
        lambda acc, i: acc + 1.0 / F.log2(i + 1.0),
    )
    h = F.coalesce("hits", F.lit(0))
    return q.select(
        "query_id",
        (h / k).alias("precision"),
        _ratio(h, n).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        _ratio(F.coalesce("dcg", F.lit(0.0)), ideal).alias("ndcg"),
    )


def mean(column: str | Column) -> Column:
    """Mean to four digits, summed in decimals so that the order of the rows does not decide a rounding tie."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.round(F.avg(value.cast("decimal(20,12)")), 4).cast("double"), F.lit(0.0))


def mean_of(scores: DataFrame, column: str, out: str) -> DataFrame:
    return scores.agg(mean(column).alias(out))


def evaluation_report(parts: list[DataFrame]) -> DataFrame:
    """One row from one-row tables of (metric, value)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def as_rows(df: DataFrame) -> DataFrame:
    """Turn the columns of a one-row table into (metric, value) rows."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]
    )
    return df.select(F.explode(pairs).alias("x")).select("x.metric", "x.value")

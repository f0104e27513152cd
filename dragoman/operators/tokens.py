"""Token tables, stop words, stem dimension and vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.functions import text as X
from dragoman.operators.scale import explode_rows


def tokenize(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Token rows (id, pos, token, arabic)."""
    t = F.col(text)
    # two projections: columns next to an explode are evaluated once per exploded row
    per_doc = df.select(id_col, X.is_arabic(t).alias("arabic"), X.tokens(t).alias("toks"))
    return explode_rows(per_doc, "toks", "pos", "token")


def stop_phrases(extra: dict[str, list[str]] | None = None) -> list[str]:
    words = [*dims.ARABIC_STOPWORDS, *(extra or {}).get("arabic", [])]
    return sorted({w for w in words if " " in w})


def is_stop(token: Column, arabic: Column, extra: dict[str, list[str]] | None = None) -> Column:
    """The stop test as an ``IN`` list: evaluated in the scan stage, nothing is joined."""
    extra = extra or {}
    ar = [w for w in [*dims.ARABIC_STOPWORDS, *extra.get("arabic", [])] if " " not in w]
    en = [*dims.ENGLISH_STOPWORDS, *extra.get("english", [])]
    return F.when(arabic, token.isin(ar)).otherwise(token.isin(en))


def remove_stopwords(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    extra: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Content tokens (id, pos, token): Arabic phrases out, stop tokens out, stem, stop tokens out."""
    t = F.col(text)
    arabic = X.is_arabic(t)
    norm = X.remove_stop_phrases(X.normalize_arabic(t), stop_phrases(extra))
    runs = F.regexp_extract_all(norm, F.lit(f"({X.TOKEN_ARABIC})"), 1)
    per_doc = df.select(
        id_col,
        arabic.alias("arabic"),
        F.when(arabic, runs).otherwise(X.latin_tokens(t)).alias("toks"),
    )
    toks = explode_rows(per_doc, "toks", "pos", "raw")
    kept = toks.filter(~is_stop(F.col("raw"), F.col("arabic"), extra)).withColumn(
        "token", F.when(F.col("arabic"), X.light_stem(F.col("raw"))).otherwise(F.col("raw"))
    )
    return kept.filter(~is_stop(F.col("token"), F.col("arabic"), extra)).select(
        id_col, "pos", "token"
    )


def stem_dimension(tokens: DataFrame, aggressive: bool = False) -> DataFrame:
    """One row per distinct token with its light stem."""
    d = tokens.select("token").distinct()
    return d.withColumn("stem", X.light_stem(F.col("token"), aggressive))


def annotate(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Token rows with lemma and stop flag. The stem is a codegen expression, so it is computed in
    place; joining a stem dimension would shuffle the token table instead."""
    toks = tokenize(df, id_col, text)
    lemma = F.when(F.col("arabic"), X.light_stem(F.col("token")))
    return toks.withColumn("lemma", lemma).withColumn(
        "is_stopword", is_stop(F.col("token"), F.col("arabic"))
    )


def token_report(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: tokens, tokens without stop words, removed, tokens a stem changes."""
    toks = F.col("toks")
    arabic = F.col("arabic")
    base = df.select(
        id_col,
        X.is_arabic(F.col(text)).alias("arabic"),
        X.tokens(F.col(text)).alias("toks"),
    )
    counted = base.select(id_col, "arabic", F.size(toks).alias("token_count"))
    content = remove_stopwords(df, id_col, text).groupBy(id_col).agg(
        F.count("*").alias("content_count")
    )
    changed = (
        base.filter(arabic)
        .select(id_col, F.explode(toks).alias("token"))
        .groupBy(id_col)
        .agg(F.count_if(X.light_stem(F.col("token")) != F.col("token")).alias("stem_changes"))
    )
    out = counted.join(content, id_col, "left").join(changed, id_col, "left")
    n = F.coalesce("content_count", F.lit(0))
    return out.select(
        id_col,
        "token_count",
        n.alias("content_count"),
        (F.col("token_count") - n).alias("removed"),
        F.coalesce("stem_changes", F.lit(0)).alias("stem_changes"),
    )


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """Term and document frequency. Tokens are counted inside the document's row, so one row per
    document and term is left, summed map-side first: a frequent term never lands whole in one task."""
    per_doc = df.select(X.counted(X.tokens(F.col(text))).alias("t"))
    rows = per_doc.select(F.explode_outer("t").alias("t")).filter("t IS NOT NULL")
    return rows.groupBy("t.term").agg(F.sum("t.tf").alias("tf"), F.count("*").alias("df")).withColumnRenamed("term", "token")

"""Fusion of keyword and vector hits, score adjustments, and what is built from ranked hits.

Hits are keyed by (query_id, chunk_id). Windows here run over the hits of one query, whose number is
bounded by the candidate pools.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.functions import text as X
from dragoman.functions.arrow import hash_vector
from dragoman.operators import search as S
from dragoman.operators.search import top_per_query

DIGITS = 9


def enrich_query(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Append the distinct normalised entity values, in type order, then position.

    ``entities`` has (query_id, type_order, start, value).
    """
    norm = entities.withColumn("norm", X.for_classification(F.col("value"))).filter("norm <> ''")
    first = norm.groupBy("query_id", "norm").agg(
        F.min(F.struct("type_order", "start")).alias("at")
    )
    extra = first.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("at", "norm"))), lambda x: x["norm"]), " "
        ).alias("extra")
    )
    joined = queries.join(extra, "query_id", "left")
    return joined.withColumn("text", F.concat_ws(" ", "text", "extra")).drop("extra")


def expand_query(text: Column) -> Column:
    """Append the light-stemmed text when it differs."""
    stem = X.light_stem_text(text)
    return F.when((stem != "") & (stem != text), F.concat_ws(" ", text, stem)).otherwise(text)


def is_excluded(
    category: Column,
    current: Column,
    exclude: list[str] | None = None,
    include_news: bool = False,
) -> Column:
    """Category exclusion of a query: the caller's list or the default, news added back for
    questions about the present."""
    names = set(dims.EXCLUDED_CATEGORIES if exclude is None else exclude)
    if include_news:
        names.discard("news_events")
    base = category.isin(sorted(names)) if names else F.lit(False)
    return F.coalesce(base | (current & (category == "news_events")), F.lit(False))


def merge_candidates(bm25: DataFrame, near: DataFrame) -> DataFrame:
    """Union by (query, chunk); the missing side scores 0 and has no distance."""
    left = bm25.select("query_id", "chunk_id", "bm25_score")
    right = near.select("query_id", "chunk_id", "distance")
    both = left.join(right, ["query_id", "chunk_id"], "full_outer")
    return both.select(
        "query_id",
        "chunk_id",
        F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"),
        S.similarity(F.col("distance")).alias("embed_score"),
        "distance",
    )


def max_normalize(hits: DataFrame, column: str, out: str) -> DataFrame:
    top = F.max(column).over(W.partitionBy("query_id"))
    return hits.withColumn("_top", top).withColumn(
        out, F.when(F.col("_top") <= 0, 0.0).otherwise(F.col(column) / F.col("_top"))
    ).drop("_top")


def boost(priority: Column) -> Column:
    out = None
    for name, factor in dims.PRIORITY_BOOST.items():
        out = F.when(priority == name, factor) if out is None else out.when(priority == name, factor)
    return out.otherwise(1.0)


def freshness(category: Column, scraped_at: Column, current: Column, as_of: str) -> Column:
    """Factor for old or undated news on questions about the present; unreadable dates pass."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {dims.FRESH_DAYS} DAYS")
    undated = F.coalesce(scraped_at, F.lit("")) == ""
    stale = undated | F.coalesce(F.try_to_timestamp(scraped_at) < cutoff, F.lit(False))
    return F.when(current & (category == "news_events") & stale, dims.STALE_FACTOR).otherwise(1.0)


def with_chunk_columns(hits: DataFrame, chunks: DataFrame, columns: list[str | Column]) -> DataFrame:
    """Fetch chunk columns for hits; the planner picks the join by the sizes it finds."""
    return chunks.select("chunk_id", *columns).join(hits, "chunk_id")


def candidates(
    chunks: DataFrame,
    queries: DataFrame,
    exclude: list[str] | None = None,
    include_news: bool = False,
    bm25_k: int = dims.POOL_SIZE,
    embed_k: int = dims.POOL_SIZE,
) -> DataFrame:
    """Merged candidate pools with chunk metadata, ``current`` and normalised scores.

    ``chunks`` has (chunk_id, text, category, priority, scraped_at). The keyword side loses excluded
    categories after its top k, the vector side only later, so the pools keep their meaning.
    """
    bm25 = S.bm25_topk(chunks, queries, bm25_k)
    vectors = chunks.select("chunk_id", hash_vector(X.search_terms(F.col("text"))).alias("embedding"))
    asks = queries.select("query_id", hash_vector(X.search_terms(F.col("text"))).alias("embedding"))
    near = S.vector_topk(vectors, asks, embed_k)
    flags = queries.select("query_id", X.is_current_state(F.col("text")).alias("current"))
    hits = merge_candidates(bm25, near).withColumn("from_bm25", F.col("bm25_score") > 0)
    hits = hits.join(flags, "query_id")
    meta = ["category", "priority", "scraped_at"]
    full = with_chunk_columns(hits, chunks, meta)
    out = is_excluded(F.col("category"), F.col("current"), exclude, include_news)
    # an excluded keyword hit leaves the pool, unless the vector side found the chunk as well
    full = full.withColumn("excluded", out).withColumn(
        "bm25_score", F.when(F.col("excluded"), 0.0).otherwise(F.col("bm25_score"))
    )
    full = full.filter(~F.col("excluded") | F.col("distance").isNotNull())
    full = max_normalize(full, "bm25_score", "bm25_norm")
    return max_normalize(full, "embed_score", "embed_norm")


def fuse(hits: DataFrame, alpha: float = dims.ALPHA) -> DataFrame:
    score = alpha * F.col("bm25_norm") + (1 - alpha) * F.col("embed_norm")
    return hits.withColumn("hybrid_score", F.round(score, DIGITS))


def adjust(hits: DataFrame, as_of: str) -> DataFrame:
    """Category exclusion, priority boost and freshness factor after the fusion."""
    kept = hits.filter(~F.col("excluded"))
    factor = boost(F.col("priority"))
    fresh = freshness(F.col("category"), F.col("scraped_at"), F.col("current"), as_of)
    return kept.withColumn("hybrid_score", F.round(F.col("hybrid_score") * factor * fresh, DIGITS))


def hybrid_topk(
    chunks: DataFrame,
    queries: DataFrame,
    as_of: str,
    n_results: int = 8,
    alpha: float = dims.ALPHA,
    **pools,
) -> DataFrame:
    hits = adjust(fuse(candidates(chunks, queries, **pools), alpha), as_of)
    return top_per_query(hits, n_results, "hybrid_score")


def rerank(
    hits: DataFrame,
    top_k: int = 3,
    threshold: float = dims.RERANK_THRESHOLD,
    as_of: str | None = None,
    already_adjusted: bool = False,
) -> DataFrame:
    """Second scoring. Base: hybrid score, else score, else 1 - distance, else .5 for a keyword hit.

    Boost and freshness apply again by default; freshness needs ``as_of`` and a boolean column
    ``rerank_current``.
    """

    def have(name: str, expr: Column) -> list[Column]:
        return [expr] if name in hits.columns else []

    base = F.coalesce(
        *have("hybrid_score", F.col("hybrid_score")),
        *have("score", F.col("score")),
        *have(
            "distance",
            F.when(F.col("distance").isNotNull(), F.greatest(F.lit(0.0), 1.0 - F.col("distance"))),
        ),
        *have("bm25_score", F.when(F.col("bm25_score") > 0, 0.5)),
        F.lit(0.0),
    )
    if already_adjusted:
        score = base
    else:
        score = base * boost(F.col("priority"))
        if as_of is not None and "rerank_current" in hits.columns:
            args = F.col("category"), F.col("scraped_at"), F.col("rerank_current")
            score = score * freshness(*args, as_of)
    scored = hits.withColumn("score", F.round(score, DIGITS)).filter(F.col("score") >= threshold)
    return top_per_query(scored.drop("rank"), top_k)


def budgeted(text: str = "text", max_chars: int = dims.CONTEXT_CHARS) -> Column:
    """The part of a text by which ``context_budget`` decides: one that is longer than the budget never fits, by however much,
    and is cut at the budget. So the rest of it need not be moved to the queries."""
    return F.left(F.col(text), F.lit(max_chars + 1))


def context_budget(hits: DataFrame, max_chars: int = dims.CONTEXT_CHARS) -> DataFrame:
    """Documents by score until the budget is full; the first that overflows is cut if enough is left.

    ``hits`` has (query_id, chunk_id, score, document).
    """
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    size = F.length("document")
    run = hits.withColumn("_pos", F.row_number().over(w)).withColumn(
        "_before", F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    left = (max_chars - F.col("_before")).cast("int")
    fits = size <= left
    cut = ~fits & (left > dims.CONTEXT_TAIL)
    kept = run.filter((F.col("_pos") <= dims.CONTEXT_CHUNKS) & (left >= 0) & (fits | cut))
    text = F.when(fits, F.col("document")).otherwise(
        F.concat(F.substring(F.col("document"), F.lit(1), left), F.lit("…"))
    )
    return kept.withColumn("document", text).withColumn("rank", F.col("_pos")).drop("_pos", "_before")


def attribute_sources(hits: DataFrame, answers: DataFrame, floor: float = 0.3) -> DataFrame:
    """Answers with their citation line: hits above the floor, first per document and page.

    ``hits`` has (query_id, rank, score, doc_name, page), ``answers`` (query_id, answer).
    """
    strong = hits.filter(F.col("score") >= floor).withColumn(
        "doc_name", F.coalesce("doc_name", F.lit("Unknown"))
    )
    first = strong.groupBy("query_id", "doc_name", "page").agg(
        F.min("rank").alias("rank"), F.max_by("score", -F.col("rank")).alias("score")
    )
    source = F.struct(
        "rank", F.col("doc_name").alias("document"), "page",
        F.round("score", 2).alias("relevance"),
    )
    lists = first.groupBy("query_id").agg(F.sort_array(F.collect_list(source)).alias("sources"))
    joined = answers.join(lists, "query_id", "left")
    arabic = X.is_arabic(F.col("answer"))
    mark = F.when(arabic, " (ص. ").otherwise(" (p. ")
    names = F.transform(
        "sources",
        lambda s: F.concat(
            s["document"],
            F.when(s["page"].isNotNull(), F.concat(mark, s["page"].cast("string"), F.lit(")"))).otherwise(""),
        ),
    )
    head = F.when(arabic, "\n\n---\n*المصادر:* ").otherwise("\n\n---\n*Sources:* ")
    line = F.concat(head, F.array_join(names, " • "))
    return joined.withColumn("answer", F.concat("answer", F.coalesce(line, F.lit(""))))


def answer_confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Mean score and number of used hits per query; queries without hits get 0 and a fixed text."""
    used = hits.groupBy("query_id").agg(
        F.round(F.avg("score"), 3).alias("confidence"), F.count("*").alias("context_used")
    )
    none = F.when(X.is_arabic(F.col("text")), dims.NO_CONTEXT_AR).otherwise(dims.NO_CONTEXT_EN)
    out = queries.join(used, "query_id", "left")
    return out.select(
        "query_id",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("context_used", F.lit(0)).alias("context_used"),
        F.when(F.col("context_used").isNull(), none).alias("fixed_answer"),
    )


def prompt_dataset(queries: DataFrame, hits: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Grounded prompt per query: numbered context, earlier turns, the question.

    ``hits`` has (query_id, rank, chunk_id, page, document); ``history`` has
    (query_id, history array<struct<role, content>>).
    """
    row = F.struct("rank", F.col("chunk_id").cast("string").alias("id"), "page", "document")
    ctx = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("ctx"))
    q = queries.join(ctx, "query_id", "left")
    if history is not None:
        q = q.join(history, "query_id", "left")
    else:
        q = q.withColumn("history", F.lit(None).cast("array<struct<role:string,content:string>>"))
    arabic = X.is_arabic(F.col("text"))

    def word(ar: str, en: str) -> Column:
        return F.when(arabic, ar).otherwise(en)

    blocks = F.transform(
        "ctx",
        lambda c, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit(" — "), F.left(c["id"], F.lit(8)), F.lit(", p."),
            F.coalesce(c["page"].cast("string"), F.lit("?")), F.lit("]\n"), c["document"],
        ),
    )
    context = F.coalesce(
        F.array_join(blocks, "\n\n"), word("لا يوجد سياق متاح.", "No context available.")
    )
    spoken = F.filter("history", lambda t: X.strip(F.coalesce(t["content"], F.lit(""))) != "")
    lines = F.array_join(
        F.transform(
            spoken,
            lambda t: F.concat(
                F.when(t["role"] == "user", word("الطالب", "Student")).otherwise(
                    word("المساعد", "Assistant")
                ),
                F.lit(": "),
                X.strip(t["content"]),
            ),
        ),
        "\n",
    )
    past = F.when(
        F.coalesce(lines, F.lit("")) != "",
        F.concat(F.lit("\n### "), word("سجل المحادثة السابق", "Previous conversation"), F.lit("\n"), lines, F.lit("\n")),
    ).otherwise("")
    prompt = F.concat(
        F.lit("### "), word("السياق", "Context"), F.lit("\n"), context, F.lit("\n"), past,
        F.lit("\n### "), word("السؤال", "Question"), F.lit("\n"), F.col("text"),
    )
    return q.select("query_id", prompt.alias("prompt"))


def response_screen(text: Column, has_context: Column) -> Column:
    """Struct (refusal, minimal, text): refusal phrases in short replies, tiny replies, length rule."""
    low = F.lower(text)

    def has_any(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    phrase = F.when(X.is_arabic(text), has_any(dims.REFUSAL_AR)).otherwise(has_any(dims.REFUSAL_EN))
    refusal = (F.length(text) <= 150) & phrase
    minimal = has_context & (F.length(X.strip(text)) < 20)
    head = F.substring(text, 1, 2000)
    # position of the last full stop of the head, 0 when it has none
    dot = F.length(head) - F.length(F.substring_index(head, ".", -1))
    cut = F.when(dot > 1501, F.substring(head, F.lit(1), dot)).otherwise(F.concat(head, F.lit("…")))
    return F.struct(
        refusal.alias("refusal"),
        minimal.alias("minimal"),
        F.when(F.length(text) > 2000, cut).otherwise(text).alias("text"),
    )


def retrieval_answers(
    chunks: DataFrame,
    queries: DataFrame,
    as_of: str,
    top_k: int = 10,
    rerank_k: int = 5,
    threshold: float = dims.RERANK_THRESHOLD,
    hybrid: bool = True,
    doc_filter: Column | None = None,
) -> DataFrame:
    """Ranked, budgeted context rows per query (query_id, chunk_id, score, rank, document, ...).

    Vector-only retrieval honours ``doc_filter``; fused retrieval ignores it, as the service does.
    """
    if hybrid:
        hits = hybrid_topk(chunks, queries, as_of, top_k)
    else:
        vectors = chunks if doc_filter is None else chunks.filter(doc_filter)
        vectors = vectors.select(
            "chunk_id", hash_vector(X.search_terms(F.col("text"))).alias("embedding")
        )
        asks = queries.select("query_id", hash_vector(X.search_terms(F.col("text"))).alias("embedding"))
        near = S.vector_topk(vectors, asks, top_k)
        hits = with_chunk_columns(near, chunks, ["category", "priority"])
    best = rerank(hits, rerank_k, threshold)
    docs = with_chunk_columns(
        best.select("query_id", "chunk_id", "score"), chunks,
        [budgeted().alias("document"), "doc_name", "page"],
    )
    return context_budget(docs)

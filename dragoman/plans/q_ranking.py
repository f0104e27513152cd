"""Fusion, ranking and answer preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.functions import text as X
from dragoman.operators import dialogue as D
from dragoman.operators import ranking as R
from dragoman.plans import views as V
from dragoman.plans.q_filters import ANY_AR
from dragoman.plans.q_search import BM25_SQL, TERMS, queries
from dragoman.plans.q_text import AR_LETTERS, TOK, sql_normalize_arabic, sql_stem  # noqa: F401
from dragoman.plans.registry import query
from dragoman.session import scratch_dir
from dragoman.sources.store import create_store

CURRENT_RE = r"(?i)\b(" + "|".join(dims.CURRENT_STATE_EN) + r")\b|" + "|".join(dims.CURRENT_STATE_AR)
RERANK_RE = r"(?i)\b(" + "|".join(dims.RERANK_STATE_EN) + r")\b|" + "|".join(dims.RERANK_STATE_AR)
BOOST_SQL = "CASE priority WHEN 'high' THEN 1.3::DOUBLE WHEN 'low' THEN 0.6::DOUBLE ELSE 1::DOUBLE END"


def fresh_sql(flag: str) -> str:
    return (
        f"CASE WHEN {flag} AND category = 'news_events' AND (scraped_at = '' OR "
        f"coalesce(try_cast(scraped_at AS TIMESTAMP) < TIMESTAMP '{V.AS_OF}' - INTERVAL 365 DAY, FALSE)) THEN 0.25::DOUBLE ELSE 1::DOUBLE END"
    )


def hybrid_sql(excluded: list[str]) -> str:
    """Common table expressions up to ``adj``: adjusted fused scores of the whole pools."""
    news = "(current AND category = 'news_events')"
    rule = f"(category IN {V.sql_in(excluded)} OR {news})" if excluded else news
    return f"""{BM25_SQL}, {V.RECORDS},
 dv AS (SELECT doc_id, dim, sum(tf)::DOUBLE AS c FROM (SELECT doc_id, ('0x' || md5(term)[1:4])::INT % 64 AS dim, tf FROM dtf) GROUP BY ALL),
 dn AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM dv GROUP BY doc_id),
 qv AS (SELECT query_id, dim, sum(qtf)::DOUBLE AS c FROM (SELECT query_id, ('0x' || md5(term)[1:4])::INT % 64 AS dim, qtf FROM qtf) GROUP BY ALL),
 qn AS (SELECT query_id, sqrt(sum(c * c)) AS norm FROM qv GROUP BY query_id),
 dots AS (SELECT query_id, doc_id, sum(qv.c * dv.c) AS dot FROM qv JOIN dv USING (dim) GROUP BY ALL),
 near AS (SELECT q.query_id, d.doc_id AS chunk_id, round(1 - round(coalesce(dot, 0) / q.norm / d.norm, 9), 9) AS distance
   FROM qn q CROSS JOIN dn d LEFT JOIN dots x ON x.query_id = q.query_id AND x.doc_id = d.doc_id),
 neark AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM near) WHERE rank <= 25),
 merged AS (SELECT coalesce(b.query_id, n.query_id) AS query_id, coalesce(b.chunk_id, n.chunk_id) AS chunk_id,
   coalesce(bm25_score, 0) AS bm25_score, CASE WHEN distance IS NULL THEN 0 ELSE greatest(0, least(1 - distance, 1)) END AS embed_score, distance
   FROM bmk b FULL OUTER JOIN neark n ON b.query_id = n.query_id AND b.chunk_id = n.chunk_id),
 flags AS (SELECT query_id, regexp_matches(text, '{CURRENT_RE}') AS current, regexp_matches(text, '{RERANK_RE}') AS rerank_current FROM queries),
 meta AS (SELECT m.*, r.category, r.priority, r.scraped_at, r.doc_name, f.current, f.rerank_current FROM merged m
   JOIN records r ON r.doc_id = m.chunk_id JOIN flags f USING (query_id)),
 pool0 AS (SELECT * REPLACE (CASE WHEN excluded THEN 0 ELSE bm25_score END AS bm25_score) FROM (SELECT *, {rule} AS excluded FROM meta)
   WHERE NOT excluded OR distance IS NOT NULL),
 pool AS (SELECT *, CASE WHEN bmax <= 0 THEN 0 ELSE bm25_score / bmax END AS bm25_norm, CASE WHEN emax <= 0 THEN 0 ELSE embed_score / emax END AS embed_norm
   FROM (SELECT *, max(bm25_score) OVER (PARTITION BY query_id) AS bmax, max(embed_score) OVER (PARTITION BY query_id) AS emax FROM pool0)),
 fused AS (SELECT *, round(0.6::DOUBLE * bm25_norm + 0.4::DOUBLE * embed_norm, 9) AS fused_score FROM pool),
 adj AS (SELECT *, round(fused_score * {BOOST_SQL} * {fresh_sql('current')}, 9) AS hybrid_score FROM fused WHERE NOT excluded),
 hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, chunk_id) AS rank FROM adj))"""


HYBRID = hybrid_sql(dims.EXCLUDED_CATEGORIES)
OPEN = hybrid_sql([])


def reranked_sql(pool: int, keep: int, fresh: str) -> str:
    return f"""{HYBRID},
 rr0 AS (SELECT * EXCLUDE (rank), round(hybrid_score * {BOOST_SQL}{fresh}, 9) AS score FROM hyb WHERE rank <= {pool}),
 rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rr0 WHERE score >= 0.25) WHERE rank <= {keep})"""


BUDGET = f"""{reranked_sql(10, 5, '')},
 cb0 AS (SELECT r.query_id, r.chunk_id, r.score, r.rank, r.doc_name, nullif(r.chunk_id % 7, 0) AS page, d.text, length(d.text) AS len,
   coalesce(sum(length(d.text)) OVER (PARTITION BY r.query_id ORDER BY r.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
   FROM rr r JOIN documents d ON d.doc_id = r.chunk_id),
 cb AS (SELECT query_id, chunk_id, score, rank, doc_name, page, CASE WHEN len <= 4000 - before THEN text ELSE text[1:4000 - before] || '…' END AS document
   FROM cb0 WHERE rank <= 8 AND before <= 4000 AND (len <= 4000 - before OR 4000 - before > 200))"""


def chunks(spark, sf):
    r = V.records(spark, sf)
    return r.withColumnRenamed("doc_id", "chunk_id").withColumn(
        "page", F.nullif(F.col("chunk_id") % 7, F.lit(0))
    )


def context(spark, sf):
    return R.retrieval_answers(chunks(spark, sf), queries(spark, sf), V.AS_OF)


# ---------------------------------------------------------------- query text

ENTITY_VALUES = ["Computer Science", "CS401", "Spring 2025!", "الفصل الثاني", "CS401"]


@query(
    "enrich_query",
    "WITH q AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'), "
    "e AS (SELECT query_id, i % 3 AS type_order, i AS start, "
    + V.sql_pick(ENTITY_VALUES, "(query_id + i) % 5")
    + " AS value FROM q, range(3) t(i) WHERE query_id % 4 <> 3), "
    rf"n AS (SELECT query_id, trim(regexp_replace(regexp_replace(lower({sql_normalize_arabic('value')}), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '\s+', ' ', 'g')) AS norm, type_order, start FROM e), "
    "f AS (SELECT query_id, norm, min((type_order, start)) AS place FROM n WHERE norm <> '' GROUP BY ALL), "
    "x AS (SELECT query_id, string_agg(norm, ' ' ORDER BY place, norm) AS extra FROM f GROUP BY query_id) "
    "SELECT q.query_id, md5(concat_ws(' ', q.text, extra)) AS digest, length(extra)::BIGINT AS added FROM q LEFT JOIN x USING (query_id)",
)
def enrich_query(spark, sf):
    q = V.table(spark, sf, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"
    )
    e = q.filter(F.col("query_id") % 4 != 3).select(
        "query_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("start")
    )
    e = e.withColumn("type_order", F.col("start") % 3).withColumn(
        "value", V.pick(ENTITY_VALUES, (F.col("query_id") + F.col("start")) % 5)
    )
    out = R.enrich_query(q.withColumn("size", F.length("text")), e)
    added = F.length("text") - F.col("size") - 1
    return out.select(
        "query_id", F.md5(F.col("text").cast("binary")).alias("digest"),
        F.when(added >= 0, added).cast("long").alias("added"),
    )


@query(
    "expand_query",
    f"WITH {V.BILINGUAL}, s AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '{ANY_AR}') THEN "
    f"array_to_string(list_transform(regexp_extract_all({sql_normalize_arabic('text')}, '{TOK}'), lambda t: {sql_stem('t')}), ' ') "
    "ELSE trim(text) END AS stem FROM corpus) "
    "SELECT doc_id, md5(CASE WHEN stem <> '' AND stem <> text THEN text || ' ' || stem ELSE text END) AS digest FROM s",
)
def expand_query(spark, sf):
    d = V.bilingual(spark, sf)
    return d.select("doc_id", F.md5(R.expand_query(F.col("text")).cast("binary")).alias("digest"))


# ---------------------------------------------------------------- fusion


@query(
    "merge_candidates",
    f"WITH {OPEN} SELECT query_id, chunk_id, round(bm25_score, 6) AS bm25_score, round(embed_score, 6) AS embed_score, round(distance, 6) AS distance FROM merged",
)
def merge_candidates(spark, sf):
    from dragoman.functions.arrow import hash_vector
    from dragoman.operators import search as S

    c, q = chunks(spark, sf), queries(spark, sf)
    vec = hash_vector(X.search_terms(F.col("text"))).alias("embedding")
    near = S.vector_topk(c.select("chunk_id", vec), q.select("query_id", vec), 25)
    m = R.merge_candidates(S.bm25_topk(c, q), near)
    return m.select("query_id", "chunk_id", *[F.round(x, 6).alias(x) for x in m.columns[2:]])


@query(
    "search_store",
    f"WITH {OPEN} SELECT query_id, chunk_id, round(bm25_score, 6) AS bm25_score, round(embed_score, 6) AS embed_score, round(distance, 6) AS distance FROM merged",
)
def search_store(spark, sf):
    """Chunks stored in two commits and compacted, then searched from the stored index and vectors."""
    c = chunks(spark, sf)
    store = create_store(c.filter("chunk_id % 3 <> 0"), scratch_dir(spark, "store"))
    m = store.upsert(c.filter("chunk_id % 3 < 2")).compact().refresh().search(queries(spark, sf))
    return m.select("query_id", "chunk_id", *[F.round(x, 6).alias(x) for x in m.columns[2:]])


@query(
    "max_normalize",
    f"WITH {HYBRID} SELECT query_id, chunk_id, round(bm25_norm, 6) AS bm25_norm, round(embed_norm, 6) AS embed_norm FROM pool",
)
def max_normalize(spark, sf):
    p = R.candidates(chunks(spark, sf), queries(spark, sf))
    return p.select("query_id", "chunk_id", F.round("bm25_norm", 6).alias("bm25_norm"), F.round("embed_norm", 6).alias("embed_norm"))


@query(
    "hybrid_topk",
    f"WITH {HYBRID} SELECT query_id, chunk_id, round(bm25_score, 6) AS bm25_score, round(embed_score, 6) AS embed_score, "
    "round(hybrid_score, 6) AS hybrid_score, rank FROM hyb WHERE rank <= 8",
)
def hybrid_topk(spark, sf):
    h = R.hybrid_topk(chunks(spark, sf), queries(spark, sf), V.AS_OF)
    scores = ["bm25_score", "embed_score", "hybrid_score"]
    return h.select("query_id", "chunk_id", *[F.round(s, 6).alias(s) for s in scores], "rank")


@query(
    "category_exclusion",
    f"WITH {HYBRID} SELECT query_id, category, excluded, count(*) AS n FROM pool GROUP BY ALL",
)
def category_exclusion(spark, sf):
    p = R.candidates(chunks(spark, sf), queries(spark, sf))
    return p.groupBy("query_id", "category", "excluded").agg(F.count("*").alias("n"))


@query(
    "priority_boost",
    f"WITH {HYBRID} SELECT query_id, chunk_id, priority, round(fused_score * {BOOST_SQL}, 6) AS boosted FROM fused",
)
def priority_boost(spark, sf):
    f = R.fuse(R.candidates(chunks(spark, sf), queries(spark, sf)))
    boosted = F.round(F.col("hybrid_score") * R.boost(F.col("priority")), 6)
    return f.select("query_id", "chunk_id", "priority", boosted.alias("boosted"))


@query(
    "freshness_penalty",
    f"WITH {V.RECORDS}, r AS (SELECT doc_id, category, scraped_at, doc_id % 2 = 0 AS current FROM records) "
    f"SELECT doc_id, category, {fresh_sql('current')} AS factor FROM r",
)
def freshness_penalty(spark, sf):
    r = V.records(spark, sf).withColumn("current", F.col("doc_id") % 2 == 0)
    factor = R.freshness(F.col("category"), F.col("scraped_at"), F.col("current"), V.AS_OF)
    return r.select("doc_id", "category", factor.alias("factor"))


@query(
    "rerank",
    f"WITH {reranked_sql(10, 3, ' * ' + fresh_sql('rerank_current'))} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM rr",
)
def rerank(spark, sf):
    q = queries(spark, sf)
    flags = q.select("query_id", X.is_current_state(F.col("text"), for_rerank=True).alias("rerank_current"))
    hits = R.hybrid_topk(chunks(spark, sf), q, V.AS_OF, 10).join(flags, "query_id")
    top = R.rerank(hits, as_of=V.AS_OF)
    return top.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    "context_budget",
    f"WITH {BUDGET} SELECT query_id, chunk_id, rank, length(document) AS n_chars, md5(document) AS digest FROM cb",
)
def context_budget(spark, sf):
    c = context(spark, sf)
    return c.select("query_id", "chunk_id", "rank", F.length("document").cast("long").alias("n_chars"),
                    F.md5(F.col("document").cast("binary")).alias("digest"))


SOURCES_SQL = f"""{BUDGET},
 ans AS (SELECT query_id, text AS answer FROM queries),
 src AS (SELECT query_id, doc_name, page, min(rank) AS rank, arg_min(score, rank) AS score FROM cb WHERE score >= 0.3 GROUP BY ALL),
 srcs AS (SELECT query_id, count(*) AS n_sources, round(sum(round(score, 2)), 2) AS relevance,
   string_agg(doc_name || CASE WHEN page IS NOT NULL THEN ' (p. ' || page || ')' ELSE '' END, ' • ' ORDER BY rank) AS names FROM src GROUP BY query_id),
 attributed AS (SELECT query_id, coalesce(n_sources, 0) AS n_sources, coalesce(relevance, 0) AS relevance,
   answer || coalesce(chr(10) || chr(10) || '---' || chr(10) || '*Sources:* ' || names, '') AS answer FROM ans LEFT JOIN srcs USING (query_id))"""


@query("attribute_sources", f"WITH {SOURCES_SQL} SELECT * FROM attributed")
def attribute_sources(spark, sf):
    return attributed(context(spark, sf), queries(spark, sf))


def attributed(ctx, q):
    answers = q.select("query_id", F.col("text").alias("answer"))
    a = R.attribute_sources(ctx, answers)
    total = F.aggregate("sources", F.lit(0.0), lambda acc, s: acc + s["relevance"])
    return a.select(
        "query_id",
        F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("n_sources"),
        F.coalesce(F.round(total, 2), F.lit(0.0)).alias("relevance"),
        "answer",
    )


CONF = """conf AS (SELECT q.query_id, coalesce(round(avg(score), 3), 0) AS confidence, count(score) AS context_used,
   CASE WHEN count(score) = 0 THEN 'none' END AS no_context FROM queries q LEFT JOIN cb USING (query_id) GROUP BY q.query_id)"""


@query("answer_confidence", f"WITH {BUDGET}, {CONF} SELECT * FROM conf")
def answer_confidence(spark, sf):
    a = R.answer_confidence(queries(spark, sf), context(spark, sf))
    return a.withColumn("no_context", F.when(F.col("fixed_answer").isNotNull(), "none")).drop("fixed_answer")


HISTORY = f"""{V.TURNS}, recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM turns) WHERE back <= 6 AND role <> 'system'),
 hist AS (SELECT session_id AS query_id, string_agg(CASE WHEN role = 'user' THEN 'Student' ELSE 'Assistant' END || ': ' || trim(content), chr(10) ORDER BY seq) AS hist FROM recent GROUP BY 1)"""


@query(
    "prompt_dataset",
    f"WITH {BUDGET}, {HISTORY}, ctx AS (SELECT query_id, string_agg('[' || n || ' — ' || (chunk_id::VARCHAR)[1:8] || ', p.' || coalesce(page::VARCHAR, '?') || ']' || chr(10) || document, chr(10) || chr(10) ORDER BY n) AS ctx "
    "FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM cb) GROUP BY query_id), "
    "p AS (SELECT q.query_id, '### Context' || chr(10) || coalesce(ctx, 'No context available.') || chr(10) || "
    "CASE WHEN hist IS NULL THEN '' ELSE chr(10) || '### Previous conversation' || chr(10) || hist || chr(10) END || chr(10) || '### Question' || chr(10) || q.text AS prompt "
    "FROM queries q LEFT JOIN ctx USING (query_id) LEFT JOIN hist USING (query_id)) SELECT query_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM p",
)
def prompt_dataset(spark, sf):
    recent = D.recent_turns(V.turns(spark, sf), 6).filter("role <> 'system'")
    turn = F.struct("seq", "role", "content")
    history = recent.groupBy(F.col("session_id").alias("query_id")).agg(
        F.transform(
            F.sort_array(F.collect_list(turn)),
            lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")),
        ).alias("history")
    )
    p = R.prompt_dataset(queries(spark, sf), context(spark, sf), history)
    return p.select("query_id", F.length("prompt").cast("long").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("digest"))


REPLIES = """r AS (
  SELECT conv_id, turn, 'whole' AS kind, text AS t FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 'twice', text || ' ' || text FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0
  UNION ALL SELECT conv_id, turn, 'refusing', 'I cannot say. ' || text[1:60] FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 7 = 0
  UNION ALL SELECT conv_id, turn, 'short', text[1:12] FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 11 = 0)"""


@query(
    "response_screen",
    f"WITH {REPLIES}, "
    "s AS (SELECT *, length(t) <= 150 AND (" + " OR ".join(f"contains(lower(t), '{w.replace(chr(39), chr(39) * 2)}')" for w in dims.REFUSAL_EN)
    + ") AS refusal, length(trim(t)) < 20 AS minimal, length(regexp_extract(t[1:2000], '(?s)^(.*[.])', 1)) AS dot FROM r) "
    "SELECT conv_id, turn, kind, refusal, minimal, md5(CASE WHEN length(t) <= 2000 THEN t WHEN dot > 1501 THEN t[1:dot] ELSE t[1:2000] || '…' END) AS digest FROM s",
)
def response_screen(spark, sf):
    """All replies as they are, and beside them long, refusing and short ones made from some."""
    c = V.table(spark, sf, "conversations").filter("role = 'assistant'")
    n = F.col("conv_id") + F.col("turn")
    made = F.array(
        F.struct(F.lit("whole").alias("kind"), F.col("text").alias("t")),
        F.when(n % 3 == 0, F.struct(F.lit("twice").alias("kind"), F.concat("text", F.lit(" "), "text").alias("t"))),
        F.when(n % 7 == 0, F.struct(F.lit("refusing").alias("kind"), F.concat(F.lit("I cannot say. "), F.substring("text", 1, 60)).alias("t"))),
        F.when(n % 11 == 0, F.struct(F.lit("short").alias("kind"), F.substring("text", 1, 12).alias("t"))),
    )
    r = c.select("conv_id", "turn", F.explode_outer(made).alias("r")).filter("r IS NOT NULL").select("conv_id", "turn", "r.kind", "r.t")
    s = r.withColumn("s", R.response_screen(F.col("t"), F.lit(True)))
    return s.select("conv_id", "turn", "kind", "s.refusal", "s.minimal", F.md5(F.col("s.text").cast("binary")).alias("digest"))


ANSWERS_SQL = f"WITH {SOURCES_SQL}, {CONF} SELECT query_id, answer, n_sources, confidence, context_used FROM attributed JOIN conf USING (query_id)"


@query("retrieval_pipeline", ANSWERS_SQL)
@query("retrieval_answers", ANSWERS_SQL)
def retrieval_answers(spark, sf):
    q = queries(spark, sf)
    ctx = context(spark, sf)
    conf = R.answer_confidence(q, ctx).drop("fixed_answer")
    return attributed(ctx, q).drop("relevance").join(conf, "query_id")

"""Projections, filters and predicates over records, chunks, messages and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.functions import text as X
from dragoman.operators import corpus as C
from dragoman.plans import views as V
from dragoman.plans.registry import query


def sql_count(col: str, cls: str) -> str:
    return f"len(regexp_extract_all({col}, '{cls}'))"


AR = r"[\x{0600}-\x{06FF}]"
PF = r"[\x{FE70}-\x{FEFF}]"
ANY_AR = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
REVERSED_SQL = (
    f"CASE WHEN {sql_count('text', AR)} = 0 THEN FALSE ELSE "
    f"{sql_count('text', PF)}::DOUBLE / {sql_count('text', AR)} > 0.30 END"
)
QUALITY_SQL = r"(length(trim(text)) >= {0} AND len(regexp_extract_all(trim(text), '\p{{L}}'))::DOUBLE / greatest(length(trim(text)), 1) >= {1})"
STRICT_SQL = QUALITY_SQL.format(100, 0.40)


@query(
    "ingest_filter",
    f"WITH {V.RECORDS} SELECT doc_id, lang, category, source FROM records "
    "WHERE lang IN ('unknown', 'en') AND category = 'academics' AND source <> 'pdf_scanned'",
)
def ingest_filter(spark, sf):
    out = C.ingest_filter(V.records(spark, sf), lang="en", category="academics", skip_scanned=True)
    return out.select("doc_id", "lang", "category", "source")


@query(
    "quality_gate_strict",
    f"WITH {V.LINES} SELECT doc_id, pos::INT AS pos, length(trim(text)) AS n_chars FROM lines WHERE {STRICT_SQL}",
)
def quality_gate_strict(spark, sf):
    out = V.lines(spark, sf).filter(C.strict_quality(F.col("text")))
    return out.select("doc_id", "pos", F.length(X.strip(F.col("text"))).cast("long").alias("n_chars"))


@query(
    "quality_gate_lenient",
    f"WITH {V.BILINGUAL}, sized AS (SELECT *, length(text) AS doc_chars FROM corpus), "
    "lines AS (SELECT doc_id, doc_chars, unnest(string_split(text, chr(10))) AS text FROM sized) "
    "SELECT doc_id, count(*) AS kept, sum(length(trim(text)))::BIGINT AS n_chars FROM lines "
    f"WHERE NOT ({REVERSED_SQL}) AND "
    + QUALITY_SQL.format("(CASE WHEN doc_chars < 500 THEN 20 ELSE 40 END)", 0.25)
    + " GROUP BY doc_id",
)
def quality_gate_lenient(spark, sf):
    d = V.bilingual(spark, sf).withColumn("floor", C.lenient_floor(F.length("text")))
    chunks = d.select("doc_id", "floor", F.explode(F.split("text", "\\n")).alias("text"))
    good = chunks.filter(C.lenient_quality(F.col("text"), F.col("floor")))
    return good.groupBy("doc_id").agg(
        F.count("*").alias("kept"), F.sum(F.length(X.strip(F.col("text")))).alias("n_chars")
    )


@query(
    "quality_report",
    f"WITH {V.LINES} SELECT r.doc_id, coalesce(count_if({STRICT_SQL.replace('text', 'l.text')}), 0)::BIGINT AS kept, "
    f"coalesce(count_if(NOT {STRICT_SQL.replace('text', 'l.text')}), 0)::BIGINT AS dropped, "
    "CASE WHEN count(l.text) = 0 THEN 'empty' "
    f"WHEN count_if({STRICT_SQL.replace('text', 'l.text')}) = 0 THEN 'no_quality_chunks' ELSE 'ok' END AS status "
    "FROM records r LEFT JOIN lines l USING (doc_id) GROUP BY r.doc_id",
)
def quality_report(spark, sf):
    # outer explode keeps documents without any chunk, so no join is needed
    parts = F.filter(F.split("text", "\\n"), lambda x: F.trim(x) != "")
    chunks = V.records(spark, sf).select("doc_id", F.explode_outer(parts).alias("text"))
    return C.quality_report(chunks, C.strict_quality(F.col("text")))


NAME_WORDS = [
    "admission-fees", "course-catalog", "thesis", "club", "board", "library", "vacancies",
    "history", "guide", "misc",
]


def rules_sql(rules, haystack, default):
    arms = []
    for label, words in rules:
        test = " OR ".join(f"contains({haystack}, '{w}')" for w in words)
        arms.append(f"WHEN {test} THEN '{label}'")
    return "CASE " + " ".join(arms) + f" ELSE '{default}' END"


@query(
    "assign_category",
    "WITH h AS (SELECT doc_id, lower('doc' || doc_id || '-' || "
    + V.sql_pick(NAME_WORDS, "doc_id % 10")
    + " || ' ' || text[1:300]) AS hay FROM documents) SELECT doc_id, "
    + rules_sql(dims.CATEGORY_RULES, "hay", "general")
    + " AS category FROM h",
)
def assign_category(spark, sf):
    d = V.table(spark, sf, "documents")
    name = F.concat(F.lit("doc"), "doc_id", F.lit("-"), V.pick(NAME_WORDS, F.col("doc_id") % 10))
    return d.select("doc_id", C.assign_category(name, F.col("text")).alias("category"))


PAGE_WORDS = [
    "Faculty list", "Tuition", "Journal", "Housing club", "Senate", "Library", "Vision", "Other",
]


def page_records(spark, sf):
    p = V.table(spark, sf, "pages")
    title = F.concat(
        F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" "),
        V.pick(PAGE_WORDS, F.col("page_id") % 8),
    )
    return p.select(
        "page_id", "url", title.alias("title"),
        F.concat(F.lit("page"), "page_id", F.lit(".pdf")).alias("doc_name"),
        F.when(F.col("page_id") % 3 == 0, "general").otherwise("documents").alias("category"),
        V.pick(V.SOURCES, F.col("page_id") % len(V.SOURCES)).alias("source"),
    )


PAGES = (
    "page_records AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || "
    + V.sql_pick(PAGE_WORDS, "page_id % 8")
    + " AS title, 'page' || page_id || '.pdf' AS doc_name, "
    "CASE WHEN page_id % 3 = 0 THEN 'general' ELSE 'documents' END AS category, "
    + V.sql_pick(V.SOURCES, f"page_id % {len(V.SOURCES)}")
    + " AS source FROM pages)"
)


@query(
    "recategorize",
    f"WITH {PAGES}, m AS (SELECT CASE WHEN category = 'documents' THEN "
    + rules_sql(dims.RELABEL_RULES, "lower(url || ' ' || title)", "documents")
    + " ELSE category END AS category FROM page_records) "
    "SELECT category, count(*) AS n FROM m GROUP BY category",
)
def recategorize(spark, sf):
    out = C.recategorize(page_records(spark, sf))
    return out.groupBy("category").agg(F.count("*").alias("n"))


@query(
    "priority_tier",
    "WITH c AS (SELECT vec_id, "
    + V.sql_pick(V.CATEGORIES, "label % 14")
    + f" AS category FROM embeddings) SELECT vec_id, category, {V.PRIORITY_SQL} AS priority FROM c",
)
def priority_tier(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", V.category_of(F.col("label")).alias("category"))
    return e.withColumn("priority", C.priority_tier(F.col("category")))


@query(
    "chunk_metadata",
    f"WITH {V.RECORDS}, parts AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS p FROM records) "
    "SELECT doc_name, i::INT AS chunk_index, len(p)::INT AS total_chunks, p[1][1:200] AS title, "
    "array_to_string(list_transform(p, lambda x: x[1:40]), ' | ')[1:400] AS headings, lang, category, priority, source, "
    "source = 'pdf_scanned' AS is_scanned, length(text) < 500 AS is_short_doc, length(p[i + 1]) AS n_chars "
    "FROM (SELECT *, unnest(range(len(p))) AS i FROM parts)",
)
def chunk_metadata(spark, sf):
    # a document is one row, so its chunk count is the size of an array and needs no window
    r = V.records(spark, sf).withColumn(
        "p", F.filter(F.split("text", "\\n"), lambda x: F.trim(x) != "")
    )
    heads = F.array_join(F.transform("p", lambda x: F.substring(x, 1, 40)), " | ")
    meta = r.select(
        "doc_name", "lang", "category", "priority", "source",
        F.size("p").alias("total_chunks"),
        F.substring(F.get("p", 0), 1, 200).alias("title"),
        F.substring(heads, 1, 400).alias("headings"),
        (F.col("source") == "pdf_scanned").alias("is_scanned"),
        (F.length("text") < dims.SHORT_DOC).alias("is_short_doc"),
        "p",
    )
    meta = meta.select("*", F.posexplode("p").alias("chunk_index", "chunk")).drop("p")
    return meta.withColumn("n_chars", F.length("chunk").cast("long")).drop("chunk")


@query(
    "script_profile",
    f"WITH {V.BILINGUAL} SELECT doc_id, {sql_count('text', AR)}::INT AS n_arabic, {sql_count('text', PF)}::INT AS n_forms, "
    f"{sql_count('text', '[a-zA-Z]')}::INT AS n_latin, {REVERSED_SQL} AS reversed FROM corpus",
)
def script_profile(spark, sf):
    t = F.col("text")
    return V.bilingual(spark, sf).select(
        "doc_id",
        X.count_of(t, X.ARABIC_BLOCK).alias("n_arabic"),
        X.count_of(t, X.PRESENTATION).alias("n_forms"),
        X.count_of(t, "[a-zA-Z]").alias("n_latin"),
        X.is_reversed(t).alias("reversed"),
    )


ARF = r"[\x{0600}-\x{06FF}\x{FE70}-\x{FEFF}]"


@query(
    "reversed_audit",
    f"WITH {V.BILINGUAL}, f AS (SELECT {sql_count('text', ARF)} AS n, {REVERSED_SQL} AS rev FROM corpus) "
    "SELECT count(*) AS total, count_if(n = 0)::BIGINT AS non_arabic, count_if(n > 0 AND NOT rev)::BIGINT AS good, "
    "count_if(n > 0 AND rev)::BIGINT AS reversed, round(100.0 * count_if(n > 0 AND rev) / count(*), 1) AS bad_ratio FROM f",
)
def reversed_audit(spark, sf):
    t = F.col("text")
    f = V.bilingual(spark, sf).select(
        t.rlike("[\\u0600-\\u06FF\\uFE70-\\uFEFF]").alias("ar"), X.is_reversed(t).alias("rev")
    )
    bad = F.count_if(F.col("ar") & F.col("rev"))
    return f.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("ar")).alias("non_arabic"),
        F.count_if(F.col("ar") & ~F.col("rev")).alias("good"),
        bad.alias("reversed"),
        F.round(100.0 * bad / F.count("*"), 1).alias("bad_ratio"),
    )


@query(
    "language_tag",
    f"WITH {V.BILINGUAL} SELECT CASE WHEN {sql_count('text[1:400]', AR)} > 20 THEN 'ar' ELSE 'en' END AS tag, "
    "source, count(*) AS n FROM corpus GROUP BY ALL",
)
def language_tag(spark, sf):
    d = V.bilingual(spark, sf).select(X.language_tag(F.col("text")).alias("tag"), "source")
    return d.groupBy("tag", "source").agg(F.count("*").alias("n"))


@query(
    "language_detect",
    f"WITH {V.BILINGUAL}, mixed AS (SELECT CASE WHEN doc_id % 4 = 0 THEN text || (SELECT max(d.text) FROM documents d WHERE d.doc_id = 1) ELSE text END AS text, lang FROM corpus), "
    f"c AS (SELECT lang, {sql_count('text', AR)} AS a, {sql_count('text', '[a-zA-Z]')} AS l FROM mixed) "
    "SELECT lang, CASE WHEN a = 0 AND l = 0 THEN 'unknown' WHEN a = 0 THEN 'english' WHEN l = 0 THEN 'arabic' "
    "WHEN a::DOUBLE / (a + l) >= 0.6 THEN 'arabic' WHEN a::DOUBLE / (a + l) <= 0.4 THEN 'english' "
    "WHEN a::DOUBLE / (a + l) >= 0.5 THEN 'arabic' ELSE 'english' END AS detected, count(*) AS n FROM c GROUP BY ALL",
)
def language_detect(spark, sf):
    d = V.bilingual(spark, sf)
    one = V.table(spark, sf, "documents").filter("doc_id = 1").agg(F.max("text").alias("extra"))
    mixed = d.select(
        "lang",
        F.when(F.col("doc_id") % 4 == 0, F.concat("text", one.scalar())).otherwise(F.col("text")).alias("text"),
    )
    out = mixed.select("lang", X.language_detect(F.col("text")).alias("detected"))
    return out.groupBy("lang", "detected").agg(F.count("*").alias("n"))


@query(
    "contains_arabic",
    f"WITH {V.BILINGUAL} SELECT source, round(avg(CASE WHEN regexp_matches(text, '{ANY_AR}') THEN 1.0 ELSE 0.0 END), 6) AS share "
    "FROM corpus GROUP BY source",
)
def contains_arabic(spark, sf):
    d = V.bilingual(spark, sf)
    share = F.avg(X.is_arabic(F.col("text")).cast("double"))
    return d.groupBy("source").agg(F.round(share, 6).alias("share"))


@query(
    "message_validate",
    "WITH m AS (SELECT CASE WHEN conv_id % 11 = 0 AND turn = 0 THEN '   ' ELSE '  ' || text || ' ' END AS text FROM conversations), "
    "v AS (SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 1000 THEN 'too_long' ELSE 'accepted' END AS reason, text FROM m) "
    "SELECT reason, count(*) AS n, coalesce(sum(CASE WHEN reason = 'accepted' THEN length(trim(text)) END), 0)::BIGINT AS n_chars FROM v GROUP BY reason",
)
def message_validate(spark, sf):
    c = V.table(spark, sf, "conversations")
    text = F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") == 0), "   ").otherwise(
        F.concat(F.lit("  "), "text", F.lit(" "))
    )
    v = c.select(text.alias("text")).select(C.validate_message(F.col("text")).alias("v"))
    return v.groupBy(F.coalesce("v.reason", F.lit("accepted")).alias("reason")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.length("v.text")), F.lit(0)).alias("n_chars")
    )


@query(
    "low_confidence_flag",
    f"WITH {V.EVENT_TURNS} SELECT seq, confidence, confidence < 0.55 AS low_confidence FROM event_turns",
)
def low_confidence_flag(spark, sf):
    e = V.event_turns(spark, sf)
    return e.select("seq", "confidence", (F.col("confidence") < dims.LOW_CONFIDENCE).alias("low_confidence"))


@query(
    "source_snippets",
    "SELECT doc_id, text[1:300] AS snippet, coalesce(CASE WHEN doc_id % 9 > 0 THEN 'doc' || doc_id END, 'unknown') AS doc_name, "
    "nullif(doc_id % 7, 0) AS page FROM documents",
)
def source_snippets(spark, sf):
    d = V.table(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 9 > 0, F.concat(F.lit("doc"), "doc_id"))
    hits = d.select("doc_id", F.col("text").alias("document"), name.alias("doc_name"),
                    F.nullif(F.col("doc_id") % 7, F.lit(0)).alias("page"))
    return hits.select(
        "doc_id", F.substring("document", 1, 300).alias("snippet"),
        F.coalesce("doc_name", F.lit("unknown")).alias("doc_name"), "page",
    )


@query(
    "url_pattern_filter",
    r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '(?i)(?:/fr/)|(?:^https?://blog\.)|(?:utm_source=)')",
)
def url_pattern_filter(spark, sf):
    p = V.table(spark, sf, "pages")
    doomed = C.matches_any(F.col("url"), ["/fr/", "^https?://blog\\.", "utm_source="])
    return p.filter(~doomed).select("page_id", "url")


ASKS = ["", " Who is the Dean now?", " knowhow", " من هو عميد الكلية", " present day", " nowhere"]


@query(
    "current_state_query",
    "WITH m AS (SELECT conv_id, turn, text || " + V.sql_pick(ASKS, "(conv_id + turn) % 6")
    + " AS text FROM conversations WHERE role = 'user'), "
    r"f AS (SELECT regexp_matches(text, '(?i)\b(" + "|".join(dims.CURRENT_STATE_EN) + r")\b|"
    + "|".join(dims.CURRENT_STATE_AR)
    + "') AS flag FROM m) SELECT count(*) AS n, count_if(flag)::BIGINT AS flagged, round(avg(flag::INT), 6) AS share FROM f",
)
def current_state_query(spark, sf):
    c = V.table(spark, sf, "conversations").filter("role = 'user'")
    text = F.concat("text", V.pick(ASKS, (F.col("conv_id") + F.col("turn")) % 6))
    f = c.select(X.is_current_state(text).alias("flag"))
    return f.agg(
        F.count("*").alias("n"), F.count_if("flag").alias("flagged"),
        F.round(F.avg(F.col("flag").cast("int")), 6).alias("share"),
    )

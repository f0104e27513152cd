"""Entity jobs over documents with sentences that mention people, courses, dates and amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.functions import text as X
from dragoman.operators import entities as N
from dragoman.plans import views as V
from dragoman.plans.registry import query

MENTIONS = [
    " Student 221100 took CS401 and IT 377 in spring 2025, passed with grade: 85.",
    " Fees are 120 JD for 3 credit hours in computer science, 200 NIS for hours.",
    " Course 4447 of software engineering moved to 12/05/2024; ABC1234 did not.",
    " رقم الطالب 231045 في قسم هندسة الحاسوب وموعد الفصل الثاني سنة 2024 وهو ناجح",
    " د. احمد محمود يدرس مادة قواعد البيانات بالفصل الأول 3 ساعات معتمدة",
    " The semester fall semester has big data, deep learning and failed 999999.",
    " Nothing to see",
]


def mentions(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", F.concat("text", V.pick(MENTIONS, F.col("doc_id") % len(MENTIONS))).alias("text"))


DOCS = "docs AS (SELECT doc_id, text || " + V.sql_pick(MENTIONS, f"doc_id % {len(MENTIONS)}") + " AS text FROM documents)"


def rows(spark, sf, spans):
    return N.candidate_rows(mentions(spark, sf), spans(F.col("text")))


@query("regex_entities")
def regex_entities(spark, sf):
    return rows(spark, sf, N.regex_spans).select("doc_id", "type", "value", "start", "end")


@query(
    "student_id_parse",
    "WITH s AS (SELECT lpad((o_orderkey * 37 % 1000000)::VARCHAR, 6, '0') AS sid FROM orders), p AS (SELECT 2000 + sid[1:2]::INT AS y, sid[3:3] AS d, "
    "sid[1:2]::INT BETWEEN 10 AND 30 AND sid[3:3] <> '0' AS ok FROM s) "
    "SELECT CASE WHEN ok THEN y END AS enrollment_year, CASE WHEN ok THEN d END AS department_code, count(*) AS n FROM p GROUP BY ALL",
)
def student_id_parse(spark, sf):
    o = V.table(spark, sf, "orders")
    sid = F.lpad((F.col("o_orderkey") * 37 % 1000000).cast("string"), 6, "0")
    p = o.select(N.parse_student_id(sid).alias("p"))
    return p.groupBy("p.enrollment_year", "p.department_code").agg(F.count("*").alias("n"))


CODES = ["CS", "MATH", "ENGL", "XX", "ARE", "ABCDE"]


@query(
    "course_code_validate",
    "WITH c AS (SELECT " + V.sql_pick(CODES, "p_partkey % 6") + " || CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END || (p_partkey * 7 % 20000) AS code, p_partkey * 3 % 10000 AS num FROM part), "
    r"v AS (SELECT regexp_extract(replace(code, ' ', ''), '^([A-Z]{2,4})\d{3,4}$', 1) AS prefix, regexp_matches(num::VARCHAR, '^[3458][0-9]{3}$') AS num_ok FROM c) "
    f"SELECT CASE WHEN prefix IN {V.sql_in(dims.COURSE_PREFIXES)} THEN prefix END AS prefix, num_ok, count(*) AS n FROM v GROUP BY ALL",
)
def course_code_validate(spark, sf):
    k = F.col("p_partkey")
    c = V.table(spark, sf, "part").select(
        F.concat(V.pick(CODES, k % 6), F.when(k % 2 == 0, " ").otherwise(""), k * 7 % 20000).alias("code"),
        (k * 3 % 10000).cast("string").alias("num"),
    )
    v = c.select(N.course_prefix(F.col("code")).alias("prefix"), N.is_course_number(F.col("num")).alias("num_ok"))
    return v.groupBy("prefix", "num_ok").agg(F.count("*").alias("n"))


STATUS_SQL = "(?i)" + "|".join(dims.STATUS_EN)


@query(
    "phrase_entities",
    f"WITH {DOCS}, p AS (SELECT doc_id, 'ACADEMIC_STATUS' AS type, unnest(regexp_extract_all(text, '{STATUS_SQL}')) AS value FROM docs "
    f"UNION ALL SELECT doc_id, 'ACADEMIC_STATUS', unnest(regexp_extract_all(text, '{'|'.join(dims.STATUS_AR)}')) FROM docs "
    rf"UNION ALL SELECT doc_id, 'SEMESTER', unnest(regexp_extract_all(text, 'الفصل\s+(?:{N._ORDINALS.replace(chr(92) * 2, chr(92))})(?:\s*\(\s*\d+\s*ساعة\s*\))?')) FROM docs "
    r"UNION ALL SELECT doc_id, 'DATE', unnest(regexp_extract_all(text, '\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}')) FROM docs "
    r"UNION ALL SELECT doc_id, 'DATE', y FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\d+')) AS y FROM docs WHERE regexp_matches(text, '[\x{0600}-\x{06FF}]')) WHERE regexp_matches(y, '^(20|19)\d\d$')) "
    "SELECT doc_id, type, value, count(*) AS n FROM p GROUP BY ALL",
)
def phrase_entities(spark, sf):
    r = rows(spark, sf, N.phrase_spans).filter("type <> 'PERSON'")
    return r.groupBy("doc_id", "type", "value").agg(F.count("*").alias("n"))


def _kw(kind, words):
    return [f"('{kind}', '{w}')" for w in words]


KEYWORDS = ", ".join(
    _kw("SEMESTER", dims.SEMESTERS_EN) + _kw("DEPARTMENT", dims.DEPARTMENTS_EN) + _kw("COURSE_NAME", dims.COURSES_EN)
)
AR_KEYWORDS = ", ".join(
    f"('{kind}', '{k}', {i}, '{form}')"
    for kind, words in (("SEMESTER", dims.SEMESTERS_AR), ("DEPARTMENT", dims.DEPARTMENTS_AR), ("COURSE_NAME", dims.COURSES_AR))
    for k in N._first_forms(words)
    for i, form in enumerate(N.attached_forms(k))
)


@query(
    "gazetteer_entities",
    f"WITH {DOCS}, kw(type, word) AS (VALUES {KEYWORDS}), ar(type, word, i, form) AS (VALUES {AR_KEYWORDS}), "
    "en AS (SELECT doc_id, type, instr(lower(text), word) - 1 AS start, length(word) AS len, text FROM docs JOIN kw ON contains(lower(text), word)), "
    "nt AS (SELECT doc_id, text, translate(text, 'أإآٱة', 'ااااه') AS norm FROM docs WHERE regexp_matches(text, '[\\x{0600}-\\x{06FF}]')), "
    "hit AS (SELECT doc_id, type, word, arg_min(form, i) AS form, any_value(text) AS text, any_value(norm) AS norm FROM nt JOIN ar ON contains(norm, form) GROUP BY doc_id, type, word), "
    "al AS (SELECT doc_id, type, CASE WHEN instr(text, form) > 0 THEN instr(text, form) ELSE instr(norm, form) END - 1 AS start, length(form) AS len, text FROM hit) "
    "SELECT doc_id, type, text[start + 1:start + len] AS value, start::INT AS start, (start + len)::INT AS end_pos FROM (SELECT * FROM en UNION ALL SELECT * FROM al)",
)
def gazetteer_entities(spark, sf):
    r = rows(spark, sf, N.gazetteer_spans)
    return r.select("doc_id", "type", "value", "start", F.col("end").alias("end_pos"))


# generated candidates: overlapping spans of several types over the documents
@query(
    "resolve_spans",
    "WITH t(seq, type) AS (VALUES (0, 'STUDENT_ID'), (1, 'AMOUNT'), (2, 'DATE'), (3, 'SEMESTER'), (4, 'DEPARTMENT'), (5, 'COURSE_NAME')), "
    "c AS (SELECT doc_id, seq, type, ((doc_id * 7 + seq * 5) % 3)::INT AS start, CASE type WHEN 'STUDENT_ID' THEN 1 WHEN 'DATE' THEN 2 WHEN 'SEMESTER' THEN 7 WHEN 'AMOUNT' THEN 9 ELSE 8 END AS priority FROM documents, t) "
    "SELECT doc_id, start, type, priority::INT AS priority FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY priority, seq) AS rn FROM c) WHERE rn = 1",
)
def resolve_spans(spark, sf):
    kinds = ["STUDENT_ID", "AMOUNT", "DATE", "SEMESTER", "DEPARTMENT", "COURSE_NAME"]
    d = V.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.array(*[F.lit(k) for k in kinds])).alias("seq", "type")
    )
    start = ((F.col("doc_id") * 7 + F.col("seq") * 5) % 3).cast("int")
    c = d.select(
        "doc_id", "seq", F.lit(0).alias("nth"), "type", F.lit("v").alias("value"), start.alias("start"),
        (start + 4).alias("end"), F.lit("").alias("before"), F.lit("").alias("after"),
    )
    return N.resolve_spans(c).select("doc_id", "start", "type", "priority")


AFTERS = [" credit hours", " for the year", " ساعة معتمدة", "12 and", " HRS"]


@query(
    "context_disambiguate",
    "WITH c AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'AMOUNT' ELSE 'DATE' END AS type, (2000 + event_id % 25)::VARCHAR AS value, "
    + V.sql_pick(AFTERS, "event_id % 5") + " AS after FROM events) "
    rf"SELECT event_id, CASE WHEN type = 'AMOUNT' AND regexp_matches(lower(trim(after)), '{'|'.join(dims.CREDIT_TERMS)}') THEN 'CREDIT_HOURS' ELSE type END AS type "
    r"FROM c WHERE NOT (type = 'DATE' AND regexp_matches(after[1:3], '^\d+$'))",
)
def context_disambiguate(spark, sf):
    e = V.table(spark, sf, "events")
    n = F.col("event_id")
    c = e.select(
        "event_id", F.when(n % 2 == 0, "AMOUNT").otherwise("DATE").alias("type"),
        (2000 + n % 25).cast("string").alias("value"), F.lit("on ").alias("before"),
        V.pick(AFTERS, n % 5).alias("after"),
    )
    return N.context_disambiguate(c).select("event_id", "type")


PLAIN = (
    "e AS (SELECT doc_id, 'T' || length(value) % 4 AS type, value, i AS start FROM (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS value FROM "
    "(SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS w FROM documents)))"
)


def plain_entities(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("w"))
    e = d.select("doc_id", F.posexplode("w").alias("p", "value"))
    return e.select("doc_id", F.concat(F.lit("T"), F.length("value") % 4).alias("type"), "value",
                    (F.col("p") + 1).alias("start"), (F.col("p") + 2).alias("end"))


@query(
    "entity_dict",
    f"WITH {PLAIN}, f AS (SELECT doc_id, type, value, min(start) AS start FROM e GROUP BY ALL) "
    "SELECT doc_id, type, string_agg(value, ',' ORDER BY start) AS vals FROM f GROUP BY ALL",
)
def entity_dict(spark, sf):
    d = N.entity_dict(plain_entities(spark, sf))
    x = d.select("doc_id", F.explode("entities").alias("type", "v"))
    return x.select("doc_id", "type", F.array_join("v", ",").alias("vals"))


@query("entity_report")
def entity_report(spark, sf):
    return N.entity_report(N.extract_entities(mentions(spark, sf)))


@query(
    "fold_arabic",
    f"WITH {V.BILINGUAL} SELECT doc_id, md5(translate(regexp_replace(text, '[\\x{{0610}}-\\x{{061A}}\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{0640}}]', '', 'g'), 'أإآٱةىئؤٔ', 'ااااهييوء')) AS digest FROM corpus",
)
def fold_arabic(spark, sf):
    d = V.bilingual(spark, sf)
    return d.select("doc_id", F.md5(X.fold_arabic(F.col("text")).cast("binary")).alias("digest"))

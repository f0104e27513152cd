"""Text jobs over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.functions import text as X
from dragoman.operators import tokens as T
from dragoman.plans import views as V
from dragoman.plans.q_filters import ANY_AR, AR, sql_count
from dragoman.plans.registry import query

AR_LETTERS = "ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىي"


def sql_normalize_arabic(col: str) -> str:
    """The same steps in SQL; the repeat rule goes letter by letter (no back-references there)."""
    t = rf"regexp_replace({col}, '[\x{{200e}}\x{{200f}}\x{{202a}}-\x{{202e}}\x{{0610}}-\x{{061A}}\x{{064B}}-\x{{065F}}\x{{0670}}\x{{0640}}]', '', 'g')"
    t = f"translate({t}, '{X.ARABIC_DIGITS}', '01234567890123456789')"
    t = f"list_reduce(string_split('{AR_LETTERS}', ''), lambda acc, l: regexp_replace(acc, l || '{{3,}}', l || l, 'g'), {t})"
    t = f"translate({t}, 'أإآٱة', 'ااااه')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


TOK = r"[\x{0621}-\x{063A}\x{0641}-\x{064A}\x{0660}-\x{0669}\x{0670}-\x{06FF}]+|[A-Za-z]+|[0-9]+"
NORM = f"{V.BILINGUAL}, norm AS (SELECT doc_id, lang, source, text, regexp_matches(text, '{ANY_AR}') AS arabic, {sql_normalize_arabic('text')} AS nt FROM corpus)"
TOKENS = (
    NORM
    + rf""", tk AS (SELECT doc_id, lang, source, arabic, CASE WHEN arabic THEN regexp_extract_all(nt, '{TOK}')
   ELSE list_filter(regexp_split_to_array(lower(trim(text)), '\s+'), lambda x: x <> '') END AS t FROM norm),
 tokens AS (SELECT doc_id, lang, source, arabic, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM tk)"""
)
PRE = "|".join(dims.ARABIC_PREFIXES)
SUF = "|".join(dims.ARABIC_SUFFIXES)


def sql_stem(t: str, layers: str = "") -> str:
    return (
        rf"CASE WHEN length({t}) <= 2 OR NOT regexp_matches({t}, '{AR}') OR regexp_matches({t}, '^\d+$') THEN {t} "
        rf"ELSE regexp_replace(regexp_replace({t}, '^(?:{PRE}){layers}(.{{2,}})$', '\1'), '^(.{{2,}}?)(?:{SUF}){layers}$', '\1') END"
    )


def sql_stop(t: str, extra_ar=(), extra_en=()) -> str:
    ar = [w for w in [*dims.ARABIC_STOPWORDS, *extra_ar] if " " not in w]
    return f"CASE WHEN arabic THEN {t} IN {V.sql_in(ar)} ELSE {t} IN {V.sql_in([*dims.ENGLISH_STOPWORDS, *extra_en])} END"


EDGE = r"[\s.,!?;:()\[\]{}]"


def content_sql(extra_ar=(), extra_en=()) -> str:
    t = "' ' || nt || ' '"
    for p in T.stop_phrases({"arabic": list(extra_ar)}):
        t = f"regexp_replace({t}, '{EDGE}{p.replace(' ', r'\s+')}{EDGE}', ' ', 'g')"
    return (
        NORM
        + rf""", ct0 AS (SELECT doc_id, arabic, CASE WHEN arabic THEN regexp_extract_all({t}, '{TOK}')
   ELSE list_filter(regexp_split_to_array(lower(trim(text)), '\s+'), lambda x: x <> '') END AS t FROM norm),
 ct1 AS (SELECT doc_id, arabic, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS raw FROM ct0),
 ct2 AS (SELECT doc_id, arabic, pos, CASE WHEN arabic THEN {sql_stem('raw')} ELSE raw END AS token FROM ct1
         WHERE NOT ({sql_stop('raw', extra_ar, extra_en)})),
 content AS (SELECT doc_id, pos, token FROM ct2 WHERE NOT ({sql_stop('token', extra_ar, extra_en)}))"""
    )


def corpus(spark, sf):
    return V.bilingual(spark, sf)


@query(
    "normalize_arabic",
    f"WITH {NORM} SELECT doc_id, length(nt) AS n_chars, md5(nt) AS digest FROM norm",
)
def normalize_arabic(spark, sf):
    n = corpus(spark, sf).select("doc_id", X.normalize_arabic(F.col("text")).alias("nt"))
    return n.select("doc_id", F.length("nt").cast("long").alias("n_chars"), F.md5(F.col("nt").cast("binary")).alias("digest"))


DECOMPOSED = "replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776))"


@query(
    "normalize_corpus",
    f"WITH {V.BILINGUAL}, dec AS (SELECT doc_id, nfc_normalize({DECOMPOSED}) AS text FROM corpus), "
    f"low AS (SELECT doc_id, lower({sql_normalize_arabic('text')}) AS shown FROM dec), "
    r"cls AS (SELECT doc_id, shown, trim(regexp_replace(regexp_replace(shown, '[^\p{L}\p{N}_\s'']', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM low) "
    r"SELECT doc_id, md5(shown) AS shown, md5(c) AS for_classification, md5(trim(regexp_replace(regexp_replace(c, '\d+', '', 'g'), '\s+', ' ', 'g'))) AS no_digits FROM cls",
)
def normalize_corpus(spark, sf):
    d = corpus(spark, sf).withColumn(
        "text",
        F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü")),
    )
    t = F.col("text")
    out = d.select(
        "doc_id",
        X.normalize(t).alias("shown"),
        X.for_classification(t).alias("for_classification"),
        X.normalize(t, punctuation=False, digits=False).alias("no_digits"),
    )
    return out.select("doc_id", *[F.md5(F.col(c).cast("binary")).alias(c) for c in out.columns[1:]])


@query(
    "tokenize_corpus",
    f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, sum(length(token))::BIGINT AS n_chars, min(token) AS first_token, max(token) AS last_token "
    "FROM tokens GROUP BY doc_id",
)
def tokenize_corpus(spark, sf):
    toks = T.tokenize(corpus(spark, sf))
    return toks.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"), F.sum(F.length("token")).alias("n_chars"),
        F.min("token").alias("first_token"), F.max("token").alias("last_token"),
    )


@query(
    "remove_stopwords",
    f"WITH {content_sql()} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct, max(token) AS last_token FROM content GROUP BY doc_id",
)
def remove_stopwords(spark, sf):
    toks = T.remove_stopwords(corpus(spark, sf))
    return toks.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_distinct"),
        F.max("token").alias("last_token"),
    )


EXTRA_AR, EXTRA_EN = ["الن", "لن"], ["thin", "ering"]


@query(
    "custom_stopwords",
    f"WITH {content_sql(EXTRA_AR, EXTRA_EN)} SELECT token, count(*) AS n FROM content GROUP BY token",
)
def custom_stopwords(spark, sf):
    toks = T.remove_stopwords(corpus(spark, sf), extra={"arabic": EXTRA_AR, "english": EXTRA_EN})
    return toks.groupBy("token").agg(F.count("*").alias("n"))


@query(
    "light_stem",
    f"WITH {TOKENS}, d AS (SELECT DISTINCT token FROM tokens WHERE arabic) "
    f"SELECT token, {sql_stem('token')} AS stem, {sql_stem('token', '+')} AS deep_stem FROM d",
)
def light_stem(spark, sf):
    toks = T.tokenize(corpus(spark, sf)).filter("arabic")
    dim = T.stem_dimension(toks)
    return dim.withColumn("deep_stem", X.light_stem(F.col("token"), aggressive=True))


@query(
    "token_annotations",
    f"WITH {TOKENS} SELECT doc_id, count(DISTINCT lemma) AS n_lemmas, count_if(stop)::BIGINT AS n_stop, coalesce(count_if(lemma <> token), 0)::BIGINT AS n_changed "
    f"FROM (SELECT doc_id, token, CASE WHEN arabic THEN {sql_stem('token')} END AS lemma, {sql_stop('token')} AS stop FROM tokens) GROUP BY doc_id",
)
def token_annotations(spark, sf):
    a = T.annotate(corpus(spark, sf))
    return a.groupBy("doc_id").agg(
        F.countDistinct("lemma").alias("n_lemmas"), F.count_if("is_stopword").alias("n_stop"),
        F.count_if(F.col("lemma") != F.col("token")).alias("n_changed"),
    )


@query(
    "token_report",
    f"WITH {content_sql()}, {TOKENS.split(', tk AS', 1)[1].join([' tk AS', ''])}, "
    "a AS (SELECT doc_id, count(*) AS token_count, "
    f"count_if(arabic AND {sql_stem('token')} <> token)::BIGINT AS stem_changes FROM tokens GROUP BY doc_id), "
    "b AS (SELECT doc_id, count(*) AS content_count FROM content GROUP BY doc_id) "
    "SELECT doc_id, token_count::INT AS token_count, coalesce(content_count, 0) AS content_count, "
    "token_count - coalesce(content_count, 0) AS removed, stem_changes FROM a LEFT JOIN b USING (doc_id)",
)
def token_report(spark, sf):
    return T.token_report(corpus(spark, sf))


@query(
    "vocabulary",
    f"WITH {TOKENS} SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tokens GROUP BY token",
)
def vocabulary(spark, sf):
    return T.vocabulary(corpus(spark, sf))


@query(
    "token_estimate",
    "WITH c AS (SELECT conv_id, role, CASE WHEN conv_id % 3 = 0 THEN translate(text, "
    f"'{V.LATIN}', '{V.ARABIC}') ELSE text END AS text FROM conversations) "
    f"SELECT conv_id, role, sum({sql_count('text', AR)} + (length(text) - {sql_count('text', AR)}) // 4)::BIGINT AS tokens FROM c GROUP BY ALL",
)
def token_estimate(spark, sf):
    c = V.table(spark, sf, "conversations")
    text = F.when(F.col("conv_id") % 3 == 0, F.translate("text", V.LATIN, V.ARABIC)).otherwise(F.col("text"))
    return c.groupBy("conv_id", "role").agg(F.sum(X.token_estimate(text)).alias("tokens"))

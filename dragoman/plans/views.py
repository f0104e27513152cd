"""How the test tables stand for the tables of a question-answering service.

Each view exists twice, as a DataFrame and as SQL text, and the two give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.operators.scale import explode_rows

AS_OF = "2025-01-01"

# Latin letters and the Arabic characters that replace them in the bilingual view.
# "th" becomes the article, p a tatweel, y a diacritic, e teh marbuta, a an alef variant.
LATIN = "abcdefghijklmnopqrstuvwxyz0123456789"
ARABIC = "أبكدةفجلينقهمنوـحرساىؤصخَز٠١٢٣٤٥٦٧٨٩"
# the same, with presentation forms for five frequent letters
FORMS = "ﺃبكدﺓفجلينقهمنوـحﺭﺱﺍىؤصخَز٠١٢٣٤٥٦٧٨٩"
CATEGORIES = [
    "academics", "admissions", "about", "administration", "contact", "student_life", "documents",
    "it_services", "news_events", "community", "jobs", "research", "library", "general",
]
SOURCES = ["html", "pdf", "pdf_scanned", "api_json", "upload"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; dealt anew by its first column where the session asks for that.

    A file is cut at its row groups, so a table in one row group keeps one core busy. Large tables have many of them and
    are read as they are; ``spark.dragoman.tasks`` is for small ones, and is set by ``get_session(tasks=...)``.
    """
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get("spark.dragoman.tasks", None)
    return out if tasks is None else out.repartition(int(tasks), out.columns[0])


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values: list[str]) -> str:
    return "(" + sql_list(values)[1:-1] + ")"


def sql_pick(values: list[str], index: str) -> str:
    return f"{sql_list(values)}[({index}) + 1]"


# ---------------------------------------------------------------- bilingual corpus


def bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; German ones in Arabic letters, Spanish ones partly in presentation forms."""
    d = table(spark, sf_dir, "documents")
    text = (
        F.when(F.col("lang") == "de", F.translate("text", LATIN, ARABIC))
        .when(F.col("lang") == "es", F.translate("text", LATIN, FORMS))
        .otherwise(F.col("text"))
    )
    return d.select("doc_id", text.alias("text"), "lang", "source")


BILINGUAL = f"""corpus AS (
  SELECT doc_id, lang, source,
         CASE lang WHEN 'de' THEN translate(text, '{LATIN}', '{ARABIC}')
                   WHEN 'es' THEN translate(text, '{LATIN}', '{FORMS}') ELSE text END AS text
  FROM documents)"""


# ---------------------------------------------------------------- chunk records


def category_of(index: Column) -> Column:
    return pick(CATEGORIES, index % len(CATEGORIES))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunk records with category, source kind, priority and scrape date."""
    d = table(spark, sf_dir, "documents")
    sn = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    scraped = (
        F.when(F.col("doc_id") % 10 == 0, "")
        .when(F.col("doc_id") % 17 == 0, "not a date")
        .otherwise(F.date_add(F.lit("2023-01-01"), (F.col("doc_id") % 900).cast("int")).cast("string"))
    )
    rec = d.select(
        "doc_id",
        F.concat(F.lit("doc"), "doc_id").alias("doc_name"),
        "text",
        F.when(F.col("doc_id") % 13 == 0, "unknown").otherwise(F.col("lang")).alias("lang"),
        category_of(sn).alias("category"),
        pick(SOURCES, F.col("doc_id") % len(SOURCES)).alias("source"),
        scraped.alias("scraped_at"),
    )
    return rec.withColumn("priority", priority_of(F.col("category")))


def priority_of(category: Column) -> Column:
    return (
        F.when(category.isin(dims.HIGH_CATEGORIES), "high")
        .when(category.isin(dims.LOW_CATEGORIES), "low")
        .otherwise("normal")
    )


PRIORITY_SQL = (
    f"CASE WHEN category IN {sql_in(dims.HIGH_CATEGORIES)} THEN 'high' "
    f"WHEN category IN {sql_in(dims.LOW_CATEGORIES)} THEN 'low' ELSE 'normal' END"
)
RECORDS = f"""rec0 AS (
  SELECT doc_id, 'doc' || doc_id AS doc_name, text,
         CASE WHEN doc_id % 13 = 0 THEN 'unknown' ELSE lang END AS lang,
         {sql_pick(CATEGORIES, f"regexp_extract(source, '([0-9]+)', 1)::INT % {len(CATEGORIES)}")} AS category,
         {sql_pick(SOURCES, f"doc_id % {len(SOURCES)}")} AS source,
         CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'not a date'
              ELSE (DATE '2023-01-01' + (doc_id % 900)::INT)::DATE::VARCHAR END AS scraped_at
  FROM documents),
records AS (SELECT *, {PRIORITY_SQL} AS priority FROM rec0)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per non-blank line of a record, numbered from 0 within the document."""
    r = records(spark, sf_dir)
    parts = F.filter(F.split("text", "\\n"), lambda x: F.trim(x) != "")
    meta = ["doc_id", "doc_name", "lang", "category", "priority", "source", "scraped_at"]
    return explode_rows(r.select(*meta, parts.alias("_p")), "_p", "pos", "text")


LINES = (
    RECORDS
    + """,
lines AS (
  SELECT doc_id, doc_name, lang, category, priority, source, scraped_at,
         generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS text
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS parts FROM records))"""
)


# ---------------------------------------------------------------- messages, turns


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns; every fifth assistant turn of a session carries an error reply."""
    c = table(spark, sf_dir, "conversations")
    failed = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 5 == 0)
    return c.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        "role",
        F.when(failed, F.concat(F.lit("Sorry, an error occurred. "), "text"))
        .otherwise(F.col("text"))
        .alias("content"),
    )


TURNS = """turns AS (
  SELECT conv_id AS session_id, turn AS seq, role,
         CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 = 0
              THEN 'Sorry, an error occurred. ' || text ELSE text END AS content
  FROM conversations)"""

EVENT_INTENTS = {
    "view": "course_info", "click": "greeting", "signup": "fallback", "error": "unknown",
    "purchase": "goodbye",
}


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed chat traffic: one row per user message with its intent and confidence.

    Timestamps are compressed 20 times so that sessions and rate windows hold several messages.
    """
    return as_event_turns(table(spark, sf_dir, "events"))


def as_event_turns(e: DataFrame) -> DataFrame:
    """The same for any frame, streaming or not, with the columns of ``events``."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    base = 1704067200 * 1_000_000  # 2024-01-01
    ts = F.timestamp_micros(F.lit(base) + F.floor((micros - F.lit(base)) / 20))
    chain = None
    for kind, name in EVENT_INTENTS.items():
        cond = F.col("event_type") == kind
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    intent = chain.otherwise("unknown")
    return e.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        ts.alias("ts"),
        intent.alias("intent"),
        F.round(F.least(F.col("value") / 100.0, F.lit(1.0)), 4).alias("confidence"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    ).withColumn("text", F.concat(F.when(F.col("k") % 3 == 0, "سؤال رقم ").otherwise("question number "), F.col("k").cast("string")))


EVENT_TURNS = (
    "event_turns AS (\n  SELECT user_id AS session_id, event_id AS seq,\n"
    "    make_timestamp(1704067200000000 + ((epoch_us(ts) - 1704067200000000) // 20)) AS ts,\n"
    "    CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_INTENTS.items())
    + " ELSE 'unknown' END AS intent,\n"
    "    round(least(value / 100.0, 1.0), 4) AS confidence,\n"
    "    (props->>'$.k')::INT AS k,\n"
    "    CASE WHEN (props->>'$.k')::INT % 3 = 0 THEN 'سؤال رقم ' ELSE 'question number ' END || (props->>'$.k')::INT AS text\n  FROM events)"
)

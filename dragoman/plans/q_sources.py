"""Sources and sinks: each query writes its input format from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from dragoman.operators import corpus as C
from dragoman.operators import intents as I
from dragoman.plans import views as V
from dragoman.plans.registry import query
from dragoman.session import scratch_dir
from dragoman.sources import readers as R
from dragoman.sources import store as ST


@query(
    "read_chunk_records",
    f"WITH {V.RECORDS} SELECT doc_id || '-0' AS id, 'doc' || doc_id AS title, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE lang END AS lang, "
    "CASE WHEN doc_id % 6 = 0 THEN 'general' ELSE category END AS category, CASE WHEN doc_id % 9 = 0 THEN 'html' ELSE source END AS source, "
    "doc_id::VARCHAR AS doc_name, length(text) AS n_chars FROM records WHERE doc_id % 50 <> 7",
)
def read_chunk_records(spark, sf):
    r = V.records(spark, sf)
    n = F.col("doc_id")
    rec = F.to_json(F.struct(
        F.concat(n, F.lit("-0")).alias("id"), F.col("doc_name").alias("title"),
        F.when(n % 4 != 0, F.col("lang")).alias("lang"), F.when(n % 6 != 0, F.col("category")).alias("category"),
        F.when(n % 9 != 0, F.col("source")).alias("source"), "text",
    ))
    line = F.when(n % 50 == 7, F.lit('{"id": "broken')).when(n % 11 == 0, F.concat(rec, F.lit("\n"))).otherwise(rec)
    path = scratch_dir(spark, "records")
    r.select(line.alias("value")).write.text(path)
    good = R.good_records(R.read_chunk_records(spark, path))
    return good.select("id", "title", "lang", "category", "source", "doc_name", F.length("text").cast("long").alias("n_chars"))


@query(
    "read_text_corpus",
    f"WITH {V.RECORDS} SELECT CASE WHEN doc_id % 5 = 0 THEN 'folder' || doc_id % 3 ELSE category END AS category, "
    "CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 5 = 0 THEN 'html' WHEN doc_id % 2 = 0 THEN source ELSE '' END AS source, "
    "count(*) AS n, sum(length(trim(text, ' ' || chr(10))))::BIGINT AS n_chars FROM records GROUP BY ALL",
)
def read_text_corpus(spark, sf):
    r = V.records(spark, sf)
    n = F.col("doc_id")
    head = F.concat(
        F.lit("URL: http://example.org/"), n, F.lit("\nTITLE: "), "doc_name", F.lit("\nLANGUAGE: "), "lang",
        F.lit("\nCATEGORY: "), "category", F.lit("\n"),
        F.when(n % 2 == 0, F.concat(F.lit("SOURCE: "), "source", F.lit("\n"))).otherwise(""),
        F.lit("=====\n"),
    )
    path = scratch_dir(spark, "corpus")
    top = F.coalesce(F.concat(F.lit("folder"), n % 3), F.lit("__HIVE_DEFAULT_PARTITION__"))
    value = F.concat(F.when(n % 5 != 0, head).otherwise(""), "text")
    R.write_text_files(r.select(F.concat(top, F.lit("/xx")).alias("folder"), value.alias("value")), path)
    out = R.read_text_corpus(spark, path)
    return out.groupBy("category", "lang", "source").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars")
    )


@query(
    "assemble_documents",
    r"WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '  ' ELSE trim(regexp_replace('  ' || text, '[ \t]+', ' ', 'g')) END AS clean, length(text) * (1 + conv_id % 30) AS n_bytes FROM conversations), "
    "d AS (SELECT conv_id, coalesce(string_agg(CASE WHEN trim(clean) <> '' THEN clean END, chr(10) || chr(10) ORDER BY turn), '') AS text, count(*) AS pages, sum(n_bytes) AS n_bytes FROM p GROUP BY conv_id) "
    "SELECT 'conv' || conv_id AS doc_name, md5(text) AS digest, pages, round(length(text) / greatest(n_bytes, 1), 6) AS yield_ratio, "
    "text = '' OR length(text) / greatest(n_bytes, 1) < 0.05 AS is_scanned, CASE WHEN text = '' THEN 'empty' ELSE 'ok' END AS status FROM d",
)
def assemble_documents(spark, sf):
    c = V.table(spark, sf, "conversations")
    size = F.length("text") * (1 + F.col("conv_id") % 30)
    total = c.groupBy("conv_id").agg(F.sum(size).alias("n_bytes"))
    pages = c.join(total, "conv_id").select(
        F.concat(F.lit("conv"), "conv_id").alias("doc_name"), F.col("turn").alias("page"),
        F.when(F.col("turn") % 4 == 3, "  ").otherwise(F.concat(F.lit("  "), "text")).alias("text"), "n_bytes",
    )
    d = R.assemble_documents(pages)
    return d.select(
        "doc_name", F.md5(F.col("text").cast("binary")).alias("digest"), "pages",
        F.round("yield_ratio", 6).alias("yield_ratio"), "is_scanned", "status",
    )


@query(
    "read_eval_fixture",
    "SELECT d.lang AS intent, count(*) AS n, sum(length(text))::BIGINT AS n_chars, count_if(quality = 1)::BIGINT AS entities, count_if(toxic = 1)::BIGINT AS relevant "
    "FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang",
)
def read_eval_fixture(spark, sf):
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id")
    ent = F.when(F.col("quality") == 1, F.array(F.struct(F.lit("DEPARTMENT").alias("type"), F.col("lang").alias("value"))))
    rel = F.when(F.col("toxic") == 1, F.array(F.concat(F.lit("c"), "doc_id")))
    ex = d.select(
        F.floor(F.col("doc_id") / 200).alias("part"),
        F.to_json(F.struct("text", F.col("lang").alias("intent"), ent.alias("entities"), rel.alias("relevant_chunk_ids"))).alias("j"),
    )
    # document ids are unique, so a part holds at most 200 examples; each part is one array file
    arrays = ex.groupBy("part").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("\n]")).alias("value"))
    path = scratch_dir(spark, "fixture")
    arrays.select("value", "part").write.option("maxRecordsPerFile", 1).partitionBy("part").text(path)
    f = R.read_eval_fixture(spark, f"{path}/*")
    return f.groupBy("intent").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"),
        F.count_if(F.size("entities") > 0).alias("entities"), F.count_if(F.size("relevant_chunk_ids") > 0).alias("relevant"),
    )


@query(
    "read_training_set",
    "SELECT lang AS label, lang IN ('en', 'fr', 'de') AS known, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY lang",
)
def read_training_set(spark, sf):
    d = V.table(spark, sf, "documents")
    path = scratch_dir(spark, "training")
    d.select("text", F.col("lang").alias("label")).write.json(path)
    rows = R.read_training_set(spark, path)
    known, rejected = I.known_labels(rows, spark.createDataFrame([("en",), ("fr",), ("de",)], "label string"))
    both = known.withColumn("known", F.lit(True)).unionByName(rejected.withColumn("known", F.lit(False)))
    return both.groupBy("label", "known").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


TERMS = r"regexp_extract_all(translate(regexp_replace(lower(text), '[\x{064B}-\x{0652}\x{0640}]', '', 'g'), 'أإآىة', 'ااايه'), '[\p{L}\p{N}_]+')"


@query(
    "write_chunk_store",
    f"WITH {V.RECORDS} SELECT category, count(*) AS chunks, count(*) AS vectors, sum(len(list_distinct({TERMS})))::BIGINT AS postings, sum(len({TERMS}))::BIGINT AS tokens FROM records GROUP BY category",
)
def write_chunk_store(spark, sf):
    store = ST.create_store(V.records(spark, sf).withColumnRenamed("doc_id", "chunk_id"), scratch_dir(spark, "store")).refresh()
    has = store.vectors().select("chunk_id", F.lit(1).alias("v"))
    terms = store.index().forward.select("chunk_id", F.size("terms").alias("p"), F.col("dl").alias("t"))
    chunks = store.chunks().select("chunk_id", "category")
    return chunks.join(terms, "chunk_id", "left").join(has, "chunk_id", "left").groupBy("category").agg(
        F.count("*").alias("chunks"), F.sum("v").alias("vectors"), F.sum("p").alias("postings"), F.sum("t").alias("tokens")
    )


@query(
    "rewrite_corpus",
    f"WITH {V.RECORDS} SELECT 'old' AS version, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM records "
    "UNION ALL SELECT 'new', count(*), sum(length(text))::BIGINT FROM records WHERE category <> 'jobs'",
)
def rewrite_corpus(spark, sf):
    root = scratch_dir(spark, "versions")
    r = V.records(spark, sf)
    ST.rewrite_corpus(r, root, "old")
    old = spark.read.schema(r.schema).json(f"{root}/version=old")
    ST.rewrite_corpus(C.ingest_filter(old).filter("category <> 'jobs'"), root, "new")
    both = spark.read.schema(r.schema).json(root)
    return both.groupBy("version").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))

"""Deduplication, incremental load and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from dragoman.operators import corpus as C
from dragoman.plans import views as V
from dragoman.plans.q_filters import PAGES, STRICT_SQL, page_records
from dragoman.plans.registry import query
from dragoman.session import scratch_dir
from dragoman.sources.store import create_store

STORE = V.LINES + """,
 chunks AS (SELECT md5(doc_name || ':c' || pos) AS chunk_id, doc_id, doc_name, category, pos, text FROM lines)"""


def lines(spark, sf):
    return V.lines(spark, sf)


def chunks(spark, sf):
    x = lines(spark, sf)
    return x.select(C.chunk_id(F.col("doc_name"), F.col("pos")).alias("chunk_id"), "doc_id", "doc_name", "category", "pos", "text")


@query(
    "content_dedup",
    f"WITH {V.LINES}, h AS (SELECT doc_id, pos, sha256(text)[1:16] AS content_hash FROM lines) "
    "SELECT doc_id, pos::INT AS pos, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id, pos) AS rn FROM h) WHERE rn = 1",
)
def content_dedup(spark, sf):
    return C.content_dedup(lines(spark, sf), ["doc_id", "pos"]).select("doc_id", "pos", "content_hash")


@query("skip_indexed", f"WITH {V.RECORDS} SELECT doc_id, doc_name FROM records WHERE doc_name NOT IN (SELECT doc_name FROM records WHERE doc_id % 3 = 0)")
def skip_indexed(spark, sf):
    r = V.records(spark, sf)
    return C.skip_indexed(r, r.filter("doc_id % 3 = 0")).select("doc_id", "doc_name")


@query(
    "upsert_chunks",
    f"WITH {STORE}, old AS (SELECT * FROM chunks WHERE doc_id % 3 <> 1), new AS (SELECT * REPLACE (text || chr(33) AS text) FROM chunks WHERE doc_id % 2 = 0) "
    "SELECT chunk_id, md5(text) AS digest FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new))",
)
def upsert_chunks(spark, sf):
    c = chunks(spark, sf)
    new = c.filter("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit("!")))
    out = create_store(c.filter("doc_id % 3 <> 1"), scratch_dir(spark, "store")).upsert(new).chunks()
    return out.select("chunk_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("delete_document", f"WITH {STORE} SELECT doc_name, count(*) AS n FROM chunks WHERE NOT (doc_id % 4 = 1) GROUP BY doc_name")
def delete_document(spark, sf):
    c = chunks(spark, sf)
    store = create_store(c, scratch_dir(spark, "store")).delete(c.filter("doc_id % 4 = 1"))
    return store.compact().chunks().groupBy("doc_name").agg(F.count("*").alias("n"))


@query(
    "force_reingest",
    f"WITH {STORE} SELECT doc_name, count(*) AS n, max(pos)::INT AS last_pos FROM chunks WHERE doc_id % 4 <> 1 OR pos < 2 GROUP BY doc_name",
)
def force_reingest(spark, sf):
    c = chunks(spark, sf)
    shrunk = c.filter("doc_id % 4 = 1 AND pos < 2")
    out = create_store(c, scratch_dir(spark, "store")).reingest(shrunk).chunks()
    return out.groupBy("doc_name").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query("reset_store", f"WITH {STORE} SELECT category, count(*) AS n FROM chunks WHERE pos = 0 GROUP BY category")
def reset_store(spark, sf):
    path = scratch_dir(spark, "reset")
    c = chunks(spark, sf)
    c.select("chunk_id", "category").write.parquet(path)
    c.filter("pos = 0").select("chunk_id", "category").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy("category").agg(F.count("*").alias("n"))


@query(
    "dry_run_counts",
    f"WITH {STORE}, g AS (SELECT *, sha256(text)[1:16] AS h FROM chunks WHERE {STRICT_SQL}) SELECT count(DISTINCT h) AS chunks FROM g",
)
def dry_run_counts(spark, sf):
    good = chunks(spark, sf).filter(C.strict_quality(F.col("text")))
    return C.content_dedup(good, ["doc_id", "pos"]).agg(F.count("*").alias("chunks"))


@query(
    "ingest_summary",
    f"WITH {V.LINES}, d AS (SELECT doc_id, source AS phase, count(CASE WHEN {STRICT_SQL} THEN 1 END) AS chunks FROM lines GROUP BY ALL) "
    "SELECT phase, count_if(chunks > 0)::BIGINT AS files, sum(chunks)::BIGINT AS chunks, count_if(chunks = 0)::BIGINT AS skipped, "
    "CASE WHEN count_if(chunks > 0) > 0 THEN 'ok' ELSE 'no_files' END AS status FROM d GROUP BY ROLLUP (phase)",
)
def ingest_summary(spark, sf):
    d = lines(spark, sf).groupBy("doc_id", F.col("source").alias("phase")).agg(
        F.count_if(C.strict_quality(F.col("text"))).alias("chunks")
    )
    return C.ingest_summary(d)


@query("document_catalog", f"WITH {STORE} SELECT doc_name, count(*) AS chunks FROM chunks GROUP BY doc_name")
def document_catalog(spark, sf):
    return C.document_catalog(chunks(spark, sf))


def key_sql(ext: str) -> str:
    path = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)', 1)"
    return rf"regexp_replace(trim({path}, '/'), '[^\p{{L}}\p{{N}}_\-.]', '_', 'g')[1:80] || '_' || md5(url)[1:6] || '{ext}'"


LISTING = (
    f"listing AS (SELECT 'txt/' || {key_sql('.txt')} AS f FROM page_records WHERE page_id % 3 <> 1 "
    f"UNION SELECT '_pdfs/' || {key_sql('.pdf')} FROM page_records WHERE page_id % 4 = 0 UNION SELECT 'raw/' || doc_name FROM page_records WHERE page_id % 7 = 0)"
)


@query(
    "sync_with_files",
    f"WITH {PAGES}, {LISTING}, r AS (SELECT page_id, source, CASE WHEN regexp_matches(url, '(?i)(?:/fr/)') THEN 'url_pattern' "
    f"WHEN source IN ('pdf', 'pdf_scanned') AND '_pdfs/' || {key_sql('.pdf')} NOT IN (FROM listing) AND 'raw/' || doc_name NOT IN (FROM listing) THEN 'file_deleted' "
    f"WHEN source IN ('html', 'api_json') AND 'txt/' || {key_sql('.txt')} NOT IN (FROM listing) THEN 'file_deleted' END AS removal FROM page_records) "
    "SELECT source, coalesce(removal, 'kept') AS outcome, count(*) AS n FROM r GROUP BY ALL",
)
def sync_with_files(spark, sf):
    p = page_records(spark, sf)
    url, n = F.col("url"), F.col("page_id")
    txt = p.filter(n % 3 != 1).select(F.lit("txt").alias("folder"), C.url_file_key(url).alias("file_name"))
    pdf = p.filter(n % 4 == 0).select(F.lit("_pdfs").alias("folder"), C.url_file_key(url, ".pdf").alias("file_name"))
    raw = p.filter(n % 7 == 0).select(F.lit("raw").alias("folder"), F.col("doc_name").alias("file_name"))
    out = C.sync_with_files(p, txt.unionByName(pdf).unionByName(raw), ["/fr/"])
    return out.groupBy("source", F.coalesce("removal", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query("url_file_key", f"SELECT page_id, {key_sql('.txt')} AS txt_key, {key_sql('.pdf')} AS pdf_key FROM pages")
def url_file_key(spark, sf):
    p = V.table(spark, sf, "pages")
    return p.select("page_id", C.url_file_key(F.col("url")).alias("txt_key"), C.url_file_key(F.col("url"), ".pdf").alias("pdf_key"))


@query(
    "embedding_reuse",
    "WITH k AS (SELECT doc_id, md5(lower(trim(text))) AS key FROM documents), "
    "cache AS (SELECT key, min(doc_id) AS d FROM k WHERE doc_id % 3 <> 0 GROUP BY key), "
    "r AS (SELECT k.doc_id, c.key IS NOT NULL AS reused FROM k LEFT JOIN (SELECT key FROM cache WHERE d % 120 <= 60) c USING (key)) "
    "SELECT count_if(reused)::BIGINT AS reused, count_if(NOT reused)::BIGINT AS computed, round(avg(reused::INT), 6) AS hit_rate FROM r",
)
def embedding_reuse(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    # cached between 0 and 119 minutes before the reference time
    cached = d.filter("doc_id % 3 <> 0").groupBy(C.cache_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("d"))
    age = F.make_interval(mins=(F.col("d") % 120).cast("int"))
    cache = cached.select("key", (F.to_timestamp(F.lit(V.AS_OF)) - age).alias("cached_at"))
    r = C.embedding_reuse(d, cache, V.AS_OF)
    return r.agg(
        F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("computed"),
        F.round(F.avg(F.col("reused").cast("int")), 6).alias("hit_rate"),
    )


@query(
    "embedding_evict",
    "WITH u AS (SELECT md5(user_id || event_type || (event_id % 5)) AS key, max(epoch_us(ts)) AS last_used FROM events GROUP BY 1) SELECT key, last_used FROM u ORDER BY last_used DESC, key LIMIT 1000",
)
def embedding_evict(spark, sf):
    e = V.table(spark, sf, "events")
    key = F.md5(F.concat("user_id", "event_type", F.col("event_id") % 5).cast("binary"))
    uses = e.select(key.alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("used_at"))
    return C.embedding_evict(uses)


@query(
    "chunk_ids",
    f"WITH {V.LINES}, g AS (SELECT doc_name, pos, row_number() OVER (PARTITION BY doc_name ORDER BY pos) - 1 AS idx FROM lines WHERE {STRICT_SQL}) "
    "SELECT doc_name, idx::INT AS chunk_index, md5(doc_name || ':c' || idx) AS chunk_id FROM g",
)
def chunk_ids(spark, sf):
    # renumbered after the gate inside the row: filter the array, then explode with position
    r = V.records(spark, sf).withColumn(
        "p", F.filter(F.split("text", "\\n"), lambda x: (F.trim(x) != "") & C.strict_quality(x))
    )
    x = r.select("doc_name", F.posexplode("p").alias("chunk_index", "t"))
    return x.select("doc_name", "chunk_index", C.chunk_id(F.col("doc_name"), F.col("chunk_index")).alias("chunk_id"))


@query(
    "chunk_stats",
    f"WITH {V.RECORDS}, l AS (SELECT doc_id, category, lang, length(text) < 500 AS short, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS text FROM records), "
    f"d AS (SELECT doc_id, category, lang, short, count(CASE WHEN {STRICT_SQL} THEN 1 END) AS kept, count(CASE WHEN NOT {STRICT_SQL} THEN 1 END) AS dropped FROM l GROUP BY ALL) "
    "SELECT category, lang, count(*) AS docs, sum(kept)::BIGINT AS kept, sum(dropped)::BIGINT AS dropped, count_if(short)::BIGINT AS short_docs FROM d GROUP BY ALL",
)
def chunk_stats(spark, sf):
    r = V.records(spark, sf).withColumn("p", F.filter(F.split("text", "\\n"), lambda x: F.trim(x) != ""))
    d = r.select(
        "category", "lang", (F.length("text") < 500).alias("short"), F.size("p").alias("n"),
        F.size(F.filter("p", lambda x: C.strict_quality(x))).alias("kept"),
    )
    return d.groupBy("category", "lang").agg(
        F.count("*").alias("docs"), F.sum("kept").alias("kept"), F.sum(F.col("n") - F.col("kept")).alias("dropped"),
        F.count_if("short").alias("short_docs"),
    )

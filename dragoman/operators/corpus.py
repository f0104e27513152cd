"""Filters, category rules, quality gates, deduplication and table maintenance for chunk records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.functions import text as X

# ---------------------------------------------------------------- filters and labels


def ingest_filter(
    df: DataFrame, lang: str | None = None, category: str | None = None, skip_scanned: bool = False
) -> DataFrame:
    """Keep rows by language, category and scan flag; language ``unknown`` always passes."""
    if lang:
        df = df.filter(F.col("lang").isin("unknown", lang))
    if category:
        df = df.filter(F.col("category") == category)
    if skip_scanned:
        df = df.filter(F.col("source") != "pdf_scanned")
    return df


def is_quality(text: Column, min_chars: Column | int, min_alpha: float) -> Column:
    t = X.strip(text)
    size = F.length(t)
    return (size >= min_chars) & (X.letters(t) / F.greatest(size, F.lit(1)) >= min_alpha)


def strict_quality(text: Column) -> Column:
    return is_quality(text, dims.STRICT_MIN_CHARS, dims.STRICT_MIN_ALPHA)


def lenient_quality(text: Column, min_chars: Column | int = dims.LENIENT_MIN_CHARS) -> Column:
    """Lower floors; text in presentation forms is dropped since nothing here can reorder it."""
    return ~X.is_reversed(text) & is_quality(text, min_chars, dims.LENIENT_MIN_ALPHA)


def lenient_floor(doc_chars: Column) -> Column:
    return F.when(doc_chars < dims.SHORT_DOC, dims.LENIENT_SHORT_MIN_CHARS).otherwise(
        dims.LENIENT_MIN_CHARS
    )


def quality_report(chunks: DataFrame, good: Column) -> DataFrame:
    """Kept and dropped chunks per document; a document whose chunk column is null is empty."""
    return (
        chunks.groupBy("doc_id")
        .agg(
            F.count_if(good).alias("kept"),
            F.count_if(~good).alias("dropped"),
            F.count("text").alias("n"),
        )
        .select(
            "doc_id",
            "kept",
            "dropped",
            F.when(F.col("n") == 0, "empty")
            .when(F.col("kept") == 0, "no_quality_chunks")
            .otherwise("ok")
            .alias("status"),
        )
    )


def first_rule(haystack: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first rule one of whose words occurs in ``haystack``."""
    out = None
    for label, words in rules:
        hit = None
        for w in words:
            c = haystack.contains(w)
            hit = c if hit is None else hit | c
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def assign_category(doc_name: Column, text: Column) -> Column:
    haystack = F.lower(F.concat(doc_name, F.lit(" "), F.substring(text, 1, 300)))
    return first_rule(haystack, dims.CATEGORY_RULES, "general")


def recategorize(
    df: DataFrame, rules: list[tuple[str, list[str]]] = dims.RELABEL_RULES
) -> DataFrame:
    """Relabel rows of category ``documents`` from url and title; other rows stay."""
    haystack = F.lower(F.concat_ws(" ", "url", "title"))
    label = first_rule(haystack, rules, "documents")
    return df.withColumn(
        "category", F.when(F.col("category") == "documents", label).otherwise(F.col("category"))
    )


def priority_tier(category: Column) -> Column:
    return (
        F.when(category.isin(dims.HIGH_CATEGORIES), "high")
        .when(category.isin(dims.LOW_CATEGORIES), "low")
        .otherwise("normal")
    )


def validate_message(text: Column) -> Column:
    """Struct of reason (null when accepted) and the stripped text; length counts before the strip."""
    t = X.strip(F.coalesce(text, F.lit("")))
    reason = F.when(t == "", "empty").when(F.length(text) > dims.MAX_MESSAGE, "too_long")
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), t).alias("text"))


def matches_any(url: Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return F.coalesce(url.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


# ---------------------------------------------------------------- ids and dedup


def chunk_id(doc_name: Column, index: Column) -> Column:
    return F.md5(F.concat(doc_name, F.lit(":c"), index.cast("string")).cast("binary"))


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def content_dedup(df: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """First row per content hash in ``order``.

    ``row_number = 1`` plans a partial group limit before the shuffle, so each map task sends one
    row per distinct text however many copies it holds.
    """
    w = W.partitionBy("content_hash").orderBy(*order)
    return (
        df.withColumn("content_hash", content_hash(F.col(text)))
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .drop("_rn")
    )


# ---------------------------------------------------------------- table maintenance


def skip_indexed(new: DataFrame, store: DataFrame, force: bool = False) -> DataFrame:
    """Rows of documents not in the store yet."""
    if force:
        return new
    return new.join(store.select("doc_name").distinct(), "doc_name", "left_anti")


def upsert_chunks(store: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by chunk id."""
    return store.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def delete_documents(store: DataFrame, doomed: DataFrame) -> DataFrame:
    return store.join(doomed.select("doc_name").distinct(), "doc_name", "left_anti")


def force_reingest(store: DataFrame, new: DataFrame) -> DataFrame:
    """Replace whole documents, so that a document that shrank leaves no chunk behind."""
    return delete_documents(store, new).unionByName(new)


def document_catalog(store: DataFrame) -> DataFrame:
    return store.groupBy("doc_name").agg(F.count("*").alias("chunks")).orderBy("doc_name")


def ingest_summary(df: DataFrame) -> DataFrame:
    """Per phase and in total (phase null): files, chunks, skipped files, status."""
    return (
        df.rollup("phase")
        .agg(
            F.count_if(F.col("chunks") > 0).alias("files"),
            F.sum("chunks").alias("chunks"),
            F.count_if(F.col("chunks") == 0).alias("skipped"),
        )
        .withColumn("status", F.when(F.col("files") > 0, "ok").otherwise("no_files"))
    )


# ---------------------------------------------------------------- files and urls


def url_file_key(url: Column, extension: str = ".txt") -> Column:
    """Path of the url with unsafe characters replaced, cut to 80, plus six hash digits."""
    # the path runs from the first slash after the host to ?, # or ; (params belong to the last part)
    path = F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    key = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "(?U)[^\\w\\-.]", "_")
    return F.concat(
        F.substring(key, 1, 80), F.lit("_"), F.left(F.md5(url.cast("binary")), F.lit(6)),
        F.lit(extension),
    )


def sync_with_files(
    records: DataFrame, listing: DataFrame, remove_patterns: list[str] | None = None
) -> DataFrame:
    """Add ``removal``: null for kept rows, else ``url_pattern`` or ``file_deleted``.

    ``listing`` has (folder, file_name); pdf rows look in ``_pdfs`` by url key and in ``raw`` by
    document name, page-like rows in ``txt`` by url key, other sources are kept.
    """
    pdf = F.col("source").isin("pdf", "pdf_scanned")
    page = F.col("source").isin("html", "scraped_html", "api_json", "json")
    url = F.coalesce("url", F.lit(""))
    keyed = records.withColumn(
        "_key",
        F.when(pdf, F.concat(F.lit("_pdfs/"), url_file_key(url, ".pdf"))).when(
            page, F.concat(F.lit("txt/"), url_file_key(url))
        ),
    ).withColumn("_raw", F.when(pdf, F.concat(F.lit("raw/"), "doc_name")))
    files = listing.select(F.concat_ws("/", "folder", "file_name").alias("_file")).distinct()
    by_key = files.select(F.col("_file").alias("_key"), F.lit(True).alias("_has_key"))
    by_raw = files.select(F.col("_file").alias("_raw"), F.lit(True).alias("_has_raw"))
    found = F.coalesce("_has_key", "_has_raw", ~(pdf | page))
    removal = F.when(matches_any(url, remove_patterns or []), "url_pattern").when(
        ~found, "file_deleted"
    )
    # rows without a key are never shuffled for it: they would meet in one partition
    keys, raws = F.col("_key").isNotNull(), F.col("_raw").isNotNull()
    has_key, has_raw = F.lit(None).cast("boolean").alias("_has_key"), F.lit(None).cast("boolean").alias("_has_raw")
    first = keyed.filter(keys).join(by_key, "_key", "left").unionByName(keyed.filter(~keys).select("*", has_key))
    second = first.filter(raws).join(by_raw, "_raw", "left").unionByName(first.filter(~raws).select("*", has_raw))
    return second.withColumn("removal", removal).drop("_key", "_raw", "_has_key", "_has_raw")


# ---------------------------------------------------------------- stored embeddings


def cache_key(text: Column) -> Column:
    return F.md5(F.lower(X.strip(text)).cast("binary"))


def embedding_reuse(texts: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """Mark texts whose vector is stored and not older than one hour at ``as_of``.

    ``cache`` has (key, cached_at). Only rows with ``reused`` false need a new vector.
    """
    fresh = cache.filter(
        F.col("cached_at") >= F.to_timestamp(F.lit(as_of)) - F.expr("INTERVAL 1 HOUR")
    ).select("key", F.lit(True).alias("_hit"))
    keyed = texts.withColumn("key", cache_key(F.col("text")))
    # a text that occurs often is looked up once; the few keys found are then matched to the rows
    found = keyed.select("key").distinct().join(fresh.distinct(), "key")
    known = keyed.filter("key IS NOT NULL").join(found, "key", "left")
    rows = known.unionByName(keyed.filter("key IS NULL").withColumn("_hit", F.lit(None).cast("boolean")))
    return rows.withColumn("reused", F.coalesce("_hit", F.lit(False))).drop("_hit")


def embedding_evict(uses: DataFrame, capacity: int = 1000) -> DataFrame:
    """The ``capacity`` most recently used keys."""
    last = uses.groupBy("key").agg(F.max("used_at").alias("last_used"))
    return last.orderBy(F.desc("last_used"), "key").limit(capacity)

"""Whole jobs put together from the other operators: corpus ingestion and message processing."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.functions import text as X
from dragoman.operators import chunking as K
from dragoman.operators import corpus as C
from dragoman.operators import dialogue as D
from dragoman.operators import entities as N
from dragoman.operators import intents as I
from dragoman.operators import metrics as M
from dragoman.operators import ranking as R
from dragoman.operators.scale import cut

META = ["doc_name", "url", "title", "lang", "category", "source", "headings", "scraped_at"]


def described(documents: DataFrame) -> DataFrame:
    """Documents with all metadata columns; language and category are filled where they are missing."""
    docs = documents
    for name in META[1:]:
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    t = F.col("text")
    return docs.withColumns(
        {
            "lang": F.coalesce("lang", X.language_tag(t)),
            "category": F.coalesce("category", C.assign_category(F.col("doc_name"), t)),
        }
    )


def gated_documents(docs: DataFrame, strategy: str) -> DataFrame:
    """One row per document: its chunks that pass the gate, how many there were, and whether the text was blank. Columns
    of ``docs`` beside text are kept."""
    t = F.col("text")
    kept = [c for c in docs.columns if c != "text"]
    cleaned = docs.withColumn("text", F.when(X.is_reversed(t), "").otherwise(t))
    cut_up = K.chunk_corpus(cleaned, strategy).withColumn("floor", C.lenient_floor(F.length(t)))
    good = F.filter("chunks", lambda c: C.lenient_quality(c, F.col("floor")))
    return cut_up.select(
        *kept, "is_short_doc",
        (F.coalesce(X.strip(t), F.lit("")) == "").alias("blank"),
        F.size("chunks").alias("raw"),
        F.transform(good, X.strip).alias("chunks"),
    )


def numbered_chunks(gated: DataFrame) -> DataFrame:
    """Chunk rows with ids and metadata: the first copy of each text over all documents, numbered within its document."""
    rows = K.explode_rows(gated.select(*META, "is_short_doc", "chunks"), "chunks", "pos", "text")
    first = C.content_dedup(rows, ["doc_name", "pos"])
    # within one document, so at most the chunks of one row
    doc = W.partitionBy("doc_name")
    chunks = first.select(
        *META, "is_short_doc", "content_hash", "text",
        (F.row_number().over(doc.orderBy("pos")) - 1).alias("chunk_index"),
        F.count("*").over(doc).alias("total_chunks"),
    )
    return chunks.withColumns(
        {
            "chunk_id": C.chunk_id(F.col("doc_name"), F.col("chunk_index")),
            "priority": C.priority_tier(F.col("category")),
            "title": F.substring("title", 1, 200),
            "headings": F.substring("headings", 1, 400),
            "is_scanned": F.coalesce(F.col("source") == "pdf_scanned", F.lit(False)),
        }
    )


def ingest_corpus(
    documents: DataFrame, store: DataFrame | None = None, strategy: str = "contextual", force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Chunk rows to store and the status of every document.

    ``documents`` has doc_name and text; url, title, lang, category, source, headings and scraped_at
    are filled where they are missing. Documents in ``store`` are skipped unless ``force``.
    """
    docs = described(documents)
    if store is None or force:
        todo, known = docs, None
    else:
        names = store.select("doc_name").distinct()
        todo = docs.join(names, "doc_name", "left_anti")
        known = docs.join(names, "doc_name", "left_semi").select("doc_name")
    # the chunk folds run once; statuses and rows both read their result
    gated = cut(gated_documents(todo.select(*META, "text"), strategy), "ingest")
    chunks = numbered_chunks(gated)
    kept = chunks.groupBy("doc_name").agg(F.count("*").alias("kept"))
    status = gated.select("doc_name", "blank", "raw").join(kept, "doc_name", "left").select(
        "doc_name",
        F.when(F.col("blank"), "empty").when(F.col("kept").isNull(), "no_quality_chunks").otherwise("ok").alias("status"),
        F.coalesce("kept", F.lit(0)).alias("chunks"),
        (F.col("raw") - F.coalesce("kept", F.lit(0))).alias("skipped_chunks"),
    )
    if known is not None:
        skipped = known.select(
            "doc_name", F.lit("already_indexed").alias("status"), F.lit(0).cast("long").alias("chunks"),
            F.lit(0).cast("long").alias("skipped_chunks"),
        )
        status = status.unionByName(skipped)
    return chunks, status


def ingest_records(
    records: DataFrame,
    store: DataFrame | None = None,
    lang: str | None = None,
    category: str | None = None,
    skip_scanned: bool = False,
) -> DataFrame:
    """Chunk rows from records that are chunks already (the output of ``readers.good_records``).

    Filter, skip documents in ``store``, gate, first copy of each text, ids and metadata.
    """
    rows = C.ingest_filter(records, lang, category, skip_scanned)
    if store is not None:
        rows = C.skip_indexed(rows, store)
    rows = rows.filter(C.lenient_quality(F.col("text"))).withColumn("text", X.strip(F.col("text")))
    rows = C.content_dedup(rows, ["doc_name", "chunk_index", "id"])
    named = F.when(F.col("doc_name") != "", F.col("doc_name")).otherwise(
        F.left(C.content_hash(F.col("url")), F.lit(8))
    )
    made = C.chunk_id(F.col("url"), F.col("chunk_index"))
    return rows.select(
        F.when(F.col("id") != "", F.col("id")).otherwise(made).alias("chunk_id"),
        named.alias("doc_name"), "url", F.substring("title", 1, 200).alias("title"), "lang", "category",
        "source", "chunk_index", C.priority_tier(F.col("category")).alias("priority"), "scraped_at",
        "text", "content_hash",
    )


def run_evaluation(
    fixture: DataFrame, model: PipelineModel, chunks: DataFrame, as_of: str, k: int = 3
) -> DataFrame:
    """All metrics of an evaluation fixture as (metric, value) rows.

    ``fixture`` is the output of ``readers.read_eval_fixture``; retrieval is scored only for examples
    that name relevant chunks, and is 0 when none does.
    """
    # a number per row, fixed by writing it: equal examples stay two
    keyed = fixture.withColumn("example", F.monotonically_increasing_id())
    ex = cut(keyed.withColumn("clean", X.for_classification(F.col("text"))), "evaluation")
    pairs = I.predict_intent(ex.select("example", "clean"), model, "clean")
    truth = ex.select("example", F.col("intent").alias("truth"))
    pairs = pairs.select("example", F.col("intent").alias("predicted")).join(truth, "example")
    found = N.extract_entities(ex.select("example", "text"), "example").select("example", "type", "value")
    wanted = ex.select("example", F.explode("entities").alias("e")).select("example", "e.type", "e.value")
    asked = ex.filter(F.size("relevant_chunk_ids") > 0).select(
        F.col("example").alias("query_id"), F.col("clean").alias("text"), "relevant_chunk_ids"
    )
    hits = R.hybrid_topk(chunks, asked.select("query_id", "text"), as_of, k)
    rel = asked.select("query_id", F.array_distinct("relevant_chunk_ids").alias("rel"))
    scored = hits.join(rel, "query_id").select(
        "query_id", "rank", "chunk_id",
        F.array_contains("rel", F.col("chunk_id").cast("string")).alias("relevant"),
    )
    per_query = M.retrieval_scores(scored, rel, rel.select("query_id", F.size("rel").alias("n")), k)
    means = [
        M.mean_of(per_query, column, f"retrieval_{name}")
        for column, name in (
            ("precision", "precision_at_k"), ("recall", "recall_at_k"), ("rr", "mrr"), ("ndcg", "ndcg_at_k"),
        )
    ]
    ner = M.ner_micro_f1(found, wanted)
    tables = [
        M.intent_accuracy(pairs).withColumnRenamed("accuracy", "intent_accuracy"),
        M.macro_f1(M.per_class_f1(pairs)).withColumnRenamed("macro_f1", "intent_macro_f1"),
        ner.select(*[F.col(c).alias(f"ner_{c}") for c in ner.columns]),
        *means,
        ex.agg(F.count("*").alias("num_examples")),
    ]
    return M.evaluation_report([M.as_rows(t) for t in tables])


def classify_batch(messages: DataFrame, model: PipelineModel, id_col: str = "message_id") -> DataFrame:
    """Intent, confidence, scores and entity map per message, without retrieval."""
    clean = messages.select(id_col, "text", X.for_classification(F.col("text")).alias("clean"))
    predicted = I.predict_intent(clean, model, "clean")
    found = N.entity_dict(N.extract_entities(messages, id_col), id_col)
    return predicted.join(found, id_col, "left")


def process_batch(
    turns: DataFrame,
    chunks: DataFrame,
    model: PipelineModel,
    as_of: str,
    history: DataFrame | None = None,
) -> DataFrame:
    """Whole message processing for (session_id, seq, ts, text).

    Messages the router answers itself never reach retrieval; for the others the prompt and the
    sources are built. Result: one row per message.
    """
    base = turns.withColumn("clean", X.for_classification(F.col("text"))).filter("clean <> ''")
    predicted = cut(
        I.predict_intent(base, model, "clean").select("session_id", "seq", "ts", "text", "clean", "intent", "confidence"),
        "process-intents",
    )
    routed = D.route_turns(predicted).select("session_id", "seq", "handled", "reason", "pool", "reply_index")
    rows = predicted.join(routed, ["session_id", "seq"]).withColumn(
        "query_id", F.concat_ws(":", F.col("seq").cast("string"), F.col("session_id").cast("string"))
    )
    rows = cut(rows, "process-routed")
    open_ = rows.filter(~F.col("handled")).select("query_id", "text", "clean")
    ents = N.extract_entities(open_, "query_id")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(sorted(dims.ENTITY_PRIORITY)) for x in (k, i)])
    values = ents.select("query_id", F.try_element_at(order, F.col("type")).alias("type_order"), "start", "value")
    enriched = R.enrich_query(open_.select("query_id", F.col("clean").alias("text")), values)
    asked = cut(enriched, "process-queries")
    expanded = asked.withColumn("text", R.expand_query(F.col("text")))
    best = R.rerank(R.hybrid_topk(chunks, expanded, as_of, 10), 3)
    picked = R.with_chunk_columns(
        best.select("query_id", "chunk_id", "score"), chunks,
        [R.budgeted().alias("document"), "doc_name", "page"],
    )
    ctx = cut(R.context_budget(picked), "process-context")
    prompts = R.prompt_dataset(asked, ctx, history)
    sources = ctx.groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("rank", F.substring("document", 1, 300).alias("text"),
                         F.coalesce("doc_name", F.lit("unknown")).alias("doc_name"), "page")
            )
        ).alias("sources")
    )
    return (
        rows.select("session_id", "seq", "query_id", "intent", "confidence", "handled", "reason", "pool", "reply_index")
        .join(prompts, "query_id", "left")
        .join(sources, "query_id", "left")
        .drop("query_id")
    )

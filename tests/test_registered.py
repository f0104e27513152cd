"""A spread of registered queries next to their SQL on the smallest tables.

``tools/check_oracle.py`` compares all of them.
"""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "documents embeddings pages benchmark labels conversations events orders part".split()
KEYS = [
    "quality_report", "recategorize", "normalize_arabic", "content_dedup", "sync_with_files", "stratified_split",
    "per_class_f1", "session_list", "delete_sessions", "feedback_summary", "chunk_semantic", "stream_sessions",
    "mrr", "evaluation_report", "extract_blocks", "chunk_char", "vocabulary", "build_postings", "hybrid_topk",
    "embedding_reuse", "language_detect", "top_k_intents", "ingest_chunks", "stream_ingest", "stream_stats",
    "stream_rate_limit", "stream_routing", "stream_dedup", "route_turns",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def flat(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, sf, con, key):
    df = entry.queries()[key](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(flat(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == cols
    assert got == sorted(tuple(flat(r[i]) for i in order) for r in cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    from dragoman.operators import dialogue as D
    from dragoman.plans import views as V

    plan = D.recent_turns(V.turns(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan

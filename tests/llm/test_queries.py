"""Registered queries of the folder next to their SQL, and the pipeline stage by stage."""

from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from dragoman.llm import mixing, quality
from dragoman.llm.queries import ORACLES, QUERIES

from .conftest import words


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def flat(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, key):
    df = QUERIES[key](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(flat(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(ORACLES[key])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == cols
    assert got == sorted(tuple(flat(r[i]) for i in order) for r in cur.fetchall())


def test_thirteen_operators():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def plain_lines(rows):
    """Texts without the lines that an earlier line matches."""
    known = sorted((d, i, frozenset(words(x))) for d, t in rows.items() for i, x in enumerate(t.split("\n")) if words(x))
    index, gone = defaultdict(list), defaultdict(set)
    for at, (d, i, s) in enumerate(known):
        near = Counter(j for w in s for j in index[w])
        if any(9 * n >= 4 * (len(s) + len(known[j][2])) for j, n in near.items()):
            gone[d].add(i)
        for w in s:
            index[w].append(at)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows.items()}


def plain_groups(rows):
    """Least document of every group of similar ones; a document without words is a group of its own."""
    sets = {d: {tuple(words(t)[j : j + 5]) for j in range(max(1, len(words(t)) - 4))} if words(t) else set() for d, t in rows.items()}
    index, root = defaultdict(list), {d: d for d in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(rows):
        near = Counter(o for s in sets[d] for o in index[s])
        for o, n in near.items():
            if 9 * n >= 4 * (len(sets[d]) + len(sets[o])):
                a, b = sorted((top(d), top(o)))
                root[b] = a
        for s in sets[d]:
            index[s].append(d)
    return {d for d in rows if top(d) == d}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "source_mix", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf).cache()
        rows = out.collect()
        if name == "quality_rules":
            judged = quality.apply_policy(quality.ledger(docs), quality.POLICIES[quality.CURRENT]).filter("kept").collect()
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in judged)
        elif name == "line_dedup":
            assert {r.doc_id: r.text for r in rows} == plain_lines(before) and all(r.n_chars == len(r.text) for r in rows)
        elif name == "jaccard_join":
            assert sorted(r.doc_id for r in rows) == sorted(plain_groups(before))
        elif name == "source_mix":
            assert Counter(r.doc_id for r in rows) == Counter({r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.taken})
        else:
            ends = Counter()
            for r in rows:
                ends[r.doc_id] += r.start + r.length == r.doc_tokens
            assert ends == Counter(r.doc_id for r in docs.collect())
        if name != "packing":
            assert out.columns == columns
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == len(rows)

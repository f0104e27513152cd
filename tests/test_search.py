import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dragoman.functions import dims
from dragoman.operators import blocks, inverted
from dragoman.operators import search as S

DOCS = [(i, t) for i, t in enumerate(
    ["red fox runs", "blue fox sleeps here", "red red wine", "fox", "the quick red fox", "nothing at all", "red fox runs"] * 3
)]
ASKS = [(10, "red fox"), (11, "wine wine"), (12, "missing"), (13, "the fox sleeps")]


def brute_bm25(k):
    toks = {i: t.split() for i, t in DOCS}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, text in ASKS:
        scored = []
        for i, t in toks.items():
            s = sum(
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w)
                / (t.count(w) + dims.BM25_K1 * (1 - dims.BM25_B + dims.BM25_B * len(t) / avg))
                for w in text.split() if w in df
            )
            if s > 0:
                scored.append((-round(s, 9), i))
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Blocks of two rows, so that every search runs over many of them."""
    whole = blocks.score_blocks

    def small(*args, **named):
        return whole(*args, **{**named, "per_item_block": 4, "per_query_block": 2})

    def on():
        monkeypatch.setattr(S, "score_blocks", small)

    return on


@pytest.mark.parametrize("block", [2, 256])
def test_bm25_matches_brute_force(spark, block, monkeypatch):
    docs = spark.createDataFrame([*DOCS, (99, None), (98, "")], "chunk_id long, text string").repartition(4)
    asks = spark.createDataFrame([*ASKS, (14, None)], "query_id long, text string")
    index = inverted.build_index(docs, S.plain_terms, block=block)
    assert index.blocks.filter(F.col("n") > block).count() == 0
    got = S.bm25_over(index, asks, 5).collect()
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == brute_bm25(5)


def test_bm25_skips_only_what_cannot_win(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.randrange(5, 60)))) for i in range(1500)]
    asks = [(q, " ".join(rng.choices(words, k=12))) for q in range(12)] + [(50, docs[3][1]), (51, "w0"), (52, "w0 w1 w299")]
    monkeypatch.setitem(globals(), "DOCS", docs)
    monkeypatch.setitem(globals(), "ASKS", asks)
    table = spark.createDataFrame(docs, "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame(asks, "query_id long, text string")
    index = inverted.build_index(table, S.plain_terms, block=16)
    got = S.bm25_over(index, queries, 10).collect()
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == brute_bm25(10)
    asked = inverted.asked_terms(index, queries, S.plain_terms)
    plan = inverted.planned(asked, inverted.thresholds(index, asked, 10))
    assert plan.filter("completes").count()  # frequent terms only complete scores
    pairs = inverted.candidates(index, plan, 10)
    assert pairs.count() < index.forward.count() * len(asks) / 3


def test_bm25_reads_a_stored_index(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "chunk_id long, text string")
    asks = spark.createDataFrame(ASKS, "query_id long, text string")
    inverted.build_index(docs, S.plain_terms, str(tmp_path / "index"))
    got = S.bm25_over(inverted.read_index(spark, str(tmp_path / "index")), asks, 5).collect()
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == brute_bm25(5)


def test_bm25_holds_no_pairs(spark, monkeypatch):
    """Copies of one text: a block of documents gives the best k of each query, whatever number of them ties."""
    docs = [(i, "red fox runs" if i % 3 else "blue fox") for i in range(1500)]
    asks = [(q, "red fox") for q in range(30)]
    monkeypatch.setitem(globals(), "DOCS", docs)
    monkeypatch.setitem(globals(), "ASKS", asks)
    monkeypatch.setattr(inverted, "ROWS", 7)
    monkeypatch.setattr(inverted, "WAITING", 100)
    table = spark.createDataFrame(docs, "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame(asks, "query_id long, text string")
    index = inverted.build_index(table, S.plain_terms)
    assert inverted.search(index, queries, 5, S.plain_terms).count() == 5 * len(asks)
    got = S.bm25_topk(table, queries, 5).collect()
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == brute_bm25(5)


@pytest.mark.parametrize(("columns", "cheaper"), [(2048, 1e9), (3, 50), (0, 0)])
def test_keywords_of_a_stream_are_exact(columns, cheaper, monkeypatch):
    """Scores by the product, by single postings and by both are those of a sum over the terms."""
    import pyarrow as pa

    monkeypatch.setattr(inverted, "COLUMNS", columns)
    monkeypatch.setattr(inverted, "CHEAPER", cheaper)
    monkeypatch.setattr(inverted, "ROWS", 4)
    rng = random.Random(3)
    docs = [sorted(rng.sample(range(40), rng.randrange(1, 12))) for _ in range(90)]
    asks = [{t: rng.random() for t in rng.sample(range(45), 6)} for _ in range(10)]
    kind = pa.list_(pa.struct([("term", pa.int64()), ("w", pa.float64())]))
    queries = pa.table({"query_id": range(10), "asked": pa.array([[{"term": t, "w": w} for t, w in a.items()] for a in asks], kind)})
    meets = inverted.Keywords(queries, 3, 5.0)
    for a in range(0, 90, 30):
        part = docs[a : a + 30]
        meets.add(pa.table({
            "chunk_id": range(a, a + 30), "dl": [2 * len(d) for d in part], "terms": pa.array(part, pa.list_(pa.int64())),
            "tfs": pa.array([[2] * len(d) for d in part], pa.list_(pa.int32())),
        }))
    want = []
    for q, ask in enumerate(asks):
        sums = [(-round(sum(ask.get(t, 0) * inverted.weight_of(2, 2 * len(d), 5.0) for t in d), 9), i) for i, d in enumerate(docs)]
        want += [(q, i, -s) for s, i in sorted(sums)[:3] if s < 0]
    got = meets.result().to_pydict()
    assert [(q, i, round(s, 9)) for q, i, s in zip(got["query_id"], got["chunk_id"], got["score"], strict=True)] == want


def test_vectors_ties_and_blocks(spark, tiny_blocks):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(60)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(9)], "query_id long, embedding array<double>")

    def best(**named):
        return [r.chunk_id for r in S.vector_topk(v, q, 4, **named).filter("query_id = 1").orderBy("rank").collect()]

    assert best() == [1, 2, 4, 5] and best(exclude_self=True) == [2, 4, 5, 7]
    few = S.vector_topk(v, q, 50, doc_filter=F.col("chunk_id") < 3)
    assert few.count() == 9 * 3
    tiny_blocks()
    assert best() == [1, 2, 4, 5] and best(exclude_self=True) == [2, 4, 5, 7]


def test_search_plan_collects_nothing(spark, sf):
    from dragoman.plans.q_search import as_queries, vectors

    v = vectors(spark, sf)
    plan = S.vector_topk(v, as_queries(v), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and "LogicalRDD" not in plan


def test_similarity(spark):
    df = spark.createDataFrame([(0.2,), (None,), (1.7,), (-0.5,)], "d double")
    assert [r[0] for r in df.select(S.similarity(F.col("d"))).collect()] == [0.8, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_approximate_search_finds_most_exact_neighbours(spark, folder):
    from dragoman.operators.embedding import vector_topk_approx
    from dragoman.plans.q_search import as_queries, vectors

    v = vectors(spark, f"/root/testdata/{folder}")
    q = as_queries(v)
    exact = S.vector_topk(v, q, 10).select("query_id", "chunk_id", "distance")
    near = vector_topk_approx(v, q, 10).select("query_id", "chunk_id", "distance").cache()
    assert near.count() == 10 * q.count()
    both = near.join(exact, ["query_id", "chunk_id"])
    assert both.count() / near.count() >= 0.95
    assert near.join(exact.withColumnRenamed("distance", "d"), ["query_id", "chunk_id"]).filter("abs(distance - d) > 1e-8").count() == 0


def test_vector_index_is_stored_and_widened(spark, tmp_path, monkeypatch):
    from dragoman.operators import ivf

    monkeypatch.setattr(ivf, "BLOCK", 16)
    rng = np.random.default_rng(3)
    near = rng.normal(size=(150, 16)) * 0.02 + np.eye(16)[0]  # a hot list
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([near, rng.normal(size=(60, 16))]))]
    rows += [(900, None), (901, [0.0] * 16)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    ivf.build(v, str(tmp_path / "ivf"), lists=9, parts=4)
    index = ivf.read(spark, str(tmp_path / "ivf"))
    q = spark.createDataFrame([(1, rows[0][1]), (2, rows[170][1]), (3, None)], "query_id long, embedding array<double>")
    # one list each is not enough for 200 results, so more are taken
    got = ivf.search(index, q, 200, probes=1).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(x, r) for x in (1, 2) for r in range(1, 201)]
    whole = S.vector_topk(v.filter("embedding IS NOT NULL"), q.filter("query_id < 3"), 5).collect()
    all_lists = ivf.search(index, q, 5, probes=9, pool=300).collect()
    assert sorted(map(str, all_lists)) == sorted(map(str, whole))


def test_vector_index_of_nothing(spark):
    from dragoman.operators import ivf

    with pytest.raises(ValueError):
        ivf.build(spark.createDataFrame([(1, None)], "chunk_id long, embedding array<double>"))


def test_blocks_of_either_side_are_bounded(spark):
    """A row is copied to a bounded number of tasks, however many rows there are."""

    class Pair:
        def __init__(self, queries):
            self.queries, self.items = queries, 0

        def add(self, items):
            self.items += len(items)

        def result(self):
            import pyarrow as pa

            return pa.RecordBatch.from_pydict({"queries": [len(self.queries)], "items": [self.items]})

    items = spark.range(900).withColumnRenamed("id", "chunk_id")
    asks = spark.range(700).withColumnRenamed("id", "query_id")
    got = blocks.score_blocks(items, asks, Pair, "queries long, items long", per_item_block=4, per_query_block=2).collect()
    assert len(got) <= blocks.SPREAD**2
    assert sum(r["queries"] * r["items"] for r in got) == 900 * 700
    more = blocks.score_blocks(items, asks, Pair, "queries long, items long", per_item_block=4, per_query_block=2, held=35).collect()
    assert max(r["queries"] for r in more) < 70 and sum(r["queries"] * r["items"] for r in more) == 900 * 700


def test_few_queries_meet_small_blocks_of_a_large_table(spark):
    """A task does not hold more items of a larger table, and the copies of the queries stay below the items."""

    class Held:
        def __init__(self, queries):
            self.queries, self.items = len(queries), 0

        def add(self, items):
            self.items += len(items)

        def result(self):
            import pyarrow as pa

            return pa.RecordBatch.from_pydict({"queries": [self.queries], "items": [self.items]})

    asks = spark.range(3).withColumnRenamed("id", "query_id")
    for n in (300, 1200):
        items = spark.range(n).withColumnRenamed("id", "chunk_id")
        got = blocks.score_blocks(items, asks, Held, "queries long, items long", per_item_block=10, per_query_block=64).collect()
        assert sum(r["items"] for r in got) == n and max(r["items"] for r in got) < 40
        assert sum(r["queries"] for r in got) <= n
    none = blocks.score_blocks(items, asks.filter("query_id < 0"), Held, "queries long, items long").collect()
    assert none == []


@pytest.mark.parametrize("exclude_self", [False, True])
def test_nearest_of_a_stream_is_exact(exclude_self):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16))
    x[100:140] = x[3]  # ties go by id
    x[200] = 0
    x[300:330] = x[5] * (1 + 1e-7 * rng.normal(size=(30, 16)))  # beyond single precision
    table = pa.table({"query_id": np.arange(700), "chunk_id": np.arange(700), "v": pa.array(x.tolist())})
    unit = S.units(table)
    whole = np.round(unit @ unit.T, 9)
    if exclude_self:
        np.fill_diagonal(whole, -9)
    nearest = S.Nearest(table, 7, exclude_self)
    for a in range(0, 700, 64):
        nearest.add(table.slice(a, 64))
    got = nearest.result().to_pandas().groupby("query_id")["chunk_id"].apply(list)
    assert [got[q] for q in range(700)] == [sorted(range(700), key=lambda i: (-whole[q, i], i))[:7] for q in range(700)]


def test_approximate_search_emits_bounded_pools():
    """A query's pool has a fixed size, however many lists it takes, and its cosines are exact."""
    import numpy as np
    import pyarrow as pa

    from dragoman.operators import ivf

    rng = np.random.default_rng(6)
    v = ivf.unit(rng.normal(size=(600, 16)))
    book = ivf.Codebook(v[:30].copy(), np.array([v[:256, 4 * p : 4 * p + 4] for p in range(4)]), np.zeros(0))
    lists = book.lists_of(v)
    book.sizes = np.bincount(lists, minlength=30)
    codes = book.encode(v, lists)
    order = np.argsort(lists, kind="stable")
    items = pa.table({"list": lists[order], "chunk_id": order, "code": pa.array([c.tobytes() for c in codes[order]]), "v": pa.array(v[order].tolist())})
    pools = ivf.Pools(book, pa.table({"query_id": np.arange(600), "v": pa.array(v.tolist())}), 30, 5, 20)
    for a in range(0, 600, 50):
        pools.add(items.slice(a, 50))
    got = pools.result().to_pandas()
    assert (got.groupby("query_id").size() == 20).all()
    assert np.allclose(got["product"], (v[got["query_id"]] * v[got["chunk_id"]]).sum(axis=1), atol=1e-12)
    coded = book.centroids[lists] + np.hstack([book.words[p][codes[:, p]] for p in range(4)])
    worst = got.groupby("query_id")["rough"].min()
    assert np.allclose(worst, np.sort(v @ coded.T, axis=1)[:, -20], atol=1e-5)


def test_hits_of_one_score_are_met_in_bounded_groups(monkeypatch):
    """However many items tie, few hits are sorted at a time, and ties go by id."""
    import pyarrow as pa

    monkeypatch.setattr(blocks.Parts, "HITS", 300)
    sizes, keep = [], blocks.Best.keep
    monkeypatch.setattr(blocks.Best, "keep", lambda self, row, *more: (sizes.append((len(row), len(np.unique(row)))), keep(self, row, *more))[1])
    table = pa.table({"query_id": np.arange(200), "chunk_id": np.arange(200)[::-1], "v": pa.array([[1.0, 2.0]] * 200)})
    nearest = S.Nearest(table, 3, False)
    for a in range(0, 200, 100):
        nearest.add(table.slice(a, 100))
    got = nearest.result().to_pandas().groupby("query_id")["chunk_id"].apply(list)
    assert all(got[q] == [0, 1, 2] for q in range(200))
    assert sum(n for n, _ in sizes) == 200 * 200 and all(n <= 300 or rows == 1 for n, rows in sizes)


def test_blocks_of_queries_in_rounds_give_the_same(spark, monkeypatch):
    """Many queries are gone through in rounds, so that few copies of the items lie on disk at a time; no row differs."""
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(120)], "chunk_id long, embedding array<double>")
    q = v.withColumnRenamed("chunk_id", "query_id").unionByName(v.limit(5).withColumnRenamed("chunk_id", "query_id"))
    docs = spark.createDataFrame(DOCS, "chunk_id long, text string")
    asks = spark.createDataFrame(ASKS, "query_id long, text string")

    def rows():
        return [sorted(map(str, df.collect())) for df in (S.vector_topk(v, q, 4, exclude_self=True), S.bm25_topk(docs, asks, 5))]

    whole, written, cut = rows(), [], blocks.cut
    monkeypatch.setattr(blocks, "cut", lambda df, label: (written.append(label), cut(df, label))[1])
    for module, name, value in ((blocks, "COPIED", 1), (inverted, "COPIED", 1), (inverted, "HELD", 1), (S, "score_blocks", lambda *a, **n: blocks.score_blocks(*a, **n, per_query_block=8))):
        monkeypatch.setattr(module, name, value)
    assert rows() == whole and written.count("blocks-best") == 12 + 3  # one query has no known term
    assert written.count("blocks-items") == 1  # the keyword index is stored already

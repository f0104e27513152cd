import hashlib
import random
import time

from dragoman.llm.runs import collapse, find_runs, periodic_runs, word_ids

from .conftest import words


def slow_runs(ws, least=12):
    """All runs by looking at each period on its own."""
    n, ends = len(ws), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and ws[i] == ws[i + q]:
                i += 1
            length = i - start + q
            if length >= max(2 * q, least):
                ends.setdefault((start, length), q)
    return sorted(((s, m, q) for (s, m), q in ends.items()), key=lambda r: (r[0], r[2]))


def slow_collapse(ws, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return [w for i, w in enumerate(ws) if i not in gone]


def test_random_words():
    rng = random.Random(2)
    for _ in range(1500):
        n, kinds, least = rng.randrange(1, 110), rng.choice([1, 2, 2, 3, 6]), rng.choice([2, 3, 5, 12, 12, 13])
        ws = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.6:
            a, p = rng.randrange(n), 1 + rng.randrange(n // 4 + 1)
            ws = [ws[i if i < a else a + (i - a) % p] for i in range(n)]
        got = find_runs(word_ids(ws), least)
        assert got == slow_runs(ws, least)
        assert collapse(ws, got) == slow_collapse(ws, got)


def test_nested_and_neighbouring_runs():
    ws = [b"x", *([b"a", b"a", b"b"] * 4), *([b"a"] * 20), b"y", *([b"c", b"d"] * 9), *([b"d", b"c"] * 9)]
    assert find_runs(word_ids(ws)) == slow_runs(ws)
    block = [b"%d" % i for i in range(30)] + [b"a"] * 15
    assert find_runs(word_ids(block * 3)) == slow_runs(block * 3)


def test_long_texts():
    rng = random.Random(6)
    began = time.time()
    assert find_runs(word_ids([b"same"] * 60_000)) == [(0, 60_000, 1)]
    assert find_runs(word_ids([b"%d" % (i % 7000) for i in range(60_000)])) == [(0, 60_000, 7000)]
    lines = [w for _ in range(8000) for w in (b"%d" % rng.randrange(10**6), *[b"p%d" % j for j in range(8)])]
    assert find_runs(word_ids(lines)) == []
    assert time.time() - began < 20


def test_awkward_rows(docs, awkward):
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect()), key=str)
    want = []
    for r in awkward:
        ws = words(r[1])
        runs = slow_runs(ws) if len(ws) < 2000 else find_runs(word_ids([w.encode() for w in ws]))
        want.append((r[0], len(ws), runs, " ".join(slow_collapse(ws, runs))))
    assert got == sorted(want, key=str)


def test_no_rows(empty):
    assert periodic_runs(empty).count() == 0


def test_query(spark):
    import zlib

    from dragoman.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    seen = 0
    for r in rows:
        ws, h = words(texts[r["doc_id"]]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(ws), h // 10
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = slow_runs(ws)
        seen += len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(slow_collapse(ws, runs)).encode()).hexdigest()
    assert seen

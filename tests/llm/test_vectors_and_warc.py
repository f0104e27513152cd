import base64
import glob
import gzip
import hashlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from dragoman.llm import neighbours, warc


def brute(rows, every, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v]
    fine = [(i, v / np.linalg.norm(v)) for i, v in fine if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in fine]), np.array([v for _, v in fine])
    out = {}
    for i, v in fine:
        if i % every == 0:
            s = np.round(x @ v, 12)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(a)) for a in rng.normal(size=8)]) for i in range(600)]
    same = rows[0][1]
    rows += [(600 + i, same) for i in range(300)]  # a third are equal
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [None] + [1.0] * 7), (1050, [float("nan")] * 8), (1100, [1.0] * 7), (None, same)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, list int, asks string")


def test_nearest(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "CHUNK", 4)
    got = {}
    for r in neighbours.nearest(frame(spark, vectors).repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(vectors, 50, 5)
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        hit += len({f[1] for f in found} & {w[0] for w in want[q]})
        score = dict((int(i), s) for i, s in want[q])
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in found if v in score)
    assert hit / (5 * len(want)) >= 0.9
    assert [f[1] for f in got[0]] == [600, 601, 602, 603, 604]  # ties go to the smaller id


def test_repeated_query_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "CHUNK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(a)) for a in rng.normal(size=8)]) for i in range(400)]
    other = [float(np.float32(a)) for a in rng.normal(size=8)]
    table = rows + [rows[0]] * 60 + [rows[100]] * 4 + [(50, other)] * 2
    got = {}
    for r in neighbours.nearest(frame(spark, table).repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, x = np.array([i for i, _ in table]), np.array([v / np.linalg.norm(v) for _, v in table])
    hit = total = 0
    for q in range(0, 400, 50):
        lists = []
        for v in [rows[q][1]] + ([other] if q == 50 else []):
            s = x @ (np.array(v) / np.linalg.norm(v))
            lists.append([(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:5])
        # every different query row has its five ranks
        assert sorted(g[0] for g in got[q]) == sorted(list(range(1, 6)) * len(lists)), q
        hit += sum((Counter(g[1] for g in got[q]) & Counter(i for w in lists for i, _ in w)).values())
        total += 5 * len(lists)
    assert hit / total >= 0.9


def test_few_vectors_besides_copies_of_the_query(spark):
    table = [(0, [1.0] * 8)] * 100 + [(i, [-1.0] * 7 + [float(i)]) for i in range(1, 8)]
    got = [(r.query_id, r["rank"]) for r in neighbours.nearest(frame(spark, table)).collect()]
    assert sorted(got) == [(0, i) for i in range(1, 6)]


def test_few_and_no_vectors(spark):
    few = [(0, [1.0] * 8), (1, [1.0] * 7 + [2.0]), (50, [-1.0] * 8)]
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(frame(spark, few)).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert neighbours.nearest(frame(spark, few[:0])).collect() == []
    assert neighbours.nearest(frame(spark, [(0, [0.0] * 8), (1, None)])).collect() == []


class Text(HTMLParser):
    """Slow reading of a page, tag by tag."""

    HIDDEN = {"script", "style", "noscript", "template", "title"}
    BLOCK = set("p div br hr li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav main aside blockquote pre form dt dd dl option td th".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        self.out.append("\n" if tag in self.BLOCK else " " if tag in self.HIDDEN else "")
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        self.out.append("\n" if tag in self.BLOCK else "")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_derivatives_of_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    records = warc.derive(warc.responses(pages)).collect()
    assert len(records) == 2 * pages.count()
    html = {r.page_id: r for r in pages.collect()}
    for r in records:
        page = html[r.key]
        reader = Text()
        reader.feed(page.html)
        reader.close()
        block = r.block.encode()
        assert r.content_length == len(block) and r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert r.source_digest == "sha1:" + base64.b32encode(hashlib.sha1(page.html.encode()).digest()).decode()
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.headers and r.record_id != r.refers_to
        if r.kind == "conversion":
            assert r.block.split() == "".join(reader.out).split()
        else:
            assert [x[9:] for x in r.block.split("\r\n") if x.startswith("outlink: ")] == [" ".join(x.split()) for x in reader.links]


def test_written_files_read_back(spark, tmp_path):
    rows = [(1, "http://a/", "<p>Hi &amp; <b>bye</b><br>x<script>1<2</script>"), (2, None, None), (None, "u", ""), (1, "http://a/", "<title>T\n t</title>\r\na < b")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, record_id string")
    records = warc.derive(warc.responses(pages))
    want = sorted((r.headers + r.block) for r in records.collect())
    warc.write(records, str(tmp_path / "out"))
    got = []
    for f in glob.glob(f"{tmp_path}/out/*.gz"):
        data = gzip.open(f).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")][0][16:])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            got.append((head + b"\r\n\r\n" + rest[:n]).decode())
            data = rest[n + 4 :]
    assert sorted(got) == want
    blocks = {(r.key, r.kind, r.block) for r in records.collect()}
    assert (1, "conversion", "Hi & bye\nx") in blocks and (2, "conversion", "") in blocks and (1, "conversion", "a < b") in blocks
    assert warc.derive(warc.responses(pages.limit(0))).collect() == []


@pytest.mark.parametrize("page", ["<a x" * 250_000, "<a " * 350_000 + ">", "<html " * 200_000, "<title" * 200_000, "<p <div" * 150_000, "<a href='x' " * 90_000, '<a href="x>' * 90_000])
def test_long_unclosed_markup(page):
    import time

    began = time.time()
    warc.metadata(page, "")
    warc.plain_text(page)
    assert time.time() - began < 10


def test_responses_without_key_and_url_are_told_apart(spark):
    pages = spark.createDataFrame([(None, None, "a"), (None, None, "b"), (None, None, None)], "page_id long, url string, html string")
    assert warc.responses(pages).select("record_id").distinct().count() == 3

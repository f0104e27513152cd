import re

import pytest
from pyspark.sql import functions as F

from dragoman.operators import chunking as K
from dragoman.plans.q_chunking import structured

TEXT = """Chapter 1 Admission
Applicants must hold a certificate. They send it by mail, early in the year.
- first item of a list, plain
- second item of a list, plain
3

menu
The office answers every question about the admission of students, and it is open on weekdays only.
"""


def blocks(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.kind, r.text, r.heading) for r in K.extract_blocks(df).orderBy("pos").collect()]


def test_blocks(spark):
    got = blocks(spark, TEXT)
    assert [b[0] for b in got] == ["heading", "paragraph", "list", "paragraph"]
    assert got[2][1] == "- first item of a list, plain\n- second item of a list, plain"
    assert {b[2] for b in got} == {"Chapter 1 Admission"}


def test_contextual_prefix_and_blank(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "  \n ")], "doc_id long, text string")
    got = {r.doc_id: r.chunks for r in K.chunk_document(df).collect()}
    assert got[2] == []
    assert all(c.startswith("Chapter 1 Admission\n") for c in got[1]) and got[1]
    plain = {r.doc_id: r.chunks for r in K.chunk_document(df, "structural").collect()}
    assert [c.split("\n", 1)[1] for c in got[1]] == plain[1]


def test_unknown_strategy_and_overlap(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    with pytest.raises(ValueError):
        K.chunk_document(df, "other")
    with pytest.raises(ValueError):
        K.chunk_char(F.col("text"), 100, 80)


@pytest.mark.parametrize("strategy", K.STRATEGIES)
def test_chunks_keep_to_the_text(spark, sf, strategy):
    d = structured(spark, sf)
    for r in K.chunk_document(d, strategy).select("text", "chunks").limit(60).collect():
        words = re.sub(r"\s+", "", r.text)
        for c in r.chunks:
            body = c.split("\n", 1)[1] if strategy == "contextual" and "\n" in c else c
            assert re.sub(r"\s+", "", body)[:40] in words


def test_short_document_is_kept_whole(spark):
    df = spark.createDataFrame([(1, "Dr. Ahmed Khalil, ext. 3042."), (2, "tiny")], "doc_id long, text string")
    got = {r.doc_id: r.chunks for r in K.chunk_corpus(df).collect()}
    assert got == {1: ["Dr. Ahmed Khalil, ext. 3042."], 2: []}

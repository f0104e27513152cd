import random
import time

import pytest
from tokenizers import Tokenizer

from dragoman.llm import token_counts
from dragoman.llm.queries import QUERIES
from dragoman.llm.token_counts import Counter, default_vocabulary, token_counts as counted


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(default_vocabulary())
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_awkward_rows(docs, awkward, library):
    out = counted(docs, limit=100)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), library(r[1]), library(r[1]) > 100) for r in awkward]
    assert got == sorted(want, key=str)


def test_no_rows(empty):
    assert counted(empty).count() == 0


def test_random_strings(library):
    rng, count = random.Random(3), Counter(default_vocabulary())
    signs = [*"abcdeABC İıΣσςßẞéÉȩ́ \t\n \u0085\x1c\x1f'.,!<|>0123٣½中文😀", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "İ.", " the", "ing"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        assert count.text(text) == library(text), text


def test_every_assigned_character(library):
    merges = token_counts.Merges(default_vocabulary())
    assert all(merges.piece(f"x{c}A") == library(f"x{c}A") for c in map(chr, [*range(0xD800), *range(0xE000, 0x1F000, 7)]))


def test_long_texts_are_counted_whole(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 50)
    monkeypatch.setattr(token_counts, "MEMO", 100)
    rng, count = random.Random(4), Counter(default_vocabulary())
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 90))) for _ in range(3000))
    assert count.text(text) == library(text) and len(count) <= 100
    began = time.time()
    assert count.text("ab" * 100_000) == library("ab" * 100_000)
    assert time.time() - began < 30


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError, TypeError)):
        Counter(public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark, library):
    rows = QUERIES["op13_token_counts"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_bytes"], r["n_tokens"]) == (len((texts[r["doc_id"]] or "").encode()), library(texts[r["doc_id"]]))
        assert r["over_limit"] == (r["n_tokens"] > 2048)

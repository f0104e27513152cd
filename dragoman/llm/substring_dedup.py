"""Removal of long passages that an earlier document has, by recompression.

Words are named by fingerprint, then rounds name runs of one symbol and pairs of symbols (``symbols.py``). A
pair is formed where a coin tossed by the symbols' names says so, hence equal passages are cut into the same
symbols, but for a few at their ends. Every window of ``window`` words is handed to one symbol border inside
it, the one with the smallest name among those that its own words decide; equal windows choose the same border.
Consecutive windows that choose one border make a group: one row holds the fingerprint of the words around the
border (its symbol) and of all words that the windows cover (its context).

1. Symbols held by one document only cannot repeat; they go in one aggregation.
2. For shared symbols, the smallest document of each context is kept; in any other document of the context all
   windows of the group repeat.
3. Where a symbol has several contexts, the windows of each context's smallest document, at every place where it
   has the context, are fingerprinted one by one and compared the same way.

Results equal the window definition, up to collisions of two independent 64-bit fingerprints. All
aggregations are minima, so a passage that a third of the documents share is reduced before it is shuffled;
joins against them can be split. No group is collected but the ranges of one document.

Null text has no words. Windows of rows that share an id do not count as repeats of one another. Repeated
rows each get a row. Null ids come last in order. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dragoman.llm.common import cut
from dragoman.llm.symbols import NONE, Rolling, U, Words, anchors, slices

WINDOW = 50
ROUNDS = 3
#: How far from a border the words that decide it may lie (3 rounds without runs need 14).
REACH = 14
LAST_ID = (1 << 63) - 1

GROUPS = "symbol long, context long, doc long, tag long, range long"


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _window_groups(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """start (word), count, symbol, context of groups of consecutive windows, and the text each is in."""
    hashes, first = words.hashes, words.first
    n, count = len(hashes), len(hashes) - window + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) * 2 + (np.zeros(0, np.int64),)
    sizes = np.diff(first)
    turns = np.zeros(n + 1, np.int64)
    long = sizes >= window
    np.add.at(turns, first[:-1][long], 1)
    np.add.at(turns, first[1:][long] - window + 1, -1)
    valid = np.cumsum(turns)[:count] > 0
    # the smallest name among the borders in the middle of each window, the leftmost of equal ones
    at, name, reach = anchors(hashes, first, ROUNDS)
    ranked = np.full(n + 1, NONE)
    fit = reach <= REACH
    ranked[at[fit]] = (name[fit] & U(0xFFFFFFFF00000000)) | at[fit].astype(U)
    best, width, span = ranked[REACH : n + 1], 1, window - 2 * REACH + 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[: len(best) - (span - width)], best[span - width :])[:count]
    one, two = Rolling(hashes, 1), Rolling(hashes, 2)
    free = best == NONE  # no border, as in long runs of one word: such windows are named by their own words
    key = best.copy()
    loose = np.flatnonzero(free & valid)
    key[loose] = one.of(loose, loose + window)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (key[1:] != key[:-1]) | (free[1:] != free[:-1])
    starts_doc = first[:-1][long]
    new[starts_doc] = True
    start = np.flatnonzero(new)
    if not len(start):
        return (start,) * 2 + (np.zeros(0, U),) * 2 + (start,)
    size = np.bincount(np.cumsum(new)[valid] - 1, minlength=len(start))
    lone = free[start]
    border = np.where(lone, 0, best[start] & U(0xFFFFFFFF)).astype(np.int64)
    stop = np.where(lone, start + window, start + size - 1 + window)
    symbol = one.of(np.where(lone, start, border - REACH), np.where(lone, start + window, border + REACH))
    shape = np.where(lone, 0, (border - start) * 4096 + size).astype(U)
    context = two.of(start, stop) + shape * U(0x9E3779B97F4A7C15)
    return start, size, symbol, context, np.searchsorted(first, start, "right") - 1


def _groups(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                words = Words(part.column(2))
                start, size, symbol, context, text = _window_groups(words, window)
                doc, tag = np.asarray(part.column(0)), np.asarray(part.column(1))
                spread = ((start - words.first[text]) << 32) | size
                yield pa.RecordBatch.from_arrays([_i64(symbol), _i64(context), _i64(doc[text]), _i64(tag[text]), _i64(spread)], ["symbol", "context", "doc", "tag", "range"])

    return run


def _windows(window: int):
    """Fingerprints of the single windows asked for, by (doc, tag, text, list of (at, n))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                words = Words(part.column(2))
                one, two = Rolling(words.hashes, 1), Rolling(words.hashes, 2)
                lists = part.column(3)
                edges = np.asarray(lists.offsets)
                asked = lists.values
                a, n = np.asarray(asked.field("at"))[edges[0] : edges[-1]], np.asarray(asked.field("n"))[edges[0] : edges[-1]]
                text = np.repeat(np.arange(len(part)), np.diff(edges))
                start = np.repeat(words.first[text] + a, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                text = np.repeat(text, n)
                doc, tag = np.asarray(part.column(0)), np.asarray(part.column(1))
                spread = ((start - words.first[text]) << 32) | 1
                yield pa.RecordBatch.from_arrays(
                    [_i64(one.of(start, start + window)), _i64(two.of(start, start + window)), _i64(doc[text]), _i64(tag[text]), _i64(spread)],
                    ["h1", "h2", "doc", "tag", "range"],
                )

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words, rows = Words(part.column(1)), ([], [], [])
                for d, ranges in enumerate(part.column(2).to_pylist()):
                    count, keep = int(words.first[d + 1] - words.first[d]), None
                    if ranges:
                        turns = np.zeros(count + 1, np.int64)
                        np.add.at(turns, [r["at"] for r in ranges], 1)
                        np.add.at(turns, [r["at"] + r["n"] - 1 + window for r in ranges], -1)
                        keep = np.cumsum(turns)[:count] == 0
                    text = words.text(d, keep)
                    rows[0].append(count)
                    rows[1].append(0 if keep is None else count - int(keep.sum()))
                    rows[2].append((hashlib.sha256(text).hexdigest(), text.decode()))
                digests, texts = zip(*rows[2], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(digests), pa.array(texts)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """doc (never null), tag (tells rows apart that share an id), text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("tag"),
        text.alias("text"), F.col("doc_id"),
    )


def _places(rows: DataFrame) -> DataFrame:
    at, n = F.shiftright("range", 32).cast("int"), F.col("range").bitwiseAND(0xFFFFFFFF).cast("int")
    return rows.select("doc", "tag", F.struct(at.alias("at"), n.alias("n")).alias("range"))


def _per_document(rows: DataFrame) -> DataFrame:
    """One row per document with its ranges; they are no more than the document's words."""
    return _places(rows).groupBy(F.col("doc").alias("r_doc"), F.col("tag").alias("r_tag")).agg(F.collect_list("range").alias("ranges"))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, tag, range: runs of windows whose words also start in a smaller document (range: first word and number)."""
    texts = _texts(docs)
    groups = cut(texts.select("doc", "tag", "text").mapInArrow(_groups(window), GROUPS), "repeat-groups")
    symbols = groups.groupBy(F.col("symbol").alias("s_symbol")).agg(
        F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("context").alias("c_lo"), F.max("context").alias("c_hi")
    )
    # both sides of this join, and of those below, are plain tables: a symbol held everywhere can then be split
    shared = cut(symbols.filter("lo < hi").select("s_symbol", "lo", (F.col("c_lo") == F.col("c_hi")).alias("single")), "repeat-symbols")
    rows = groups.join(shared, F.col("symbol") == F.col("s_symbol")).drop("s_symbol")
    rows = cut(rows, "repeat-shared")
    plain = rows.filter("single AND doc > lo").select("doc", "tag", "range")
    several = rows.filter("NOT single").drop("lo", "single")
    first = several.groupBy(F.col("symbol").alias("f_symbol"), F.col("context").alias("f_context")).agg(
        F.min(F.struct("doc", "tag", "range")).alias("first"), F.max("doc").alias("last"),
        F.max(F.struct(F.bitwise_not("doc").alias("doc"), "tag", "range")).alias("end"),  # the last place in the first document
    )
    first = cut(first, "repeat-contexts")
    again = first.filter("last > first.doc").select("f_symbol", "f_context", F.col("first.doc").alias("f_doc"))
    later = several.join(again, (F.col("symbol") == F.col("f_symbol")) & (F.col("context") == F.col("f_context"))).filter("doc > f_doc")
    # further places of a context in its first document, which may repeat other contexts of earlier documents
    inside = first.filter("end.tag <> first.tag OR end.range <> first.range").select("f_symbol", "f_context", F.col("first.doc").alias("f_doc"), "first")
    inside = cut(inside, "repeat-inside")
    same = (F.col("symbol") == F.col("f_symbol")) & (F.col("context") == F.col("f_context")) & (F.col("doc") == F.col("f_doc"))
    more = several.join(inside, same).filter("tag <> first.tag OR range <> first.range").select("doc", "tag", "range")
    asked = _per_document(first.select("first.*").unionAll(more))
    wanted = texts.join(asked, (F.col("doc") == F.col("r_doc")) & (F.col("tag") == F.col("r_tag")))
    single = cut(wanted.select("doc", "tag", "text", "ranges").mapInArrow(_windows(window), "h1 long, h2 long, doc long, tag long, range long"), "repeat-windows")
    earliest = single.groupBy(F.col("h1").alias("w1"), F.col("h2").alias("w2")).agg(F.min("doc").alias("w_lo"), F.max("doc").alias("w_hi"))
    earliest = cut(earliest.filter("w_lo < w_hi").drop("w_hi"), "repeat-earliest")
    inner = single.join(earliest, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))).filter("doc > w_lo")
    return plain.unionAll(later.select("doc", "tag", "range")).unionAll(inner.select("doc", "tag", "range"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row of ``docs``."""
    found = _per_document(repeats(docs, window))
    texts = _texts(docs)
    joined = texts.join(found, (F.col("doc") == F.col("r_doc")) & (F.col("tag") == F.col("r_tag")), "left")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return joined.select("doc_id", "text", "ranges").mapInArrow(_kept(window), schema)

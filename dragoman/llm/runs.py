"""Periodic runs of words: every stretch in which a passage is said over and over, with its period.

A run is a stretch of consecutive words with smallest period q, at least twice as long as q and at least ``least`` words,
that no neighbouring word extends. Two equal word sequences, q places apart and at least q words long, cannot be
made longer on either side exactly if they are such a stretch: the maximal pairs whose distance is at most their length are
the runs (and the runs at multiples of their period, which are told by their equal ends), and nothing is extended.

Maximal pairs come from the tree of LCP intervals over the suffixes of the words. Only suffixes whose first ``least / 2``
words occur twice can begin a pair, so only these are sorted; their ranks come from prefix doubling, in the order of the
words' first places, and the ranks of all lengths give the common prefixes. The intervals are joined bottom-up. Each
keeps the places of its suffixes in order, and which of them follow a place of another left word: the places of one
left word are so passed over together, and only places no farther apart than the common prefix are looked at. Of two
intervals the smaller one's places are looked up in the larger one, so a place moves at most log n times.

A document stays in its row; Spark deals the documents to the tasks, nothing is shuffled, and a worker holds one
document's tables at a time, whose size is linear in its words, times the logarithm of its longest repeat.

A null text has no words. Rows that share an id, or are equal, are searched one by one. An empty table gives no
rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 12


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers of words by first place, from 1."""
    number = dict.fromkeys(words)
    number = dict(zip(number, range(1, len(number) + 1), strict=True))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _ranks(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, bool]:
    """Dense ranks of pairs from 1, and whether any occurs twice."""
    key = first * (int(second.max()) + 1) + second
    order = np.argsort(key, kind="stable")
    held = key[order]
    new = np.empty(len(key), bool)
    new[0] = True
    np.not_equal(held[1:], held[:-1], out=new[1:])
    ranks = np.empty(len(key), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks, int(ranks[order[-1]]) < len(key)


def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    """Ranks ``by`` places on; 0 behind the end."""
    out = np.zeros(len(ranks), np.int64)
    if by < len(ranks):
        out[:-by] = ranks[by:]
    return out


class Places:
    """Suffixes of an LCP interval: their places in order, and the heads among them, whose next smaller place follows
    another word."""

    __slots__ = ("every", "heads")

    def __init__(self, place: int):
        self.every, self.heads = [place], [place]

    def add(self, place: int, left: list[int]) -> None:
        at = bisect_left(self.every, place)
        mine = left[place]
        if at == 0 or left[self.every[at - 1]] != mine:
            insort(self.heads, place)
        if at < len(self.every):
            after = self.every[at]
            was = at == 0 or left[self.every[at - 1]] != left[after]
            now = left[after] != mine
            if was and not now:
                del self.heads[bisect_left(self.heads, after)]
            elif now and not was:
                insort(self.heads, after)
        self.every.insert(at, place)

    def others(self, place: int, reach: int, left: list[int]) -> Iterator[int]:
        """Places within reach that follow another word than ``place`` does."""
        every, heads, mine = self.every, self.heads, left[place]
        at, end = bisect_left(every, place - reach), bisect_right(every, place + reach)
        if at == end:
            return
        head = bisect_right(heads, every[at])  # the head after the one that the first place belongs to
        while at < end:
            stop = bisect_left(every, heads[head], at, end) if head < len(heads) else end
            if left[every[at]] != mine:
                yield from every[at:stop]
            at, head = stop, head + 1


def maximal_pairs(ids: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(place, distance, length) of maximal pairs of equal sequences with distance <= length and distance + length >=
    ``least``."""
    n, base = len(ids), -(-least // 2)
    if n < max(least, 2):
        return
    # ranks of all sequences of 1, 2, 4, ..., `base` words (the last two overlap), then of twice as many again and again
    tables: list[tuple[int, np.ndarray]] = [(1, ids)]
    length, ranks, repeated = 1, ids, True
    while length < base and repeated:
        step = min(length, base - length)
        ranks, repeated = _ranks(ranks, _shifted(ranks, step))
        length += step
        tables.append((length, ranks.astype(np.int32)))
    if not repeated:
        return
    counts = np.bincount(ranks)
    begins = np.flatnonzero(counts[ranks] > 1)
    while repeated and length < n:
        ranks, repeated = _ranks(ranks, _shifted(ranks, length))
        length *= 2
        if repeated:
            tables.append((length, ranks.astype(np.int32)))
    order = begins[np.argsort(ranks[begins], kind="stable")]
    common = _common(order[:-1], order[1:], tables, n)
    yield from _joined(order.tolist(), common.tolist(), [-1, *ids[:-1].tolist()], base, least)


def _common(a: np.ndarray, b: np.ndarray, tables: list[tuple[int, np.ndarray]], n: int) -> np.ndarray:
    """Lengths of common prefixes of the suffixes at a and at b."""
    out = np.zeros(len(a), np.int64)
    for length, ranks in reversed(tables):  # none is more than twice the next, and no prefix is twice the largest
        x, y = a + out, b + out
        same = (x < n) & (y < n)
        same[same] = ranks[x[same]] == ranks[y[same]]
        out[same] += length
    return out


def _joined(order: list[int], common: list[int], left: list[int], base: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Bottom-up over the intervals; what is on the stack is joined with its left neighbour once no longer prefix follows."""
    stack: list[Places] = []
    bounds: list[int] = []  # common prefix with the left neighbour

    def join() -> Iterator[tuple[int, int, int]]:
        right, reach = stack.pop(), bounds.pop()
        larger = stack[-1]
        if len(larger.every) < len(right.every):
            larger, right = right, larger
        for place in right.every:
            for other in larger.others(place, reach, left):
                gap = abs(place - other)
                if gap + reach >= least:
                    yield min(place, other), gap, reach
        for place in right.every:
            larger.add(place, left)
        stack[-1] = larger

    for i, place in enumerate(order):
        bound = common[i - 1] if i else 0
        while len(stack) > 1 and bounds[-1] > bound:
            yield from join()
        if bound < base:
            stack, bounds = [], []  # all joined: every bound left was larger
        if stack:
            bounds.append(bound)
        stack.append(Places(place))
    while len(stack) > 1:
        yield from join()


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    period: dict[tuple[int, int], int] = {}
    for start, gap, length in maximal_pairs(ids, least):
        key = start, gap + length
        period[key] = min(gap, period.get(key, gap))
    return sorted(((s, n, q) for (s, n), q in period.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run repeats."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _search(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        names = ["doc_id", "n_words", "runs", "collapsed"]
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                n, found, kept = [], [], []
                for text in some.column(1):
                    words = (text.as_py() or "").encode("utf-8", "replace").split()
                    runs = find_runs(word_ids(words), least) if words else []
                    n.append(len(words))
                    found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                    kept.append(b" ".join(collapse(words, runs)).decode())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(kept, pa.string())], names)

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text without what its runs
    repeat, words joined by one blank."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(_search(least), schema)

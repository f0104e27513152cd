"""Mixture-controlled packing: every sequence takes tokens from all source queues in target proportions.

The documents of a source form its queue. Sequences are filled by deficit round-robin: what a source is owed
after a number of tokens is its share of them, what it got less than that is carried to the next sequence. The
carry has a closed form, so no task waits for another: the first N tokens of the whole stream hold C(s, N)
tokens of source s, where C splits N down a binary tree over the sources, the left side of each node getting
floor(N * left / both). C never decreases, its parts add up to N, and at the end every queue is used up. A
partition cuts its own documents at the sequences' borders, whatever the other partitions do.

The target proportions are the sources' shares of all tokens (after a mixing stage these are its targets), so
that every document is packed and the queues end together. All sequences but the last are full.

A null text is empty and still gives its final token. Null is a source of its own. Rows that share an id are
packed apart. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.llm.common import cut

LENGTH = 4096
END_ID = 2
#: Pieces of which a worker keeps the ids (twice that at most, while old ones are still used).
MEMO = 600_000
#: Bytes of text that are encoded at a time.
TEXTS = 8 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Pieces whose lower case and composition are plain: ASCII and the accented letters up to U+00FF; their words in lower case.
PLAIN = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]*")
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ÿ]+")


def by_words(path: str) -> bool:
    """Whether a tokenizer drops white space, folds case and encodes each word on its own, as ``Encoder`` assumes of words."""
    with open(path, encoding="utf-8") as f:
        book = json.load(f)
    steps = ((book.get("normalizer") or {}).get("normalizers")) or []
    cuts = ((book.get("pre_tokenizer") or {}).get("pretokenizers")) or []
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["invert"] and cuts[0]["pattern"] == {"Regex": pattern} and not cuts[1]["add_prefix_space"]
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in book["added_tokens"])
    )


class Encoder:
    """Token ids of texts as little-endian integers.

    A tokenizer that drops white space and never joins across it gives a text the ids of its pieces between plain spaces
    and line ends. Pieces are looked up. A new one in plain letters is cut into its words in lower case, which have a memo of
    their own; any other, and any that may hold a special token, is encoded as it stands. Of the pieces looked up, those used
    since the last turn of the memo are kept. With any other tokenizer whole texts are encoded.
    """

    def __init__(self, path: str, width: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.width, self.by_words = Tokenizer.from_file(path), width, by_words(path)
        # the same merges for words that are in lower case and cut already
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo, self.before = {"": b""}, {}
        self.words: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: list[str]) -> None:
        """A word of letters is one word, whose last id is a word's end: such words are encoded as one text and cut at the
        ends. Should these not add up, as with any other word, each is encoded alone."""
        plain = [w for w in words if w.isalpha()]
        if plain:
            ids = np.array(self.merges.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, self.width)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(plain):
                raw, edges = ids.tobytes(), [0, *(stops * ids.itemsize).tolist()]
                self.words.update(zip(plain, map(raw.__getitem__, map(slice, edges[:-1], edges[1:])), strict=True))
        rest = [w for w in words if w not in self.words]
        self.words.update(zip(rest, self._alone(rest), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        memo, before, plain, find = self.memo, self.before, PLAIN.fullmatch, PLAIN_WORD.findall
        new = [w for w in pieces if w not in before] if before else pieces
        if len(new) < len(pieces):
            memo.update((w, before[w]) for w in pieces if w in before)
        single, cut_up, whole = {}, {}, []
        # lower case of all at once; that of the pieces in plain letters does not depend on their neighbours
        lower = "\n".join(new).lower().split("\n") if new else []
        for w, low in zip(new, lower, strict=True):
            if not (w.isascii() or plain(w)) or "<|" in w:
                whole.append(w)
            elif low.isalpha():
                single[w] = low
            else:
                cut_up[w] = find(low)
        if len(self.words) > MEMO:
            self.words = {}
        self._of_words(list(filterfalse(self.words.__contains__, {*single.values(), *chain.from_iterable(cut_up.values())})))
        known = self.words.__getitem__
        memo.update(zip(single, map(known, single.values()), strict=True))
        for w, words in cut_up.items():
            memo[w] = known(words[0]) if len(words) == 1 else b"".join(map(known, words))
        memo.update(zip(whole, self._alone(whole), strict=True))

    def flat(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and the number of ids of each."""
        if not self.by_words:
            ids = self._alone(texts.to_pylist())
            return np.frombuffer(b"".join(ids), self.width), np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.width).itemsize
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[0] == offsets[-1]:
            return np.empty(0, self.width), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy()
        raw[raw == 10] = 32
        offsets = offsets - offsets[0]
        # a piece ends behind its space, and where its text ends
        stop = raw == 32
        stop[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
        edges = np.concatenate(([0], np.flatnonzero(stop) + 1)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(raw)).dictionary_encode()
        names = pc.ascii_rtrim(pieces.dictionary, " ").to_pylist()
        if len(self.memo) > MEMO:
            self.memo, self.before = {"": b""}, self.memo
        found = list(map(self.memo.get, names))
        self._learn(list({w for w, ids in zip(names, found, strict=True) if ids is None}))
        found = [self.memo[w] if ids is None else ids for w, ids in zip(names, found, strict=True)]
        book = np.frombuffer(b"".join(found), self.width)
        size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.width).itemsize
        which = pieces.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[which] - (ends - n), n)
        at += np.arange(len(at))
        upto = np.concatenate(([0], ends))[np.searchsorted(edges, offsets)]
        return book[at], np.diff(upto)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, n = self.flat(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        return [ids[a:b].tobytes() for a, b in zip(ends - n, ends, strict=True)]


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, width: str) -> Encoder:
    """The worker's encoder: what one task has learnt serves the next."""
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most ``TEXTS`` bytes, or of one row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    a, held = 0, 0
    for b, n in enumerate(size.tolist()):
        if held + n > TEXTS and b > a:
            yield a, b
            a, held = b, 0
        held += n
    if a < len(size):
        yield a, len(size)


def _tokenize(path: str, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, queued = _encoder(path, width), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for a, b in _slices(batch.column(2)):
                some = batch.slice(a, b - a)
                ids, n = encoder.flat(some.column(2).cast(pa.string()).fill_null(""))
                ids, n = np.insert(ids, np.cumsum(n), END_ID), n + 1
                ends = np.concatenate(([0], np.cumsum(n))) * ids.itemsize
                inside = []
                for source, tokens in zip(some.column(1).to_pylist(), n.tolist(), strict=True):
                    inside.append(queued[source])
                    queued[source] += tokens
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), some.column(1), pa.array(np.full(len(n), part, np.int64)), pa.array(inside, pa.int64()), pa.array(n),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary()),
                    ],
                    ["doc_id", "source", "part", "inside", "n", "ids"],
                )

    return run


class Stream:
    """Where the tokens of each source lie in the whole stream; ``totals`` in source order."""

    def __init__(self, totals: list[int]):
        self.sums = [0]
        for t in totals:
            self.sums.append(self.sums[-1] + t)
        self.total = self.sums[-1]

    def taken(self, s: int, n: int) -> tuple[int, int]:
        """Of the first n tokens: those of sources before s, and those of s."""
        lo, hi, before, sums = 0, len(self.sums) - 1, 0, self.sums
        while hi - lo > 1:
            mid = (lo + hi) // 2
            whole = sums[hi] - sums[lo]
            left = n * (sums[mid] - sums[lo]) // whole if whole else 0
            if s < mid:
                hi, n = mid, left
            else:
                lo, n, before = mid, n - left, before + left
        return before, n

    def sequence_of(self, s: int, position: int, length: int) -> int:
        """The sequence that holds the token at a position of the queue of s."""
        lo, hi = 0, (self.total - 1) // length
        own = self.sums[s + 1] - self.sums[s]
        guess = min(max(position * self.total // own // length, lo), hi)
        step = 1
        while self.taken(s, guess * length)[1] > position:
            guess, step = max(lo, guess - step), step * 2
        lo, step = guess, 1
        while self.taken(s, min((lo + step) * length, self.total))[1] <= position:
            lo, step = lo + step, step * 2
        hi = lo + step
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if self.taken(s, mid * length)[1] <= position:
                lo = mid
            else:
                hi = mid
        return lo


def _cut(totals: list[tuple[str | None, int]], length: int, width: str):
    order = {source: i for i, (source, _) in enumerate(totals)}
    counts = [n for _, n in totals]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(counts)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        at, edges = None, None  # source and sequence last looked at, with what the sequence holds of it
        for batch in batches:
            out: list[list] = [[] for _ in names[1:-1]]
            rows: list[int] = []
            sources, starts, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for r, (source, queued) in enumerate(zip(sources, starts, strict=True)):
                tokens = np.frombuffer(ids[r].as_buffer(), width).astype("<u4")
                s, n, done = order[source], len(tokens), 0
                while done < n:
                    position = queued + done
                    if edges is None or at[0] != s or not edges[1] <= position < edges[3]:
                        q = at[1] + 1 if edges is not None and at[0] == s and position == edges[3] else stream.sequence_of(s, position, length)
                        before, here = stream.taken(s, q * length)
                        before_next, upto = stream.taken(s, min((q + 1) * length, stream.total))
                        at, edges = (s, q), (before, here, before_next, upto)
                        if not here <= position < upto:
                            edges = None
                            at = None
                            continue
                    take = min(n - done, edges[3] - position)
                    piece = tokens[done : done + take]
                    rows.append(r)
                    for column, value in zip(out, (done, take, zlib.crc32(piece.tobytes()), n, at[1], edges[2] - edges[0] + position - edges[1]), strict=True):
                        column.append(value)
                    done += take
            picked = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), *[pa.array(c, pa.int64()) for c in out], batch.column(1).take(picked)], names
            )

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Tokens are written once with the task they come from and, per source, the tokens before them in that task; a queue
    is ordered by task and place. Only one total per task and source is joined to the rows. ``tokenizer`` may be any file
    of the tokenizers library.
    """
    path = tokenizer or default_tokenizer()
    from tokenizers import Tokenizer

    width = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 65536 else "<u4"
    kind = dict(docs.dtypes)["doc_id"]
    tokens = docs.select("doc_id", F.col("source").cast("string"), "text").mapInArrow(
        _tokenize(path, width), f"doc_id {kind}, source string, part long, inside long, n long, ids binary"
    )
    tokens = cut(tokens, "pack-tokens")
    blocks = tokens.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    blocks = cut(blocks, "pack-blocks")
    # one number per source, however many documents there are
    totals = [(r["source"], r["tokens"]) for r in blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()]
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    bases = blocks.select(
        F.col("source").alias("b_source"), F.col("part").alias("b_part"),
        F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    queued = tokens.join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part")))
    queued = queued.select("doc_id", "source", (F.col("inside") + F.col("base")).alias("queued"), "ids")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return queued.mapInArrow(_cut(totals, length, width), schema)

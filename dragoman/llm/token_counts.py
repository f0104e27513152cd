"""Token counts of texts by byte-pair merging, without making the tokens.

A word starts as one symbol per byte. A heap holds the adjacent pairs that the vocabulary can merge, lowest rank
first, leftmost among equals; symbols are a linked list, so a merge touches its two neighbours only and pushes the
two pairs it makes. An entry whose pair has gone is passed over. The count is the number of bytes less the number
of merges. No identifiers are emitted and no text is cut, padded or truncated.

Words never cross white space, so a text's count is the sum over its pieces between blanks and line ends; pieces are
looked up in a bounded memo that the worker keeps from task to task. Special strings of the vocabulary file count one
token each, found in the raw text, as its library does by default. Code points that Python's Unicode tables leave
unassigned keep their case, also where the library's tables fold a dozen of them.

A null text is empty and has no bytes and no tokens. Rows that share an id, or are equal, are counted one by one.
An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
#: Pieces and words of which a worker keeps the counts; longer ones than this are counted each time.
MEMO, LONGEST = 400_000, 64
#: Characters of a text that are split at once.
STRETCH = 1 << 20
#: Capitals that Python's tables do not have yet.
NEWER = {0xA7CB: 0x264, 0xA7DC: 0x19B}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _characters_of_bytes() -> list[str]:
    """Byte-level vocabularies write a byte as the character of its number if that is printable, the other bytes in
    order as the characters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Merges:
    """Ranked pairs of a byte-level vocabulary with a suffix for the ends of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            book = json.load(f)
        model, steps, pieces = book["model"], book["normalizer"]["normalizers"], book["pre_tokenizer"]["pretokenizers"]
        if (
            model["type"] != "BPE" or model["unk_token"] or model["dropout"] or model["ignore_merges"]
            or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]
            or [p["type"] for p in pieces] != ["Split", "ByteLevel"] or not pieces[0]["invert"] or pieces[1]["use_regex"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in book["added_tokens"])
        ):
            raise ValueError(f"{path}: not a byte-level vocabulary of lower-case words")
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        signs = _characters_of_bytes()
        self.inner = [vocabulary[c] for c in signs]
        self.final = [vocabulary[c + end] for c in signs]
        self.base = len(vocabulary)
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank[vocabulary[a] * self.base + vocabulary[b]] = rank
            self.made.append(vocabulary[a + b])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(book["added_tokens"], key=lambda t: -len(t["content"]))))
        self.words = regex.compile(pieces[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.known: dict[str, int] = {}

    def word(self, raw: bytes) -> int:
        """Symbols that are left of one word."""
        n, rank, made, base = len(raw), self.rank, self.made, self.base
        if n < 2:
            return n
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.final[raw[-1]]
        following = [*range(1, n), -1]
        preceding = [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(symbol[i] * base + symbol[i + 1])) is not None]
        heapify(heap)
        left = n
        while heap:
            r, i = heappop(heap)
            j = following[i]
            if j < 0 or symbol[i] < 0:
                continue
            now = rank.get(symbol[i] * base + symbol[j])
            if now is None or made[now] != made[r]:
                continue  # a neighbour was merged meanwhile
            symbol[i], symbol[j] = made[r], -1
            following[i] = k = following[j]
            left -= 1
            if k >= 0:
                preceding[k] = i
                if (x := rank.get(symbol[i] * base + symbol[k])) is not None:
                    heappush(heap, (x, i))
            h = preceding[i]
            if h >= 0 and (x := rank.get(symbol[h] * base + symbol[i])) is not None:
                heappush(heap, (x, h))
        return left

    def piece(self, text: str) -> int:
        """Tokens of a stretch without blanks: special strings, and between them the words of the normalised text."""
        if "<" in text and self.special.search(text):
            between = self.special.split(text)
            return len(between) - 1 + sum(map(self.piece, between))
        if not text.isascii():
            # one character at a time: a final sigma is not told apart
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(NEWER)
        return sum(map(self.remembered, self.words.findall(text.lower())))

    def remembered(self, word: str) -> int:
        """Words recur behind other punctuation and in other case, so they have a memo of their own."""
        n = self.known.get(word)
        if n is None:
            n = self.word(word.encode("utf-8", "replace"))
            if len(word) <= LONGEST:
                if len(self.known) >= MEMO:
                    self.known.clear()
                self.known[word] = n
        return n


class Counter(dict):
    """Tokens by piece; the memo starts anew when it is full."""

    def __init__(self, path: str):
        super().__init__()
        self.merges = Merges(path)

    def __missing__(self, piece: str) -> int:
        n = self.merges.piece(piece)
        if len(piece) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n

    def text(self, text: str) -> int:
        total, at = 0, 0
        while at < len(text):
            # a stretch ends at a blank, so that no word is cut
            to = len(text) if len(text) - at <= STRETCH else text.find(" ", at + STRETCH)
            to = len(text) if to < 0 else to
            total += sum(map(self.__getitem__, text[at:to].replace("\n", " ").split(" ")))
            at = to
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter: what one task has counted serves the next."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).text
        for batch in batches:
            n = [count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    ``vocabulary`` is the path of a vocabulary file that every worker can read. Counting needs no shuffle.
    """
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    counted = rows.mapInArrow(_count(vocabulary or default_vocabulary()), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

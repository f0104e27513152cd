"""Recompression of word sequences in numpy: words become symbols, rounds of run and pair naming shorten them.

Names are fingerprints of what they stand for, so every task gives a run or pair the same name without a
shared dictionary. All arrays cover the texts of one slice of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers of the rolling hashes (bytes, words, words) and of the mixer.
BASES = tuple(U(x) for x in (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
NONE = U(0xFFFFFFFFFFFFFFFF)
#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U) * BASES[0])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        base = int(BASES[which])
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = tuple(both)
        if size <= 4 * SLICE_BYTES:
            _powers[which] = have
    return have


class Rolling:
    """Fingerprints of any range of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, which: int):
        self.up, self.down = powers(which, len(codes))
        self.sums = np.zeros(len(codes) + 1, U)
        np.cumsum(codes * self.up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] ^ (stop - start).astype(U))


class Words:
    """Words of several texts: ``hashes`` of all words, ``first[d]:first[d + 1]`` are those of text d, and
    ``start``/``stop`` their bytes in ``data``."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        self.data = whole[edges[0] : edges[-1]]
        edges = edges - edges[0]
        inside = ~SPACES[self.data]
        heads = inside.copy()
        heads[1:] &= ~inside[:-1]
        at = edges[:-1][edges[:-1] < edges[1:]]
        heads[at] = inside[at]
        tails = inside.copy()
        tails[:-1] &= ~inside[1:]
        tails[at[at > 0] - 1] = inside[at[at > 0] - 1]
        self.start, self.stop = np.flatnonzero(heads), np.flatnonzero(tails) + 1
        self.first = np.searchsorted(self.start, edges)
        rolling = Rolling(BYTE_CODES[self.data], 0)
        self.hashes = rolling.of(self.start, self.stop) if len(self.start) else np.zeros(0, U)

    def text(self, d: int, keep: np.ndarray | None = None) -> bytes:
        """Words of text d joined by one space; ``keep`` marks those that stay."""
        a, b = self.first[d], self.first[d + 1]
        raw = self.data
        pairs = zip(self.start[a:b].tolist(), self.stop[a:b].tolist(), strict=True)
        if keep is None:
            return b" ".join([raw[s:e].tobytes() for s, e in pairs])
        return b" ".join([raw[s:e].tobytes() for (s, e), k in zip(pairs, keep.tolist(), strict=True) if k])


def slices(batch: pa.RecordBatch, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have ``SLICE_BYTES`` together, or a single longer text."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


def anchors(hashes: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block borders that are left after ``rounds`` of run and pair naming: position, name and reach.

    A border's name is that of the pair of symbols at its sides. Its reach is how far from it the words lie that
    decided that it stays; equal words within that distance give the same border and name anywhere.
    """
    n = len(hashes)
    at = np.arange(n + 1)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[[0, n]] = True
    low, high = at - edge, at + edge
    symbols = hashes
    name = np.zeros(n + 1, U)
    for r in range(rounds):
        for runs in (True, False):
            # what decides about a border: the symbols at its sides, up to their other ends
            low[1:] = np.minimum(low[1:], low[:-1])
            high[:-1] = np.maximum(high[:-1], high[1:])
            left, right = symbols[:-1], symbols[1:]
            if runs:
                gone = left == right
            else:
                coin = mix(symbols ^ U(int(BASES[1]) * (r + 1) % (1 << 64))) & U(1) != 0
                gone = ~coin[:-1] & coin[1:]
            gone &= ~edge[1:-1]
            stay = np.ones(len(at), bool)
            stay[1:-1] = ~gone
            heads = np.flatnonzero(stay[:-1])
            if runs:
                length = np.diff(np.append(heads, len(symbols)))
                first_of = symbols[heads]
                symbols = np.where(length > 1, mix(first_of + length.astype(U) * BASES[2]), first_of)
            else:
                name = np.zeros(len(at), U)
                pair = mix(left * BASES[0] + mix(right ^ BASES[2]))
                name[1:-1] = pair
                merged = symbols.copy()
                merged[:-1][gone] = pair[gone]
                symbols = merged[heads]
                name = name[stay]
            at, edge, low, high = at[stay], edge[stay], low[stay], high[stay]
    reach = np.maximum(at - low, high - at)
    inner = ~edge
    return at[inner], name[inner], reach[inner]

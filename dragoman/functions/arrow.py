"""Arrow functions for the two things built-in expressions lack: Porter stems and hashed vectors.

Both work on the distinct tokens of a batch, not on every token.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from dragoman.functions import dims

HASH_DIM = 64

# Suffix tables of the published 1980 suffix stripping algorithm.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli",
    "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation",
    "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness",
    ""),
]
_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
]


def _shape(stem: str) -> str:
    """One letter per character: v for vowels (y after a consonant included), c otherwise."""
    out = ""
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _swap(word: str, table: list[tuple[str, str]]) -> str:
    for old, new in sorted(table, key=lambda p: -len(p[0])):
        if word.endswith(old):
            stem = word[: -len(old)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Stem of one lower-case English word by the published 1980 rules."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    trimmed = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        trimmed = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        trimmed = word[:-3]
    if trimmed is not None:
        word = trimmed
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=lambda s: -len(s)):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _encode(terms: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Row lengths, distinct values and their index per token."""
    lengths = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = terms.flatten().dictionary_encode()
    return lengths, flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)


@F.arrow_udf(ArrayType(StringType()))
def english_terms(terms: pa.Array) -> pa.Array:
    """Terms of the English search field: stop words out, the rest stemmed."""
    lengths, words, codes = _encode(terms)
    stop = set(dims.SEARCH_STOPWORDS)
    keep = np.array([w not in stop for w in words], dtype=bool)
    stems = np.array([porter(w) if w.isascii() else w for w in words], dtype=object)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    kept = keep[codes] if len(codes) else np.zeros(0, dtype=bool)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows[kept], minlength=len(lengths)))])
    values = stems[codes[kept]] if len(codes) else np.zeros(0, dtype=object)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.string()))


@F.arrow_udf(ArrayType(DoubleType()))
def hash_vector(terms: pa.Array) -> pa.Array:
    """Unit-length hashed bag of words: dimension = first 16 bits of md5 modulo the width."""
    lengths, words, codes = _encode(terms)
    n = len(lengths)
    dim = np.array(
        [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % HASH_DIM for w in words], dtype=np.int64
    )
    rows = np.repeat(np.arange(n), lengths)
    cells = rows * HASH_DIM + (dim[codes] if len(codes) else np.zeros(0, dtype=np.int64))
    counts = np.bincount(cells, minlength=n * HASH_DIM).reshape(n, HASH_DIM).astype(float)
    norms = np.sqrt((counts**2).sum(axis=1, keepdims=True))
    unit = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)
    offsets = np.arange(n + 1) * HASH_DIM
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(unit.ravel()))

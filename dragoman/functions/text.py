"""Column expressions over bilingual text. All of them stay inside the JVM except ``to_nfc``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dragoman.functions import dims

# Character classes.
ARABIC_BLOCK = "[\\u0600-\\u06FF]"
ARABIC_ANY = "[\\u0600-\\u06FF\\u0750-\\u077F\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"
PRESENTATION = "[\\uFE70-\\uFEFF]"
REMOVED_MARKS = "[\\u200e\\u200f\\u202a-\\u202e\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u0640]"
FOLD_MARKS = "[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u0640]"
TOUCHED_BY_ARABIC = "[\\u200e\\u200f\\u202a-\\u202e\\u0610-\\u06FF]"
ARABIC_LETTER = "[\\u0621-\\u064A]"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
TOKEN_ARABIC = (
    "[\\u0621-\\u063A\\u0641-\\u064A\\u0660-\\u0669\\u0670-\\u06FF]+|[A-Za-z]+|[0-9]+"
)
PROTECTED = "^[A-Z]{2,4}\\d{3,4}$|^\\d{6,10}$|^[A-Z]+-\\d+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def collapse(c: Column) -> Column:
    # single spaces, nearly all of the white space there is, stay as they are
    return strip(F.regexp_replace(c, "(?U) \\s+|[\\s&&[^ ]]\\s*", " "))


def exchanged(c: Column, old: str, new: str) -> Column:
    """``translate`` for few letters, none of which is among the new ones: several searches are cheaper than a lookup per letter."""
    for a, b in zip(old, new, strict=True):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def is_arabic(c: Column) -> Column:
    return F.coalesce(c.rlike(ARABIC_ANY), F.lit(False))


def letters(c: Column) -> Column:
    return count_of(c, "\\p{L}")


def normalize_arabic(c: Column) -> Column:
    """Marks out, digits to Western, triple letters to double, alef and teh marbuta folded."""
    t = F.regexp_replace(c, REMOVED_MARKS, "")
    t = F.when(c.rlike(f"[{ARABIC_DIGITS}]"), F.translate(t, ARABIC_DIGITS, "01234567890123456789")).otherwise(t)
    t = F.regexp_replace(t, f"({ARABIC_LETTER})\\1{{2,}}", "$1$1")
    t = exchanged(t, "أإآٱة", "ااااه")
    # rows without any affected character skip the chain
    return F.coalesce(collapse(F.when(c.rlike(TOUCHED_BY_ARABIC), t).otherwise(c)), F.lit(""))


def fold_arabic(c: Column) -> Column:
    """Stronger folding used for matching only."""
    folded = exchanged(F.regexp_replace(c, FOLD_MARKS, ""), "أإآٱةىئؤٔ", "ااااهييوء")
    return F.when(c.rlike("[\\u0610-\\u06FF]"), folded).otherwise(c)


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def to_nfc(c: Column) -> Column:
    """NFC. Text wholly below U+0300 is NFC already, so only the other rows carry text to Python."""
    return F.coalesce(_nfc(F.when(c.rlike("[\\x{0300}-\\x{10FFFF}]"), c)), c)


def normalize(c: Column, punctuation: bool = True, digits: bool = True) -> Column:
    """NFC, Arabic folding, whitespace, lower case; optionally drop punctuation and digits."""
    t = F.lower(normalize_arabic(to_nfc(c)))
    if not punctuation:
        t = collapse(F.regexp_replace(t, "(?U)[^\\w\\s']", " "))
    if not digits:
        t = collapse(F.regexp_replace(t, "(?U)\\d+", ""))
    return t


def for_classification(c: Column) -> Column:
    return normalize(c, punctuation=False)


def language_tag(c: Column) -> Column:
    """Ingest rule: more than 20 Arabic characters among the first 400."""
    return F.when(count_of(F.substring(c, 1, 400), ARABIC_BLOCK) > 20, "ar").otherwise("en")


def language_detect(c: Column) -> Column:
    ar, la = count_of(c, ARABIC_BLOCK), count_of(c, "[a-zA-Z]")
    ratio = ar / (ar + la)
    return (
        F.when(c.isNull() | ((ar == 0) & (la == 0)), "unknown")
        .when(ar == 0, "english")
        .when(la == 0, "arabic")
        .when(ratio >= 0.5, "arabic")  # >= .6, <= .4 and the .5 tie rule between them
        .otherwise("english")
    )


def is_reversed(c: Column) -> Column:
    ar, forms = count_of(c, ARABIC_BLOCK), count_of(c, PRESENTATION)
    return F.when(ar == 0, False).otherwise(forms / ar > dims.REVERSED_RATIO)


def token_estimate(c: Column) -> Column:
    ar = count_of(c, ARABIC_BLOCK)
    return (ar + F.floor((F.length(c) - ar) / 4)).cast("int")


def any_phrase(english: list[str], arabic: list[str]) -> str:
    """Case-blind pattern: whole English words or phrases, Arabic ones anywhere."""
    return "(?iU)" + "|".join([f"\\b{w}\\b" for w in english] + arabic)


CURRENT_STATE = any_phrase(dims.CURRENT_STATE_EN, dims.CURRENT_STATE_AR)
RERANK_STATE = any_phrase(dims.RERANK_STATE_EN, dims.RERANK_STATE_AR)


def is_current_state(c: Column, for_rerank: bool = False) -> Column:
    return F.coalesce(c.rlike(RERANK_STATE if for_rerank else CURRENT_STATE), F.lit(False))


# ---------------------------------------------------------------- tokens


def arabic_tokens(c: Column, drop_phrases: bool = False) -> Column:
    t = normalize_arabic(c)
    if drop_phrases:
        t = remove_stop_phrases(t)
    return F.regexp_extract_all(t, F.lit(f"({TOKEN_ARABIC})"), 1)


def latin_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(strip(c)), "(?U)\\s+"), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Arabic-bearing text: script runs of the normalised text. Other text: whitespace, lower case."""
    return F.when(is_arabic(c), arabic_tokens(c)).otherwise(latin_tokens(c))


def remove_stop_phrases(c: Column, phrases: list[str] | None = None) -> Column:
    phrases = phrases if phrases is not None else [w for w in dims.ARABIC_STOPWORDS if " " in w]
    t = F.concat(F.lit(" "), c, F.lit(" "))
    edge = "[\\s.,!?;:()\\[\\]{}]"
    for phrase in phrases:
        body = "\\s+".join(phrase.split(" "))
        t = F.regexp_replace(t, f"(?U){edge}{body}{edge}", " ")
    return strip(t)


_PREFIX = "|".join(dims.ARABIC_PREFIXES)
_SUFFIX = "|".join(dims.ARABIC_SUFFIXES)


def light_stem(c: Column, aggressive: bool = False) -> Column:
    """Light Arabic stem of one token.

    One prefix and one suffix go, the first listed that leaves two characters; ``aggressive`` takes
    all layers. The alternation order of the pattern is the list order.
    """
    layers = "+" if aggressive else ""
    stem = F.regexp_replace(c, f"^(?:{_PREFIX}){layers}(.{{2,}})$", "$1")
    stem = F.regexp_replace(stem, f"^(.{{2,}}?)(?:{_SUFFIX}){layers}$", "$1")
    keep = (F.length(c) <= 2) | ~c.rlike(ARABIC_BLOCK) | c.rlike(f"(?U)^\\d+$|{PROTECTED}")
    return F.when(keep, c).otherwise(stem)


def light_stem_text(c: Column) -> Column:
    """Stemmed text of Arabic-bearing rows, stripped text of the others."""
    stemmed = F.array_join(F.transform(arabic_tokens(c), lambda t: light_stem(t)), " ")
    return F.when(is_arabic(c), stemmed).otherwise(strip(F.coalesce(c, F.lit(""))))


def search_terms(c: Column) -> Column:
    """Terms of the plain search field: lower case, Arabic folding, letter/digit runs."""
    folded = F.translate(
        F.regexp_replace(F.lower(c), "[\\u064B-\\u0652\\u0640]", ""), "أإآىة", "ااايه"
    )
    return F.regexp_extract_all(folded, F.lit("([\\p{L}\\p{N}_]+)"), 1)


def counted(terms: str | Column) -> Column:
    """Array of (term, tf) of an array of terms: equal terms lie together once sorted, heads tell the counts."""
    terms = F.col(terms) if isinstance(terms, str) else terms

    def of(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        ends = F.transform(F.array(heads), lambda h: F.transform(
            h, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(h, j + 1), F.size(s)) - i).cast("long").alias("tf"))
        ))
        return F.get(ends, F.lit(0))

    return F.when(F.size(terms) > 0, F.get(F.transform(F.array(F.sort_array(terms)), of), F.lit(0)))

"""Quality rules kept as a ledger of failure bits and measurements.

Every rule is evaluated once for a document. The ledger holds the measurements and one bit for each rule
that failed; a policy is a version number and the set of rules that count. Applying a policy and asking what
a rule alone removes (its ablation) only look at the bits, never at a text again.

A null text has no words. Repeated rows each get a row. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragoman.llm.common import let, words

Rule = tuple[str, Callable[[Column], Column]]

#: Name and failure test over the measurements, in the order of their bits.
RULES: Sequence[Rule] = (
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 2 * m["n_symbols"] > m["n_words"]),
    ("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
)
#: Rules that count in each version of the policy.
POLICIES: Mapping[int, Sequence[str]] = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length"),
}
CURRENT = 2
#: Positions take the low bits of a sort key; longer texts keep all positions as candidates.
POSITION_BITS = 24


def _repeated(trigrams: Column) -> Column:
    """Number of words in three-word windows that occur twice or more; takes the windows' hashes.

    The windows are first sorted as plain longs, a shortened hash above the position, which leaves a few
    positions that may repeat; these are compared by their whole hash.
    """
    low = (1 << POSITION_BITS) - 1
    keyed = F.sort_array(
        F.transform(
            trigrams,
            lambda x, i: F.shiftleft(x.bitwiseAND((1 << (63 - POSITION_BITS)) - 1), POSITION_BITS).bitwiseOR(i.cast("long")),
        )
    )

    def suspects(e: Column) -> Column:
        def name(i: Column) -> Column:
            return F.shiftright(F.get(e, i), POSITION_BITS)

        near = F.filter(e, lambda x, i: (name(i) == name(i - 1)) | (name(i) == name(i + 1)))
        return F.transform(near, lambda x: x.bitwiseAND(low).cast("int"))

    positions = F.when(F.size(trigrams) <= low, let(keyed, suspects)).otherwise(F.transform(trigrams, lambda x, i: i))
    whole = F.sort_array(F.transform(positions, lambda p: F.struct(F.get(trigrams, p).alias("h"), p.alias("p"))))

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    return let(whole, covered)


def _trigrams(hashes: Column) -> Column:
    heads = F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)))


def measure(text: Column) -> Column:
    """Struct of the measurements of a text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(hashes, lambda h: let(_trigrams(h), _repeated)).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            m["w"]["word_chars"].alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            m["l"]["n_lines"].alias("n_lines"),
            m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def fail_bits(m: Column, rules: Sequence[Rule] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for bit, (_, failed) in enumerate(rules):
        bits = bits + F.when(failed(m), F.lit(1 << bit)).otherwise(0)
    return bits


def mask(policy: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(rules)}
    return sum(bits[name] for name in set(policy))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: key, measurements, ``fail_bits``."""
    measured = docs.select(F.col(key), measure(F.col(text)).alias("_measured"))
    return measured.select(key, "_measured.*", fail_bits(F.col("_measured"), rules).alias("fail_bits"))


def apply_policy(book: DataFrame, policy: Sequence[str], name: str = "kept", rules: Sequence[Rule] = RULES) -> DataFrame:
    return book.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules))) == 0)


def ablations(book: DataFrame, policies: Mapping[int, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule of each policy removes: documents that fail it, and those that fail nothing else.

    The ledger is first counted by its bits (at most two to the number of rules), the rest is arithmetic.
    """
    counted = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))
    out = None
    for version, policy in sorted(policies.items()):
        whole = F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)))
        cells = []
        for bit, (name, _) in enumerate(rules):
            if name in policy:
                failed, only = whole.bitwiseAND(F.lit(1 << bit)) != 0, whole == (1 << bit)
                cells.append(
                    F.struct(
                        F.lit(version).alias("version"),
                        F.lit(name).alias("rule"),
                        F.coalesce(F.sum(F.when(failed, F.col("docs"))), F.lit(0)).alias("failed"),
                        F.coalesce(F.sum(F.when(only, F.col("docs"))), F.lit(0)).alias("failed_alone"),
                        F.coalesce(F.sum(F.when(only, F.col("words"))), F.lit(0)).alias("words_alone"),
                    )
                )
        rows = counted.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
        out = rows if out is None else out.unionAll(rows)
    return out


def keep_good(docs: DataFrame, policy: Sequence[str] = POLICIES[CURRENT], text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that pass the policy."""
    passed = let(measure(F.col(text)), lambda m: fail_bits(m).bitwiseAND(F.lit(mask(policy))) == 0)
    return docs.filter(passed)

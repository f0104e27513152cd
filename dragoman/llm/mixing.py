"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source is a 60-bit hash of its id and text. The words a source has to give beyond whole
repeats are found as a hash threshold: a histogram of words by source and the top bits of the hash shows in
which bucket the budget ends; only that bucket is looked at again with the next bits, until the bits are used
up. A document is taken once more if its hash lies below the threshold, so nothing is sorted, budgets are
nested (a larger budget takes a superset) and reruns agree.

Null and empty texts have size 0 and are never taken. Null is a source of its own, last in order. Rows without an
id, or with the same id, have places of their own by their texts; only equal rows share a place and are taken together.
The document at the threshold is taken if that comes nearer to the target, so a source misses its target by at most
half the document (or group of equal rows) at its threshold. An empty table gives no rows. Columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.llm.common import cut, fresh, words

#: Hash bits, and bits that one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 15
#: Weights dealt to the sources in order, and how often a document may be used.
WEIGHTS, MOST = (1, 2, 3), 3
#: Parts of a source in the final join, so that a hot source is spread.
SALTS = 32


def hash60(doc_id: Column, text: Column) -> Column:
    row = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    digits = F.substring(F.md5(row.cast("binary")), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("hash"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: weights share all words, no source gives more than ``MOST`` times its own.

    Sources are put in the order in which they would reach that limit; a source is limited if its share of what
    the limited ones before it leave is larger than its limit.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("limit", MOST * F.col("source_size"))
    before = W.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("limit_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    left = (F.col("total") - F.col("limit_before")).cast("double") * F.col("weight")
    per = per.withColumn("limited", F.col("limit").cast("double") * (F.col("weights") - F.col("weight_before")) <= left)
    used = F.sum(F.when(F.col("limited"), F.col("limit")).otherwise(0)).over(everything)
    gone = F.sum(F.when(F.col("limited"), F.col("weight")).otherwise(0)).over(everything)
    per = per.withColumn("used", used).withColumn("gone", gone)
    share = (F.col("total") - F.col("used")).cast("double") * F.col("weight") / (F.col("weights") - F.col("gone"))
    target = F.when(F.col("limited"), F.col("limit").cast("double")).otherwise(share)
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame) -> DataFrame:
    """source, source_size, target, repeats (whole uses of every document), threshold (one more use below it)."""
    goal = targets(sized)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goal.withColumn("repeats", repeats.cast("long")).select(
        "source", "source_size", "target", "repeats",
        (F.col("target") - F.col("repeats") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("prefix"),
    )
    carried = ["source_size", "target", "repeats"]
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = sized.select(
            F.col("source").alias("_source"), "size",
            F.shiftright("hash", shift + LEVEL_BITS).alias("_above"), F.shiftright("hash", shift).alias("bucket"),
        )
        counted = inside.groupBy("_source", "_above", "bucket").agg(F.sum("size").alias("size"))
        here = state.join(counted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("prefix") == F.col("_above")), "left")
        run = W.partitionBy("source").orderBy("bucket")
        here = here.withColumn("upto", F.sum(F.coalesce("size", F.lit(0))).over(run))
        # the first bucket that the budget does not cover, or nothing is left of the source
        ends = here.groupBy("source").agg(
            *[F.first(c).alias(c) for c in carried],
            F.first("budget").alias("whole"),
            F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", (F.col("upto") - F.col("size")).alias("below"), "size"))).alias("end"),
            F.max("bucket").alias("last"),
        )
        state = ends.select(
            "source", *carried,
            (F.col("whole") - F.coalesce("end.below", F.lit(0))).alias("budget"),
            F.coalesce("end.bucket", F.col("last") + 1, F.lit(0)).alias("prefix"),
            F.coalesce("end.size", F.lit(0)).alias("at_end"),
        )
    nearer = (F.col("at_end") > 0) & (2 * F.col("budget") >= F.col("at_end"))
    return state.select("source", *carried, (F.col("prefix") + nearer.cast("long")).alias("threshold"))


def _with_threshold(rows: DataFrame, found: DataFrame, source: str, hash_name: str) -> DataFrame:
    """Rows with the columns of their source, each source in ``SALTS`` parts. ``found`` has no other name in common."""
    own, salt = fresh(rows, "_t_source"), fresh(rows, "_t_salt")
    parts = found.withColumnRenamed("source", own).withColumn(salt, F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    same = F.col(source).eqNullSafe(F.col(own)) & (F.col(hash_name) % SALTS == F.col(salt))
    return rows.join(parts, same).drop(own, salt)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of ``docs``."""
    sized = cut(sizes(docs), "mix-sizes")
    out = _with_threshold(sized, thresholds(sized), "source", "hash")
    taken = F.col("size") * (F.col("repeats") + (F.col("hash") < F.col("threshold")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as the mix takes it."""
    found = cut(thresholds(cut(sizes(docs), "mix-sizes")), "mix-thresholds")
    repeats, threshold, key, copy = (fresh(docs, n) for n in ("_t_repeats", "_t_threshold", "_t_hash", "_t_copy"))
    found = found.select("source", F.col("repeats").alias(repeats), F.col("threshold").alias(threshold))
    out = _with_threshold(docs.withColumn(key, hash60(F.col("doc_id"), F.col("text"))), found, "source", key)
    times = (F.col(repeats) + (F.col(key) < F.col(threshold)).cast("long")).cast("int")
    # a row without words is never taken
    times = F.when(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), times).otherwise(0)
    names = docs.columns
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*names)

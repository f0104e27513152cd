"""Helpers that keep ordered work parallel when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.session import scratch_dir

#: Whether a query removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def explode_rows(df: DataFrame, array: str, pos: str, value: str) -> DataFrame:
    """Rows of an array column with their position.

    A plain explode makes the optimizer add a size test on the array below it, and pushing that test
    down repeats the whole expression that built the array. The outer form adds no test; the rows it
    keeps for empty arrays are dropped here.
    """
    rest = [c for c in df.columns if c != array]
    out = df.select(*rest, F.posexplode_outer(array).alias(pos, value))
    return out.filter(F.col(pos).isNotNull())


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared scratch folder and continue from it, so that later
    steps that read it twice do not repeat what led to it. What was shuffled for it is removed at once, so
    a job of many steps holds the shuffles of one step only."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: str,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums and maxima per key, current row included, with a hot key split into blocks.

    ``block`` names a column that does not decrease along ``order`` within a key. Each (key, block)
    is scanned on its own; what earlier blocks contribute is one row per block, joined back on
    (key, block).
    """
    sums, maxes = sums or {}, maxes or {}
    part = [*keys, block]
    out = df
    for name, expr in {**sums, **maxes}.items():
        out = out.withColumn(f"_v_{name}", expr)
    totals = out.groupBy(*part).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes],
    )
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *part,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxes],
    )
    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for n in sums:
        out = out.withColumn(f"_r_{n}", F.sum(f"_v_{n}").over(inside))
    for n in maxes:
        out = out.withColumn(f"_r_{n}", F.max(f"_v_{n}").over(inside))
    out = join_on_keys(out, carried, part)
    for n in sums:
        out = out.withColumn(n, F.col(f"_r_{n}") + F.col(f"_c_{n}"))
    for n in maxes:
        out = out.withColumn(n, F.greatest(f"_r_{n}", f"_c_{n}"))
    return out.drop(*[f"_{p}_{n}" for n in [*sums, *maxes] for p in "vrc"])


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], block: str, value: Column
) -> DataFrame:
    """Add ``prev1`` and ``prev2``: ``value`` one and two rows earlier in the key (null at its start).

    ``order`` must be a total order within a key and ``value`` not null.
    """
    part = [*keys, block]
    inside = W.partitionBy(*part).orderBy(*order)
    out = (
        df.withColumn("_val", value)
        .withColumn("_n", F.row_number().over(inside))
        .withColumn("_l1", F.lag("_val", 1).over(inside))
        .withColumn("_l2", F.lag("_val", 2).over(inside))
    )
    ends = out.groupBy(*part).agg(
        F.max_by(F.struct("_val", "_l1"), F.struct(*order)).alias("_end")
    )
    blocks = W.partitionBy(*keys).orderBy(block)
    carried = ends.withColumn("_e1", F.lag("_end", 1).over(blocks)).withColumn(
        "_e2", F.lag("_end", 2).over(blocks)
    )
    carried = carried.select(
        *part,
        F.col("_e1._val").alias("_c1"),
        F.coalesce(F.col("_e1._l1"), F.col("_e2._val")).alias("_c2"),
    )
    out = join_on_keys(out, carried, part)
    first, second = F.col("_n") == 1, F.col("_n") == 2
    out = out.withColumn("prev1", F.when(first, F.col("_c1")).otherwise(F.col("_l1")))
    out = out.withColumn(
        "prev2",
        F.when(first, F.col("_c2")).when(second, F.col("_c1")).otherwise(F.col("_l2")),
    )
    return out.drop("_val", "_n", "_l1", "_l2", "_c1", "_c2")


def with_halo(
    df: DataFrame, position: str, size: int, reach: int, name: str = "_halo_block"
) -> DataFrame:
    """Put rows into blocks of ``size`` positions and copy the last ``reach`` rows of a block into
    the next one with ``_halo`` true, so that frames of up to ``reach`` rows never leave a block."""
    block = F.floor((F.col(position) - 1) / size)
    tail = (F.col(position) - 1) % size >= size - reach
    homes = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    return df.select("*", F.posexplode(homes).alias("_copy", name)).withColumn(
        "_halo", F.col("_copy") == 1
    ).drop("_copy")


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that also matches null keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, "left").drop(*[f"_k_{k}" for k in keys])

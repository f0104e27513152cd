"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dragoman.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b of one orderable type); root is the least node reached.

    Large-star and small-star steps by turns: each hangs nodes on the least of their neighbours. Only minima are
    aggregated, and both sides of each join are plain tables, so a node with very many edges can be split.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, last = cut(e, "edges"), None
    while True:
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == last or not mark["n"]:
            break
        last = mark
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(both.groupBy(F.col("u").alias("l_u")).agg(F.least(F.first("u"), F.min("v")).alias("least")), "star-large")
        large = both.join(least, F.col("u") == F.col("l_u")).filter("v > u").select(F.col("v").alias("a"), F.col("least").alias("b")).distinct()
        large = cut(large, "edges-large")
        least = cut(large.groupBy(F.col("a").alias("l_a")).agg(F.min("b").alias("least")), "star-small")
        small = large.join(least, F.col("a") == F.col("l_a"))
        pairs = F.array(F.struct(F.col("a").alias("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
        e = cut(small.select(F.inline(pairs)).filter("a <> b").distinct(), "edges-small")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))

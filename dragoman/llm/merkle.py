"""Merkle manifest of a table: one tree per group of rows, one tree over the groups' roots.

A leaf is the hash of a row's fields, each with its length, so that no two rows read alike. The leaves of a group lie
in the order of their keys. On every level a node computes the indices of its run, the ``fan`` nodes from the next
lower multiple of ``fan`` on (its own index XOR one, where the tree is binary), and meets these nodes in an equi-join
on (tree, index): every node then has its siblings, and the node in slot zero of a run emits the parent. A last run may
be shorter, down to one node. What is left of each group is its subroot; the subroots, ordered by group, form the tree
above.

A path holds, from a node's own run up to the root, what stands before and after the node. It goes down level by level:
a level joins its parents' paths, which are ``fan`` times fewer. Folding a leaf into its path gives the root again if,
and only if, the row is what it was.

Groups and keys may be null and come first in their order; rows that share group and key follow the order of their
hashes, and equal rows take neighbouring leaves. A group of any size is spread over all tasks: positions are counted
inside ranges of the sorted rows, plus one number per range and group. An empty table gives no rows. Columns are read
by name, others are ignored whatever they are called.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.llm.common import cut

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256(value: Column) -> Column:
    """Digest of a string, as 32 bytes."""
    return F.unhex(F.sha2(value.cast("binary"), 256))


def as_text(digests: Column) -> Column:
    """Bytes of one or more digests as lower-case hex."""
    return F.lower(F.hex(digests))


def row_hash(fields: Sequence[Column]) -> Column:
    """Hash of fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    values = [f.cast("string") for f in fields]
    return sha256(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda whole, x: F.concat(whole, x))


def fold(leaf: Column, path: Column) -> Column:
    """Root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, step: sha256(as_text(F.concat(step["before"], node, step["after"]))))


def placed(rows: DataFrame) -> DataFrame:
    """Add ``at``, a row's place in its tree by (id, digest), and ``n``, the rows of the tree."""
    order = ["tree", "id", "digest", "tie"]
    ranges = (
        rows.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("row", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()).drop("tie")
    )
    ranges = cut(ranges, "merkle-ranges")
    spans = ranges.groupBy("tree", "range").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    out = ranges.join(spans, ["tree", "range"]).withColumn("at", F.col("row") + F.col("shift"))
    return cut(out.drop("range", "row", "shift"), "merkle-leaves")


def with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """Add ``run``, the digests of a node's run in order, its own included."""
    at = F.col("at")
    indices = F.array(at, at.bitwiseXOR(F.lit(1))) if fan == 2 else F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda slot: at - at % fan + slot)
    asked = nodes.select("tree", "at", F.explode(indices).alias("sibling"))
    found = nodes.select("tree", F.col("at").alias("sibling"), "digest")
    met = asked.join(found, ["tree", "sibling"])
    runs = met.groupBy("tree", "at").agg(F.transform(F.sort_array(F.collect_list(F.struct("sibling", "digest"))), lambda x: x["digest"]).alias("run"))
    return nodes.join(runs, ["tree", "at"])


def climb(leaves: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees, leaves first, and a row per tree: its root's digest and level.

    ``leaves`` has tree, at, n, digest, and whatever else is to stay with the lowest level.
    """
    nodes, levels, closed = leaves, [], []
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        closed.append(nodes.filter("n = 1").select("tree", "digest", F.lit(len(levels)).alias("level")))
        if most <= 1:
            return levels, reduce(DataFrame.union, closed)
        level = cut(with_siblings(nodes.filter("n > 1"), fan), f"merkle-level{len(levels)}")
        levels.append(level)
        nodes = level.filter(F.col("at") % fan == 0).select(
            "tree", F.expr(f"at div {fan}").alias("at"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), sha256(as_text(_joined(F.col("run")))).alias("digest")
        )
        most = -(-most // fan)


def descend(levels: list[DataFrame], leaves: DataFrame, tops: DataFrame, fan: int) -> DataFrame:
    """Leaves with their ``path`` and what ``tops`` says of their tree. ``tops``: tree, level of its root, the root's
    path and further columns."""
    more = [c for c in tops.columns if c not in ("tree", "level")]
    kept = [c for c in leaves.columns if c not in ("tree", "at", "n")]

    def roots(level: int) -> DataFrame:
        return tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("at"), *more)

    paths = roots(len(levels))
    for i in reversed(range(len(levels))):
        own = kept if i == 0 else []
        slot = (F.col("at") % fan).cast("int")
        step = F.struct(
            _joined(F.slice("run", F.lit(1), slot)).alias("before"), _joined(F.slice("run", slot + 2, F.lit(fan))).alias("after")
        )
        level = levels[i].select("tree", "at", *own, F.expr(f"at div {fan}").alias("up"), step.alias("step"))
        above = paths.select("tree", F.col("at").alias("up"), *more)
        grown = level.join(above, ["tree", "up"]).withColumn("path", F.concat(F.array("step"), "path")).select("tree", "at", *own, *more)
        if i == 0:
            single = leaves.filter("n = 1").join(roots(0).drop("at"), "tree").select(grown.columns)
            return grown.union(single)
        paths = grown.union(roots(i))
    return leaves.join(paths.drop("at"), "tree").select("tree", "at", *kept, *more)


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id", fan: int = FAN,
    audited: Mapping[str, Column] | None = None, where: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the key, and as bytes ``leaf``, ``subroot``, ``root``; ``path``, ``folded_root``.

    ``audited`` gives fields as an audit finds them, in the rows where ``where`` is true: ``folded_root`` folds the leaf
    of the row as found into the path of the row as it was, and equals the root if nothing has changed.
    """
    columns = {f: F.col(f) for f in fields}
    found = row_hash(list((columns | dict(audited)).values())) if audited else F.lit(None).cast("binary")
    if audited and where is not None:
        found = F.when(where, found)
    rows = docs.select(
        # null first, then the names by their bytes
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(key).alias("id"), row_hash(list(columns.values())).alias("digest"), found.alias("found"),
    )
    leaves = placed(rows)
    levels, subroots = climb(leaves, fan)
    subroots = cut(subroots, "merkle-subroots")
    tops = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest", "level"))
    upper, root = climb(tops, fan)
    summit = root.select("tree", "level", F.array().cast("array<struct<before:binary,after:binary>>").alias("path"), F.col("digest").alias("root"))
    above = descend(upper, tops, summit, fan)
    above = above.select(F.col("id").alias("tree"), "level", F.col("digest").alias("subroot"), "path", "root")
    out = descend(levels, leaves, cut(above, "merkle-tops"), fan)
    return out.select(
        F.col("id").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path",
        fold(F.coalesce("found", "digest"), F.col("path")).alias("folded_root"),
    )


def proof(path: Column) -> Column:
    """All siblings of a path from the leaf up, left to right, as bytes."""
    return F.aggregate(path, F.lit(b""), lambda whole, step: F.concat(whole, step["before"], step["after"]))

"""Join of documents on the Jaccard similarity of their five-word shingles, by MinHash banding.

A document is the set of its runs of ``SHINGLE`` words (one run of all its words if it has fewer). Documents of
equal sets form a class, compared once. ``TREES`` tables hold the first values of the classes' MinHash signatures;
two classes meet where a table has the same values for both. How many values is fixed by the constants: the most
with which a pair exactly at the threshold is found with probability ``RECALL``. Classes that meet, directly or
through others, form a family.

Inside a family every pair of classes is verified exactly, in blocks of ``BLOCK`` classes: a task holds two
blocks of shingle sets, counts each class's links and keeps a spanning forest of the links, never the pairs.
Families of thousands of near copies are thus spread over tasks by block pairs. Components of the verified
links are the result's groups.

A document without words is linked to none. Null ids come last in order. Rows that share an id are documents of
their own if their texts differ; equal rows count as copies. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragoman.llm.common import cut, fresh
from dragoman.llm.graph import components
from dragoman.llm.symbols import Rolling, U, Words, mix, slices
from dragoman.operators.blocks import runs

SHINGLE = 5
#: Similarity as a fraction, so that the test is exact.
THRESHOLD = (4, 5)
TREES, DEEPEST, RECALL = 16, 8, 0.999
BLOCK = 512
LAST_ID = (1 << 63) - 1
NODE = "struct<doc:bigint,tag:bigint>"


def prefix_length(threshold: float, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some table with the asked probability."""
    length = deepest
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's shingles."""
    rolling, out = Rolling(words.hashes, 1), []
    count = np.diff(words.first)
    for a, n in zip(words.first[:-1].tolist(), count.tolist(), strict=True):
        if n == 0:
            out.append(np.zeros(0, U))
        else:
            start = np.arange(a, a + max(1, n - size + 1))
            out.append(np.unique(rolling.of(start, start + min(n, size))))
    return out


def _signatures(size: int, trees: int, prefix: int):
    seeds = mix(np.arange(1, trees * prefix + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = shingle_sets(Words(part.column(2)), size)
                length = np.array([len(s) for s in sets])
                full = np.flatnonzero(length)
                keys = np.zeros((len(sets), trees), U)
                one, two = np.zeros(len(sets), U), np.zeros(len(sets), U)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    heads = np.cumsum(length[full]) - length[full]
                    one[full] = mix(np.add.reduceat(mix(every ^ seeds[0]), heads) ^ length[full].astype(U))
                    two[full] = np.add.reduceat(mix(every + seeds[1]), heads)
                    for tree in range(trees):
                        key = np.full(len(full), U(tree + 1))
                        for level in range(prefix):
                            least = np.minimum.reduceat((every * seeds[tree * prefix + level]) >> U(16), heads)
                            key = mix(key * U(0x9E3779B97F4A7C15) + least)
                        keys[full, tree] = key
                flat = pa.array(keys.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, trees * len(sets) + 1, trees), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(length, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists],
                    ["doc", "tag", "n", "k1", "k2", "keys"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = shingle_sets(Words(part.column(2)), size)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *part.columns[3:], pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "tag", "family", "block", "blocks", "weight", "shingles"])

    return run


def _verify(threshold: tuple[int, int]):
    """Links inside one block or between two: per class the weight of its links and the least class it hangs on."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 4):
            side = group["side"].to_numpy()
            doc, tag, weight = group["doc"].to_numpy(), group["tag"].to_numpy(), group["weight"].to_numpy()
            sets = [np.frombuffer(b.as_buffer(), U) for b in group["shingles"].combine_chunks()] if len(group) else []
            size = np.array([len(s) for s in sets])
            vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(size)
            order = np.lexsort((tag, doc))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            own = group["bi"][0].as_py() == group["bj"][0].as_py()
            left = np.arange(len(sets)) if own else np.flatnonzero(side == 0)
            right = np.arange(len(sets)) if own else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            # the right side lies together: its ids, and where each set begins
            r_ids = np.concatenate([ids[ends[j] - size[j] : ends[j]] for j in right])
            r_head = np.cumsum(size[right]) - size[right]
            mark = np.zeros(len(vocabulary), np.int32)
            links = np.zeros(len(sets), np.int64)
            parent = np.arange(len(sets))

            def root(x: int, parent: np.ndarray = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i in left:
                mine = ids[ends[i] - size[i] : ends[i]]
                mark[mine] = 1
                common = np.add.reduceat(mark[r_ids], r_head)
                mark[mine] = 0
                hit = right[(num + den) * common >= num * (size[i] + size[right])]
                hit = hit[hit != i]
                if not len(hit):
                    continue
                links[i] += weight[hit].sum()
                if not own:
                    links[hit] += weight[i]
                for r in {root(i), *(root(j) for j in hit)}:
                    a, b = root(i), root(r)
                    if a != b:
                        low, high = (a, b) if rank[a] < rank[b] else (b, a)
                        parent[high] = low
            seen = np.flatnonzero(links)
            if len(seen):
                top = np.array([root(x) for x in seen])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[seen]), pa.array(tag[seen]), pa.array(links[seen]), pa.array(doc[top]), pa.array(tag[top])],
                    ["doc", "tag", "links", "r_doc", "r_tag"],
                )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(_doc().alias("doc"), _tag().alias("tag"), text.alias("text"))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def _tag() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _node(doc: str = "doc", tag: str = "tag") -> Column:
    return F.struct(F.col(doc).alias("doc"), F.col(tag).alias("tag"))


def groups(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc, tag, copy_of (least document of equal shingles), root (least document of the group), links."""
    texts = _texts(docs)
    prefix = prefix_length(threshold[0] / threshold[1], recall=recall)
    signed = texts.mapInArrow(_signatures(size, TREES, prefix), "doc long, tag long, n long, k1 long, k2 long, keys array<long>")
    signed = cut(signed, "forest-signatures")
    classes = signed.filter("n > 0").groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(
        F.min(F.struct("doc", "tag", "keys")).alias("first"), F.count(F.lit(1)).alias("weight")
    )
    classes = cut(classes.select("c1", "c2", _node("first.doc", "first.tag").alias("node"), "weight", F.col("first.keys").alias("keys")), "forest-classes")
    leaves = classes.select("node", F.explode("keys").alias("key"))
    least = cut(leaves.groupBy(F.col("key").alias("l_key")).agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").drop("most"), "forest-leads")
    met = leaves.join(least, F.col("key") == F.col("l_key")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    families = cut(components(met), "forest-families")
    count = cut(families.groupBy(F.col("root").alias("f_root")).agg(F.count(F.lit(1)).alias("members")), "forest-sizes")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    members = families.join(count, F.col("root") == F.col("f_root")).select(
        F.col("node"), F.xxhash64("root.doc", "root.tag").alias("family"), F.pmod(F.xxhash64("node.doc", "node.tag"), blocks).cast("int").alias("block"), blocks.alias("blocks")
    )
    members = members.join(classes.select(F.col("node").alias("c_node"), "weight"), F.col("node") == F.col("c_node"))
    members = members.select(F.col("node.doc").alias("m_doc"), F.col("node.tag").alias("m_tag"), "family", "block", "blocks", "weight")
    # rows that are equal altogether stand for one class
    wanted = texts.join(members, (F.col("doc") == F.col("m_doc")) & (F.col("tag") == F.col("m_tag"))).dropDuplicates(["doc", "tag"])
    sets = wanted.select("doc", "tag", "text", "family", "block", "blocks", "weight").mapInArrow(
        _sets(size), "doc long, tag long, family long, block int, blocks int, weight long, shingles binary"
    )
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = sets.select("*", F.explode(others).alias("other")).select(
        "family", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), F.lit(0).alias("kind"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "doc", "tag", "weight", "shingles",
    )
    spread = placed.repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj")
    links = spread.mapInArrow(_verify(threshold), "doc long, tag long, links long, r_doc long, r_tag long")
    links = cut(links, "forest-links")
    roots = components(links.select(_node().alias("a"), _node("r_doc", "r_tag").alias("b")))
    counted = links.groupBy(_node().alias("l_node")).agg(F.sum("links").alias("links"))
    joined = classes.drop("keys").join(counted, F.col("node") == F.col("l_node"), "left").join(
        roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left"
    )
    joined = joined.select("c1", "c2", "node", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    joined = cut(joined, "forest-groups")
    same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") > 0)
    out = signed.drop("keys").join(joined, same, "left")
    return out.select(
        "doc", "tag", F.coalesce("node", _node()).alias("copy_of"), F.coalesce("root", _node()).alias("root"), F.coalesce("links", F.lit(0)).alias("links")
    )


def _id(node: str, kind: str) -> Column:
    return F.when(F.col(f"{node}.doc") != LAST_ID, F.col(f"{node}.doc")).cast(kind)


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least document of its group), n_links (other documents at the threshold), copy_of."""
    kind = dict(docs.dtypes)["doc_id"]
    found = groups(docs).withColumn("self", _node())
    return found.select(_id("self", kind).alias("doc_id"), _id("root", kind).alias("class_id"), F.col("links").alias("n_links"), _id("copy_of", kind).alias("copy_of"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that are the least of their group; of equal rows one stays."""
    doc, tag, g_doc, g_tag = (fresh(docs, n) for n in ("_j_doc", "_j_tag", "_g_doc", "_g_tag"))
    gone = groups(docs).filter(F.col("root") != _node()).select(F.col("doc").alias(g_doc), F.col("tag").alias(g_tag)).distinct()
    kept = docs.withColumns({doc: _doc(), tag: _tag()}).join(gone, (F.col(doc) == F.col(g_doc)) & (F.col(tag) == F.col(g_tag)), "left_anti")
    return kept.dropDuplicates([doc, tag]).drop(doc, tag)

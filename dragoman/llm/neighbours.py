"""Approximate nearest neighbours by an adaptive scan of dimensions inside probed lists.

Vectors are dealt to lists by their nearest centroid; the centroids come from k-means over a bounded sample
(``SAMPLE`` vectors, drawn by hash), every vector is indexed. A query probes the lists whose centroids are
nearest. How many is calibrated on the sample: enough to hold ``RECALL`` of the sample's true neighbours, and in
any case lists with more vectors than are asked for.

Inside a list, vectors and queries are rotated by one random orthogonal matrix and compared column block by
column block. After d of D columns the partial squared distance, scaled by D / d, estimates the whole; a candidate
is abandoned once the estimate exceeds the query's current bound by the factor (1 + ``EPSILON`` / sqrt(d)), the
test of the hypothesis that it is nearer. Survivors are scored exactly, by cosine in double precision on the
original vectors, and the best of all lists are kept, ties to the smaller id.

A long list is split into blocks of vectors, and the queries that probe it into chunks, so a task holds one block
and one chunk, also where a third of all vectors are equal. Vectors that are null, zero, hold null or non-finite
components, or have another length than most, take no part. Rows with one id are rows of their own, a query does
not return its id. Query rows that are equal count as one query; those of one id with different vectors are queries
of their own, each with its k ranks. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dragoman.llm.common import cut
from dragoman.operators.blocks import runs

K = 5
SAMPLE, ITERATIONS, SEED = 20_000, 12, 11
RECALL = 0.99
COLUMNS, EPSILON = 16, 2.1
BLOCK, CHUNK = 4096, 512
SCHEMA = "query_id long, query long, vec_id long, score double"
PROBES = "vec_id long, query long, list int, vector binary"


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that squares neither overflow nor vanish."""
    _, e = np.frexp(np.abs(x).max(axis=1, keepdims=True)) if len(x) else (None, np.zeros((0, 1), int))
    x = np.ldexp(x, -e)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors and their components as doubles."""
    length = np.asarray(vectors.value_lengths().fill_null(-1))
    at = np.flatnonzero(length == size)
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(at), size)
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[fine], x[fine]


def _rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


class Index:
    """Centroids, and how many lists a query probes."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, rows: int, k: int):
        unit = _unit(sample)
        rng = np.random.default_rng(SEED)
        lists = int(max(1, min(np.sqrt(rows), len(unit) / 16)))
        centre = unit[rng.choice(len(unit), lists, replace=False)]
        for _ in range(ITERATIONS):
            near = (unit @ centre.T).argmax(axis=1)
            total = np.zeros_like(centre)
            np.add.at(total, near, unit)
            held = (total != 0).any(axis=1)
            centre[held] = _unit(total[held])
        self.centre = centre
        step = max(1, len(unit) // 400)
        asked = unit[::step]
        # vectors of the query's own id are no neighbours
        score = np.where(ids[::step, None] == ids[None, :], -np.inf, asked @ unit.T)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        home = (unit @ centre.T).argmax(axis=1)
        order = np.argsort(-(asked @ centre.T), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(lists)[None, :].repeat(len(order), 0), axis=1)
        ranks = np.take_along_axis(rank, home[best], axis=1)[np.isfinite(np.take_along_axis(score, best, axis=1))]
        self.probes = int(np.quantile(ranks, RECALL, method="higher")) + 1 if ranks.size else lists


def _assign(index: Index, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                at, x = _valid(part.column(1), size)
                x = x + 0.0  # equal vectors get equal bytes: no negative zeros
                home = (_unit(x) @ index.centre.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), pa.array(home, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "list", "vector"]
                )

    return run


def _probe(index: Index, size: int, held: np.ndarray, k: int):
    """Lists that each query visits: the nearest ``probes``, more while they hold too few vectors besides the ``own``
    that share its id; by (vec_id, query, own, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(-1, size)
                least = k + np.asarray(part.column(2))[:, None]
                order = np.argsort(-(_unit(x) @ index.centre.T), axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                take = ((np.arange(order.shape[1])[None, :] < index.probes) | (before < least)) & (held[order] > 0)
                row, col = np.nonzero(take)
                picked = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(picked), part.column(1).take(picked), pa.array(order[row, col], pa.int32()), part.column(3).take(picked)],
                    ["vec_id", "query", "list", "vector"],
                )

    return run


def _scan(x: np.ndarray, x_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Best k of the vectors ``x`` for each query, as (number of the query, vector, score)."""
    size, ux, uq = x.shape[1], _unit(x), _unit(q)
    rx, rq = (ux @ turn).astype(np.float32), (uq @ turn).astype(np.float32)
    first = min(len(x), 16 * k)
    out = []
    for a in range(0, len(q), 64):
        some = slice(a, a + 64)
        # the bound: the k-th distance among a few vectors that are compared in full
        near = 2 - 2 * (rq[some] @ rx[:first].T)
        near[q_ids[some][:, None] == x_ids[None, :first]] = np.inf
        bound = np.sort(near, axis=1)[:, k - 1] if first >= k else np.full(len(near), np.inf)
        bound = np.maximum(bound, 0) + 1e-5
        done = min(COLUMNS, size)
        left, right = rq[some, :done], rx[:, :done]
        part = (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2 * left @ right.T
        row, col = np.nonzero(part * (size / done) <= (((1 + EPSILON / np.sqrt(done)) ** 2) * bound)[:, None])
        part = part[row, col]
        while done < size:
            step = slice(done, done + COLUMNS)
            diff = rq[some, step][row] - rx[:, step][col]
            part = part + np.einsum("ij,ij->i", diff, diff)
            done = min(done + COLUMNS, size)
            factor = (1 + EPSILON / np.sqrt(done)) ** 2 if done < size else 1.0
            stay = part * (size / done) <= factor * bound[row] + 1e-5
            row, col, part = row[stay], col[stay], part[stay]
        other = q_ids[some][row] != x_ids[col]
        row, col = row[other], col[other]
        score = np.einsum("ij,ij->i", uq[some][row], ux[col])
        order = np.lexsort((x_ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        heads = np.searchsorted(row, np.arange(len(q_ids[some])))
        keep = np.arange(len(row)) - heads[row] < k
        out.append((a + row[keep], x_ids[col[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _search(size: int, k: int):
    turn = _rotation(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            asks = group["asks"].to_numpy()
            ids = group["vec_id"].to_numpy()
            x = np.frombuffer(b"".join(group["vector"].to_pylist()), np.float64).reshape(-1, size)
            if asks.all() or not asks.any():
                continue
            asking, near, score = _scan(x[~asks], ids[~asks], x[asks], ids[asks], turn, k)
            query = group["query"].to_numpy()[asks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[asks][asking]), pa.array(query[asking]), pa.array(near), pa.array(score)], ["query_id", "query", "vec_id", "score"]
            )

    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each different row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None or not sizes["size"]:
        return empty
    size, count = sizes["size"], sizes["count"]
    share = int(min(1.0, SAMPLE / count) * (1 << 30))
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < share).limit(2 * SAMPLE).toArrow().combine_chunks()
    if not drawn.num_rows:
        return empty
    ids = np.asarray(drawn["vec_id"])
    order = np.argsort(ids, kind="stable")
    at, x = _valid(drawn["embedding"].combine_chunks().take(pa.array(order)), size)
    if not len(x):
        return empty
    index = Index(x, ids[order][at], count, k)
    placed = cut(rows.mapInArrow(_assign(index, size), "vec_id long, list int, vector binary"), "vector-lists")
    lists = len(index.centre)

    def per_list(df: DataFrame) -> np.ndarray:
        out = np.zeros(lists, np.int64)
        for r in df.groupBy("list").count().collect():
            out[r["list"]] = r["count"]
        return out

    held = per_list(placed)
    asking = placed.filter(F.col("vec_id") % every == 0).select("vec_id", "vector")
    copies = asking.groupBy(F.col("vec_id").alias("o_id")).agg(F.count(F.lit(1)).alias("own"))
    asked = asking.distinct().join(copies, F.col("vec_id") == F.col("o_id")).select("vec_id", F.monotonically_increasing_id().alias("query"), "own", "vector")
    probes = cut(asked.mapInArrow(_probe(index, size, held, k), PROBES), "vector-probes")
    visits = per_list(probes)
    # one row per list: how many blocks its vectors and chunks its queries make
    split = spark.createDataFrame(
        [(i, int(max(1, -(-held[i] // BLOCK))), int(max(1, -(-visits[i] // CHUNK)))) for i in range(lists)], "s_list int, blocks int, chunks int"
    )
    own = F.when(F.col("asks"), F.pmod(F.xxhash64("query"), "chunks")).otherwise(F.pmod(F.xxhash64("vec_id"), "blocks")).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("asks"), F.col("blocks")).otherwise(F.col("chunks")) - 1)
    both = placed.withColumns({"asks": F.lit(False), "query": F.lit(-1).cast("long")}).unionByName(probes.withColumn("asks", F.lit(True)))
    both = both.join(F.broadcast(split), F.col("list") == F.col("s_list")).filter(F.col("asks") | F.col("list").isin([int(i) for i in np.flatnonzero(visits)]))
    both = both.withColumn("own", own).withColumn("other", F.explode(others))
    block, chunk = F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other"))
    groups = both.select("list", block.alias("block"), chunk.alias("chunk"), "asks", "vec_id", "query", "vector")
    groups = groups.repartition("list", "block", "chunk").sortWithinPartitions("list", "block", "chunk")
    found = groups.mapInArrow(_search(size, k), SCHEMA)
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

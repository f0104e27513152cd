"""Scoring of a query table against an item table in bounded blocks, and groups of a sorted stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dragoman.operators.scale import cut


def runs_in(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Stretches of equal values in the first ``keys`` columns, each within one batch, of a stream sorted by them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = None
        for c in range(keys):
            col = batch.column(c)
            differs = pc.not_equal(col.slice(1), col.slice(0, len(col) - 1))
            changed = differs if changed is None else pc.or_(changed, differs)
        heads = [0, *(pc.indices_nonzero(changed).to_numpy() + 1).tolist(), batch.num_rows]
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            yield pa.Table.from_batches([batch.slice(a, b - a)])


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of equal values in the first ``keys`` columns of a stream sorted by them."""
    held: list[pa.Table] = []
    held_key = None
    for part in runs_in(batches, keys):
        key = tuple(part.column(c)[0].as_py() for c in range(keys))
        if held and key != held_key:
            yield pa.concat_tables(held)
            held = []
        held.append(part)
        held_key = key
    if held:
        yield pa.concat_tables(held)


class Scorer(Protocol):
    """Holds one block of queries, meets the items of one block a stretch at a time."""

    def add(self, items: pa.Table) -> None: ...

    def result(self) -> pa.RecordBatch | None: ...


class Best:
    """The k best items of each query of a block, by score, ties by id. ``floor`` is the k-th best score of each query so far."""

    def __init__(self, ids: pa.Array, k: int):
        self.k, self.ids, self.floor = k, ids, np.full(len(ids), -np.inf)
        self.row, self.score, self.found = np.zeros(0, np.int64), np.zeros(0), None

    def keep(self, row: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        row, score = np.concatenate([self.row, row]), np.concatenate([self.score, score])
        ids = ids if self.found is None else pa.concat_arrays([self.found, ids])
        frame = pd.DataFrame({"q": row, "id": ids.to_numpy(zero_copy_only=False), "score": score})
        frame = frame.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
        best = frame.groupby("q", sort=False).head(self.k).index.to_numpy()
        self.row, self.score, self.found = row[best], score[best], ids.take(pa.array(best))
        full = np.bincount(self.row, minlength=len(self.floor)) >= self.k
        last = np.full(len(self.floor), np.inf)
        np.minimum.at(last, self.row, self.score)
        self.floor = np.where(full, last, -np.inf)

    def result(self) -> pa.RecordBatch | None:
        if self.found is None:
            return None
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.row)), self.found, pa.array(self.score)], ["query_id", "chunk_id", "score"])


class Parts:
    """``Best`` of a block of queries in parts of ``rows`` queries, each of which meets a stretch on its own: what is held besides
    the queries and their results is one part's, however many queries the block has and however many items tie."""

    #: Hits that are sorted into the best at a time.
    HITS = 1 << 18

    def __init__(self, ids: pa.Array, k: int, rows: int):
        self.k, self.n = k, len(ids)
        self.parts = [(a, Best(ids.slice(a, rows), k)) for a in range(0, len(ids), rows)]

    def groups(self, hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row and column of the hits in a table of queries and items, some rows at a time: few hits, or one row."""
        edge = np.append(0, np.cumsum(np.count_nonzero(hit, axis=1)))
        a = 0
        while edge[a] < edge[-1]:
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + self.HITS, side="right")) - 1)
            row, col = np.nonzero(hit[a:b])
            if len(row):
                yield row + a, col
            a = b

    def result(self) -> pa.RecordBatch | None:
        found = [out for _, best in self.parts if (out := best.result()) is not None]
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found else None


#: Blocks of a side that are made for the sake of many tasks; more only where a block of queries would be too large to hold.
SPREAD = 12
#: Rows that few queries may be copied to, but no more than there are items, so that the blocks of a large table stay small.
COPIES = 1 << 18
#: Copies of items that lie on disk at a time; more blocks of queries are gone through in rounds.
COPIED = 1 << 21
#: Items of one stretch.
STRETCH = 4096


def score_blocks(
    items: DataFrame,
    queries: DataFrame,
    scorer: Callable[[pa.Table], Scorer],
    schema: str,
    item_id: str = "chunk_id",
    query_id: str = "query_id",
    per_item_block: int = 4096,
    per_query_block: int = 1024,
    held: int = 32768,
    spread: int = SPREAD,
    order: tuple[str, ...] = (),
    finish: Callable[[DataFrame], DataFrame] | None = None,
    copied: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """What ``scorer(queries)`` gives after the items of a block, for every pair of an item block and a query block.

    Both tables are dealt to blocks by the hash of their id. A task holds the queries of its block, ``held`` rows or so,
    and reads its items as a stream, so a block of items may be of any size. Blocks of ``per_item_block`` and
    ``per_query_block`` rows are made up to ``SPREAD`` of either, which bounds how often a row is copied; larger tables
    have larger blocks, and only more than ``SPREAD * held`` queries mean more of them. Items come by ``order``, and
    ``spread`` is another bound for their blocks. Few queries meet more blocks of items, as long as the copies
    stay below ``COPIES`` and the number of items, so a task does not hold more of a larger table. Nothing passes through the driver.

    ``finish`` makes the result of whole queries from what their blocks give. With it, blocks of queries are gone through in
    rounds of at most ``copied`` copies of items (one block at least), each of which leaves only its finished rows on disk.
    The items are written for that, unless they are ``stored`` already.
    """
    n, m = (df.select(key).agg(F.count(F.lit(1))).first()[0] for df, key in ((queries, query_id), (items, item_id)))
    n_items = max(1, min(-(-m // per_item_block), max(spread, min(m, COPIES) // max(n, 1))))
    n_queries = max(1, min(-(-n // per_query_block), SPREAD), -(-n // held))

    def side(df: DataFrame, other: DataFrame, key: str, asks: bool, turn: range) -> DataFrame:
        own = F.pmod(F.xxhash64(key), F.lit(n_queries if asks else n_items)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(n_items - 1)) if asks else F.sequence(F.lit(turn[0]), F.lit(turn[-1])))
        df = df.withColumn("_own", own)
        if asks and len(turn) < n_queries:
            df = df.filter(F.col("_own").between(turn[0], turn[-1]))
        df = df.withColumn("_each", each)
        missing = [F.lit(None).cast(t).alias(c) for c, t in other.dtypes if c not in df.columns]
        block = [F.col("_each").alias("_i"), F.col("_own").alias("_q")] if asks else [F.col("_own").alias("_i"), F.col("_each").alias("_q")]
        return df.select(*block, F.lit(not asks).alias("_item"), *[F.col(c) for c in df.columns if c not in ("_own", "_each")], *missing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, meets = None, [], None
        for part in runs_in(batches, 3):
            pair, is_item = (part["_i"][0].as_py(), part["_q"][0].as_py()), part["_item"][0].as_py()
            if pair != key:
                if meets is not None and (out := meets.result()) is not None and out.num_rows:
                    yield out
                key, asked, meets = pair, [], None
            if not is_item:
                asked.append(part)
                continue
            if meets is None and asked:
                meets, asked = scorer(pa.concat_tables(asked).combine_chunks()), []
            if meets is not None:
                for a in range(0, len(part), STRETCH):
                    meets.add(part.slice(a, STRETCH))
        if meets is not None and (out := meets.result()) is not None and out.num_rows:
            yield out

    def met(turn: range) -> DataFrame:
        both = side(items, queries, item_id, False, turn).unionByName(side(queries, items, query_id, True, turn))
        # queries come first in their pair of blocks
        both = both.repartition("_i", "_q").sortWithinPartitions("_i", "_q", "_item", *order)
        return both.mapInArrow(run, schema)

    if finish is None:
        return met(range(n_queries))
    at_once = max(1, (copied or COPIED) // max(m, 1))
    if at_once >= n_queries:
        return finish(met(range(n_queries)))
    items, queries = items if stored else cut(items, "blocks-items"), cut(queries, "blocks-queries")
    turns = [range(a, min(a + at_once, n_queries)) for a in range(0, n_queries, at_once)]
    return reduce(DataFrame.unionByName, [cut(finish(met(turn)), "blocks-best") for turn in turns])

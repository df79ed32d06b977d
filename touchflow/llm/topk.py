"""Exact top-k inner products with KD-trees.

Vectors are dealt by hash to shards of a bounded number of rows. Each shard is a KD-tree: median
splits of the widest dimension, each node with the tight box of its vectors. No vector in a box has
a larger inner product with a query than the box's best corner, so a traversal that takes nodes in
order of that bound may stop once the bound is below the query's k-th score. Queries are taken in
blocks; a first pass over one shard gives every query a k-th score, which the pass over the other
shards starts with and tightens. What a shard cannot improve is never returned.

Scores are integers: components x become floor(scale * x). They are computed in doubles while every
partial sum is below 2**53 and in 64-bit integers beyond; a score beyond 64 bits is an error.

Edge cases: vectors that are null or hold a null or non-finite component and rows without an id
take no part; every row of a repeated id is a candidate, of other ids' queries only, and a query
id of several rows gets the best of all of them; vectors are only compared with those of their own
length; ties go to the smaller id; with fewer than k candidates all are returned; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchflow.session import stored

SCALE = 256.0
#: Vectors of a shard at most, of a leaf, and queries of a block.
SHARD, LEAF, BLOCK = 65_536, 64, 256
#: Fewer vectors make smaller shards, so that there are tasks enough, but not below this size.
SMALL, TASKS = 4096, 64
_EXACT = 2.0 ** 53
#: No score yet; its negative still is an integer of 64 bits.
_NONE = -(2 ** 63) + 1


def shard_count(n: F.Column, shard: int = SHARD) -> F.Column:
    """Blocks of queries are sent to every shard, so shards are as few as memory and tasks allow."""
    return F.greatest(F.ceil(n / shard), F.least(F.lit(TASKS), F.ceil(n / SMALL))).cast("int")


def vectors(table: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, dim, vector) of the usable rows, with vectors of integers in doubles."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (
            F.abs(v.cast("double")) == float("inf")))
    return table.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"),
                                      F.size("embedding").alias("dim"), x.alias("vector"))


class Tree:
    """Nodes in arrays: box, range of rows, children (-1 in a leaf)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(ids))
        self.children: list[tuple[int, int]] = []
        self.span: list[tuple[int, int]] = []
        low, high = [], []

        def grow(begin: int, end: int) -> int:
            own = rows[order[begin:end]]
            number = len(self.span)
            self.span.append((begin, end))
            self.children.append((-1, -1))
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            width = high[-1] - low[-1]
            if end - begin > leaf and width.size and width.max() > 0:
                middle = (end - begin) // 2
                part = np.argpartition(own[:, int(width.argmax())], middle)
                order[begin:end] = order[begin:end][part]
                self.children[number] = (grow(begin, begin + middle), grow(begin + middle, end))
            return number

        grow(0, len(ids))
        self.low, self.high = np.array(low), np.array(high)
        self.ids, self.rows = ids[order], rows[order]


class Best:
    """The k best (score, id) of each query of a block, and the score to beat."""

    def __init__(self, queries: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.k = k
        self.scores = np.full((len(queries), 0), 0, queries.dtype)
        self.ids = np.zeros((len(queries), 0), np.int64)
        self.floor = floor  # of earlier passes; equal scores may still win by id
        self.kth = floor.copy()

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Offers candidates ``ids`` with ``scores`` (query, candidate) to the queries ``at``."""
        least = -np.inf if scores.dtype == np.float64 else _NONE
        if self.scores.shape[1] < self.k:
            grow = self.k - self.scores.shape[1]
            self.scores = np.pad(self.scores, ((0, 0), (0, grow)), constant_values=least)
            self.ids = np.pad(self.ids, ((0, 0), (0, grow)),
                              constant_values=np.iinfo(np.int64).max)
        scores = np.where(ids[None, :] == own[:, None], least, scores)
        all_scores = np.concatenate([self.scores[at], scores], axis=1)
        all_ids = np.concatenate([self.ids[at], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :self.k]
        rows = np.arange(len(at))[:, None]
        self.scores[at], self.ids[at] = all_scores[rows, order], all_ids[rows, order]
        self.kth[at] = np.maximum(self.floor[at], self.scores[at, -1])


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """Best-first for a block: the node with the best bound of any query comes next, and only
    queries whose bound reaches their k-th score go on into it."""
    best = Best(queries, floor, k)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = up @ tree.high.T + down @ tree.low.T  # best corner of every box
    heap = [(-bounds[:, 0].max(), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        at = np.flatnonzero(bounds[:, node] >= best.kth)
        if not len(at):
            continue
        left, right = tree.children[node]
        if left < 0:
            begin, end = tree.span[node]
            best.add(at, queries[at] @ tree.rows[begin:end].T, tree.ids[begin:end], ids[at])
        else:
            for child in (left, right):
                heapq.heappush(heap, (-bounds[at, child].max(), child))
    return best


def _search_shards(k: int):
    """Rows come shard by shard: first its vectors, then the query blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, held, integers = None, None, ([], []), False
        for batch in batches:
            found = ([], [], [])
            for row in batch.to_pylist():
                key = (row["dim"], row["shard"])
                if key != at:
                    at, tree, held = key, None, ([], [])
                if row["block"] is None:
                    held[0].append(row["ids"])
                    held[1].append(row["data"])
                    continue
                dim = row["dim"]
                if tree is None:
                    ids = np.frombuffer(b"".join(held[0]), "<i8")
                    rows = np.frombuffer(b"".join(held[1]), "<f8").reshape(len(ids), dim)
                    large = float(np.abs(rows).max(initial=0.0))
                    tree, held = Tree(ids, rows), ([], [])
                own = np.frombuffer(row["ids"], "<i8")
                queries = np.frombuffer(row["data"], "<f8").reshape(len(own), dim)
                floor = np.frombuffer(row["floor"], "<f8")
                bound = dim * large * float(np.abs(queries).max(initial=0.0))
                if bound >= _EXACT:
                    if bound >= 2.0 ** 63:
                        raise OverflowError("an inner product may not fit 64 bits")
                    whole = Tree(tree.ids, tree.rows.astype(np.int64))
                    limit = np.where(np.isfinite(floor), floor, float(-2 ** 62)).astype(np.int64)
                    best = search(whole, own, queries.astype(np.int64), limit, k)
                    good = best.scores > _NONE
                else:
                    best = search(tree, own, queries, floor, k)
                    good = np.isfinite(best.scores)
                good &= best.scores >= best.floor[:, None]
                q, c = np.nonzero(good)
                found[0].append(own[q])
                found[1].append(best.ids[q, c])
                found[2].append(best.scores[q, c].astype(np.int64))
            if found[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in found], ["query_id", "vec_id", "score"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, shard, block, vec_id, vector, floor) sorted by group into one row per group and batch."""
    for batch in batches:
        columns = batch.to_pydict()
        keys = list(zip(columns["dim"], columns["shard"], columns["block"]))
        values = batch["vector"].values.to_numpy(zero_copy_only=False)
        offsets = np.asarray(batch["vector"].offsets)
        ids = batch["vec_id"].to_numpy(zero_copy_only=False).astype("<i8")
        floor = batch["floor"].to_numpy(zero_copy_only=False).astype("<f8")
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        rows = [(*keys[a], ids[a:b].tobytes(), values[offsets[a]:offsets[b]].astype("<f8").tobytes(),
                 floor[a:b].tobytes()) for a, b in zip(starts, starts[1:]) if b > a]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)],
                ["dim", "shard", "block", "ids", "data", "floor"])


_PACKED = "dim int, shard int, block long, ids binary, data binary, floor binary"


def _packed(rows: DataFrame) -> DataFrame:
    """Groups of rows as arrays of bytes; a group is at most a block or a shard."""
    return rows.repartition("dim", "shard", "block") \
        .sortWithinPartitions("dim", "shard", "block", "vec_id").mapInArrow(_pack, _PACKED)


def _pass(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    both = shards.unionByName(queries)
    return both.repartition("dim", "shard").sortWithinPartitions(
        "dim", "shard", F.col("block").asc_nulls_first()) \
        .mapInArrow(_search_shards(k), "query_id long, vec_id long, score long")


def top_k(table: DataFrame, is_query, k: int = 5, scale: float = SCALE, shard: int = SHARD,
          block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other vectors of each query.

    ``is_query`` is a condition on ``vec_id``. Data moved: every vector three times, and every
    block of queries once per shard.
    """
    # ``deal`` spreads the rows of a repeated id.
    rows = stored(vectors(table, scale).withColumn("deal", F.monotonically_increasing_id()),
                  "topk-vectors")
    sizes = rows.groupBy("dim").agg(
        shard_count(F.count(F.lit(1)), shard).alias("shards"),
        F.count(F.when(is_query, 1)).alias("asked"))  # one row per length of vectors
    count = rows.join(sizes, "dim")
    none = F.lit(None).cast("long")
    shards = stored(_packed(count.select(
        "dim", F.pmod(F.xxhash64("vec_id", "deal"), F.col("shards")).cast("int").alias("shard"),
        none.alias("block"), "vec_id", "vector", F.lit(0.0).alias("floor"))), "topk-shards")
    asked = count.where(is_query).withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), "vec_id", "deal"), F.ceil(F.col("asked") / block)))

    # First pass: the block's own shard, for a k-th score of each query.
    home = F.pmod(F.xxhash64("block"), F.col("shards")).cast("int")
    first = asked.withColumn("shard", home)
    begin = _packed(first.select("dim", "shard", "block", "vec_id", "vector",
                                 F.lit(float("-inf")).alias("floor")))
    early = stored(_pass(shards, begin, k), "topk-first")
    kth = early.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")) \
        .select(F.col("query_id").alias("vec_id"), F.when(
            F.col("n") >= k, F.col("least").cast("double")).otherwise(float("-inf")).alias("floor"))
    # Second pass: all other shards, with that score to beat.
    rest = first.join(kth, "vec_id", "left").select(
        "dim", "block", "vec_id", "vector", "shards", F.col("shard").alias("home"),
        F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    rest = _packed(rest.select("dim", F.col("home").alias("shard"), "block", "vec_id", "vector",
                               "floor"))
    others = rest.join(sizes.select("dim", "shards"), "dim").withColumn(
        "to", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))) \
        .where("`to` <> shard").select("dim", F.col("to").alias("shard"), "block", "ids", "data",
                                       "floor")
    late = _pass(shards, others, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return early.unionByName(late).withColumn("rank", F.row_number().over(order)) \
        .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

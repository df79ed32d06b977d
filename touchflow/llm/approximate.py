"""Approximate nearest neighbours with learned partitions.

A sample of at most ``SAMPLE`` distinct vectors of each length is cut into balanced parts along its
neighbour graph, and a small network learns which parts hold a vector's neighbours (``routes``).  Every
row is indexed under the part it is most probably in.  A query goes to its most probable parts, as many
as hold a given share ``mass`` of its probability and two at least, and is compared there with all rows:
distances are those of the original vectors in double precision.

``mass`` is set by measurement: for up to ``AUDIT`` of the queries all rows are compared, and the mass is
the least that finds ``TARGET`` of their true neighbours; the recall reached is returned with every
row.  Vectors without structure need most parts for that, clustered ones few.

Rows of a part are dealt to shards of a bounded size, in turn, so neither a large part nor many
copies of a row are one task's work; queries stream past a shard, and each shard returns at most k
rows per query.  The driver gets the sample, the audit queries and their neighbours.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components and rows without
an id take no part; vectors are compared with those of their own length only; rows under the query's
own id are no candidates, and a query id of several rows gets the nearest of all of them; repeated rows
are candidates each; ties go to the smaller id; with fewer than k candidates all are returned; a
component of 1e150 or more is an error; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchflow.llm import routes
from touchflow.session import stored

K = 10
#: Parts at most, sample vectors of each part, and both together.
PARTS, EACH = 128, 128
SAMPLE = PARTS * EACH
#: Numbers that the vectors of a shard hold at most.
SHARD = 1 << 21
#: Queries whose neighbours are searched in all rows, and the share of these to be found.
AUDIT, TARGET = 256, 0.95
#: Distances from products of matrices are off by so much of the squared lengths.
_SLACK = 1e-11
_KEY = ["dim", "part", "shard"]
_LARGE = 1e150


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, dim, vector) of the usable rows; components keep their type."""
    def size(v):
        return F.abs(v.cast("double"))

    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (
            size(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    checked = F.when(F.exists("embedding", lambda v: size(v) >= _LARGE), F.raise_error(F.lit(
        "a component of 1e150 or more")).cast("int")).otherwise(F.size("embedding"))
    return table.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"),
                                      checked.alias("dim"), F.col("embedding").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def some(rows: DataFrame, count: int, limit: int, salt: int) -> np.ndarray:
    """Up to ``limit`` distinct vectors of about ``count`` rows of one length, the first by a hash.

    Only hashes in a range that holds enough of them are looked at, so few rows are shuffled.
    """
    number = F.xxhash64(F.lit(salt), "vector")
    keyed = rows.select(F.pmod(number, F.lit(1 << 40)).alias("hash"), "vector")
    if 8 * limit < count:
        keyed = keyed.where(F.col("hash") < int(8 * limit / count * 2 ** 40))
    found = keyed.distinct().orderBy("hash", "vector").limit(limit).select("vector").toArrow()
    return _matrix(found["vector"].combine_chunks()) if found.num_rows else np.empty((0, 0))


def routers(rows: DataFrame) -> dict[int, tuple[int, routes.Router | None]]:
    """Rows and router of every length; none where one part holds everything."""
    found = {}
    for dim, count in rows.groupBy("dim").count().collect():
        parts = min(PARTS, 1 << max(0, int(np.log2(max(1, count / EACH)))))
        sample = some(rows.where(F.col("dim") == dim), count, parts * EACH, 1) if parts > 1 else []
        while parts > 1 and len(sample) < 16 * parts:
            parts //= 2
        found[dim] = (count, routes.fit(sample, parts) if parts > 1 else None)
    return found


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, vectors) of up to 4096 rows of one length."""
    dims = batch["dim"].to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        places = np.flatnonzero(dims == dim)
        for at in range(0, len(places), 4096):
            own = places[at:at + 4096]
            yield int(dim), own, _matrix(batch["vector"].take(pa.array(own)))


def _indexed(models: dict):
    """(dim, part, deal, vec_id, vector): ``deal`` counts the rows of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            part = np.zeros(batch.num_rows, np.int32)
            for dim, own, x in _groups(batch):
                router = models[dim][1]
                if router is not None:
                    part[own] = router.probabilities(x).argmax(axis=1)
            deal = np.arange(seen, seen + batch.num_rows, dtype=np.int64)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch["dim"], pa.array(part), pa.array(deal), batch["vec_id"], batch["vector"]],
                ["dim", "part", "deal", "vec_id", "vector"])

    return run


def masses(router: routes.Router, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of each vector, the most probable first, and the probability of those before each."""
    chance = router.probabilities(x)
    order = np.argsort(-chance, axis=1, kind="stable")
    ranked = np.take_along_axis(chance, order, axis=1)
    return order, np.cumsum(ranked, axis=1) - ranked


def _routed(models: dict, mass: dict[int, float]):
    """(dim, part, vec_id, vector) of each query and part it goes to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own, x in _groups(batch):
                router = models[dim][1]
                if router is None:
                    row, part = np.arange(len(own)), np.zeros(len(own), np.int64)
                else:
                    order, before = masses(router, x)
                    row, rank = np.nonzero((before <= mass[dim])
                                           | (np.arange(router.parts)[None, :] < 2))
                    part = order[row, rank]
                for at in range(0, len(row), 4096):
                    at = slice(at, at + 4096)
                    take = pa.array(own[row[at]])
                    yield pa.RecordBatch.from_arrays(
                        [batch["dim"].take(take), pa.array(part[at].astype(np.int32)),
                         batch["vec_id"].take(take), batch["vector"].take(take)],
                        ["dim", "part", "vec_id", "vector"])

    return run


def nearest(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int
            ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, distances) of the k nearest of ``x`` by distance and id."""
    norms = (x * x).sum(axis=1)
    for at in range(0, len(queries), 256):
        part = queries[at:at + 256]
        lengths = (part * part).sum(axis=1)
        near = lengths[:, None] + norms[None, :] - 2 * part @ x.T
        near[own[at:at + 256, None] == ids[None, :]] = np.inf
        if len(ids) > k:
            limit = np.partition(near, k - 1, axis=1)[:, k - 1]
        else:
            limit = np.full(len(part), np.inf)
        limit = limit + _SLACK * (lengths + norms.max(initial=0.0))
        for row in range(len(part)):
            places = np.flatnonzero((near[row] <= limit[row]) & (near[row] < np.inf))
            exact = np.sqrt(((x[places] - part[row]) ** 2).sum(axis=1))
            first = np.lexsort((ids[places], exact))[:k]
            yield at + row, places[first], exact[first]


_FOUND = "query_id bigint, vec_id bigint, score double"


def _searched(k: int):
    """Rows come shard by shard, first its vectors, then the queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in _KEY], axis=1)
            kind = batch["query"].to_numpy(zero_copy_only=False)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(keys)]):
                if b <= a:
                    continue
                if tuple(keys[a]) != at:
                    at, held, shard = tuple(keys[a]), [], None
                ids = batch["vec_id"][a:b].to_numpy(zero_copy_only=False)
                x = _matrix(batch["vector"][a:b])
                if not kind[a]:
                    held.append((ids, x))
                    continue
                if not held:
                    continue
                if shard is None:
                    shard = tuple(np.concatenate(c) for c in zip(*held))
                rows = [(ids[q], shard[0][p], s)
                        for q, p, s in nearest(shard[1], shard[0], x, ids, k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
                              .astype(np.int64)),
                     pa.array(np.concatenate([r[1] for r in rows])),
                     pa.array(np.concatenate([r[2] for r in rows]))],
                    ["query_id", "vec_id", "score"])

    return run


def _audited(queries: np.ndarray, dim: int, k: int):
    """The k nearest rows of a task to each audited query, with their parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own, x in _groups(batch):
                ids = batch["vec_id"].take(pa.array(own)).to_numpy(zero_copy_only=False)
                part = batch["part"].take(pa.array(own)).to_numpy(zero_copy_only=False)
                nobody = np.full(len(queries), -1)
                found = list(nearest(x, np.arange(len(x)), queries, nobody, k + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                              .astype(np.int32)),
                     pa.array(ids[np.concatenate([f[1] for f in found])]),
                     pa.array(part[np.concatenate([f[1] for f in found])]),
                     pa.array(np.concatenate([f[2] for f in found]))],
                    ["query", "vec_id", "part", "score"])

    return run


def _first(rows: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def needed_mass(index: DataFrame, queries: DataFrame, dim: int, count: int, router: routes.Router,
                k: int, target: float) -> tuple[float, float]:
    """The mass that finds the target share of true neighbours, and the share it finds.

    An audited query's own row is the nearest to it, at distance 0; it and copies of it are left to
    the k + 1 nearest, of which the first is not counted.
    """
    audit = some(queries.where(F.col("dim") == dim), count, AUDIT, 2)
    if not len(audit):
        return 1.0, 1.0
    near = _first(index.where(F.col("dim") == dim).mapInArrow(
        _audited(audit, dim, k), "query int, vec_id bigint, part int, score double"), "query", k + 1) \
        .where("rank > 1").select("query", "part").collect()  # AUDIT * k rows
    order, before = masses(router, audit)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(router.parts)[None, :], axis=1)
    query, part = np.array([r["query"] for r in near]), np.array([r["part"] for r in near])
    rank = place[query, part]
    needed = np.where(rank < 2, 0.0, before[query, rank])
    mass = float(np.sort(needed)[max(0, int(np.ceil(target * len(needed))) - 1)])
    return mass, float((needed <= mass).mean())


def search(table: DataFrame, is_query: F.Column, k: int = K, target: float = TARGET,
           shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score, recall): the k nearest found of each query's rows."""
    rows = vectors(table)
    models = routers(rows)
    kind = rows.schema["vector"].dataType.simpleString()
    index = stored(rows.mapInArrow(
        _indexed(models), f"dim int, part int, deal bigint, vec_id bigint, vector {kind}"),
        "partitions")
    queries = index.where(is_query).select("dim", "vec_id", "vector")
    asked = {r["dim"]: r["count"] for r in queries.groupBy("dim").count().collect()}
    mass, recall = {}, {dim: 1.0 for dim in models}
    for dim, (_, router) in models.items():
        if router is not None and dim in asked:
            mass[dim], recall[dim] = needed_mass(
                index, queries, dim, asked[dim], router, k, target)
    cut = F.ceil(F.count(F.lit(1)) * F.col("dim") / shard).cast("int").alias("cut")
    cuts = stored(index.groupBy("dim", "part").agg(cut), "partition-shards")
    candidates = index.join(cuts, ["dim", "part"]).select(
        "dim", "part", F.pmod("deal", "cut").cast("int").alias("shard"),
        F.lit(False).alias("query"), "vec_id", "vector")
    sent = queries.mapInArrow(
        _routed(models, mass), f"dim int, part int, vec_id bigint, vector {kind}") \
        .join(cuts, ["dim", "part"]).select(
            "dim", "part", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("shard"),
            F.lit(True).alias("query"), "vec_id", "vector")
    found = candidates.unionByName(sent).repartition(*_KEY) \
        .sortWithinPartitions(*_KEY, "query").mapInArrow(_searched(k), _FOUND)
    worst = min(recall.values(), default=1.0)
    return _first(found, "query_id", k).select("query_id", "rank", "vec_id", "score",
                                               F.lit(worst).alias("recall"))

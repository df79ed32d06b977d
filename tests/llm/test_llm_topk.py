import numpy as np
import pytest
from pyspark.sql import functions as F

from touchflow.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, dim string"


def brute(rows, every, k=5):
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows
             if i is not None and e is not None and all(
                 x is not None and np.isfinite(x) for x in e)]
    scores, out = {}, []
    for q, v in whole:
        if q % every == 0:
            scores.setdefault(q, []).extend(
                (-sum(a * b for a, b in zip(v, w)), i) for i, w in whole
                if i != q and len(w) == len(v))
    for q, found in scores.items():
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def run(spark, rows, every=5, **options):
    table = spark.createDataFrame([(i, e, 1, "r", "d") for i, e in rows], SCHEMA)
    found = topk.top_k(table, F.col("vec_id") % every == 0, **options)
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score"))
                  for r in found.collect())


@pytest.mark.parametrize("shard, block", [(4096, 256), (40, 8), (7, 3)])
def test_equals_brute_force(spark, shard, block):
    draw = np.random.default_rng(0)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    assert run(spark, rows, shard=shard, block=block) == brute(rows, 5)


def test_unusable_and_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (5, [0.5, -0.5]), (6, None), (7, [1.0, None]), (8, [float("nan"), 1.0]),
            (9, [float("inf"), 0.0]), (None, [1.0, 1.0]), (10, [1.0, 1.0, 1.0]), (11, [2.0, 0.0]),
            (11, [1.0, 0.0]), (11, [1.0, 0.0]), (15, []), (16, [])]
    assert run(spark, rows) == brute(rows, 5)


def test_large_components_are_exact(spark):
    rows = [(i, [3e5 + i, 2.9e5 - 3 * i, 1.0]) for i in range(30)]
    rows += [(100 + i, [8e5 + 64 * i, -8e5]) for i in range(10)]
    assert run(spark, rows, shard=8) == brute(rows, 5)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_boxes_are_tight_and_bounds_hold():
    draw = np.random.default_rng(1)
    rows = np.floor(draw.normal(size=(500, 5)) * 100)
    tree = topk.Tree(np.arange(500), rows, leaf=16)
    q = draw.normal(size=5)
    for (begin, end), low, high in zip(tree.span, tree.low, tree.high):
        own = tree.rows[begin:end]
        assert (own.min(axis=0) == low).all() and (own.max(axis=0) == high).all()
        assert (own @ q).max() <= np.maximum(q, 0) @ high + np.minimum(q, 0) @ low + 1e-9
    assert sorted(tree.ids) == list(range(500))


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (1, [3.0, 3.0])]
    assert run(spark, rows) == [(0, 1, 1, 589824), (0, 2, 1, 65536)]
    draw = np.random.default_rng(4)
    rows = [(i % 7, draw.normal(size=3).tolist()) for i in range(150)]
    rows += [(5, rows[0][1])] * 90  # a hot query id with equal rows
    assert run(spark, rows, shard=30, block=8) == brute(rows, 5)

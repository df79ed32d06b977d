import numpy as np
import pytest
from pyspark.sql import functions as F

from touchflow.llm import approximate, queries, routes

SCHEMA = "vec_id long, embedding array<double>, label int, part string, dim string, query string"


def brute(rows, every, k=10):
    usable = [(i, np.array(e)) for i, e in rows if i is not None and e and any(e) and all(
        c is not None and np.isfinite(c) for c in e)]
    out = {}
    for q, v in usable:
        if q % every == 0:
            out.setdefault(q, []).extend(
                (float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in usable
                if i != q and len(w) == len(v))
    return {q: sorted(near)[:k] for q, near in out.items() if near}


def run(spark, rows, every=5, **options):
    table = spark.createDataFrame([(i, e, 1, "p", "d", "q") for i, e in rows], SCHEMA)
    found = {}
    for r in approximate.search(table, F.col("vec_id") % every == 0, **options) \
            .orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def recall(found, expected):
    hit = sum(len({i for _, i in found.get(q, [])} & {i for _, i in near})
              for q, near in expected.items())
    return hit / sum(map(len, expected.values()))


def clusters(n, seed=0, spread=0.3, dim=12):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(20, dim)) * 2
    return [(i, (centres[draw.integers(20)] + spread * draw.normal(size=dim)).tolist())
            for i in range(n)]


def exact_scores(found, rows):
    vectors = {i: np.array(e) for i, e in rows}
    return all(s == float(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum()))
               for q, near in found.items() for s, i in near)


def test_recall_on_clusters(spark):
    rows = clusters(3000)
    found, expected = run(spark, rows, 20), brute(rows, 20)
    assert recall(found, expected) >= 0.9 and exact_scores(found, rows)
    assert all(near == sorted(near) and len(near) == 10 for near in found.values())


def test_recall_without_structure(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=24).tolist()) for i in range(2500)]
    found, expected = run(spark, rows, 10), brute(rows, 10)
    assert recall(found, expected) >= 0.9


@pytest.mark.parametrize("shard", [1 << 21, 60])
def test_one_part_is_exact(spark, shard):
    rows = clusters(120, 2, dim=3) + [(1000 + i, [1.0, 2.0, 3.0]) for i in range(80)]
    assert run(spark, rows, shard=shard) == brute(rows, 5)


def test_copies_are_a_large_part(spark):
    rows = clusters(1500, 3) + [(10_000 + i, clusters(1, 4)[0][1]) for i in range(900)]
    found, expected = run(spark, rows, 25, shard=1200), brute(rows, 25)
    assert recall(found, expected) >= 0.9


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, [0.5, -0.5]), (6, None), (7, [1.0, None]), (8, [float("nan"), 1.0]),
            (9, [float("inf"), 0.0]), (None, [1.0, 1.0]), (10, [1.0, 1.0, 1.0]), (11, [2.0, 0.0]),
            (11, [1.0, 0.0]), (11, [1.0, 0.0]), (15, []), (16, [0.0, 0.0]), (5, [4.0, 4.0])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == {} and run(spark, [(5, [1.0])]) == {}
    with pytest.raises(Exception, match="1e150"):
        run(spark, [(0, [1e151]), (1, [1.0])])


def test_parts_are_balanced_and_follow_the_graph():
    x = np.array([v for _, v in clusters(1024, 5)])
    near = routes.neighbours(x)
    part = routes.partition(near, 8)
    assert set(np.bincount(part)) == {128}
    inside = (part[near] == part[:, None]).mean()
    assert inside > 0.7  # 0.125 by chance
    router = routes.fit(x, 8)
    order, before = approximate.masses(router, x)
    assert (order[:, 0] == part).mean() > 0.8
    assert np.allclose(before[:, 0], 0) and (np.diff(before, axis=1) >= 0).all()


def test_query_reaches_its_recall(spark):
    folder = "/root/testdata/sf0.1"
    found = {}
    for r in queries.op12_learned_partitions(spark, folder).collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["recall"] >= 0.9
    rows = [(r["vec_id"], r["embedding"])
            for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert recall(found, brute(rows, 100)) >= 0.9

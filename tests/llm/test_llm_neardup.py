import numpy as np
import pytest
from pyspark.sql import functions as F

from touchflow.llm import neardup

SCHEMA = "vec_id long, embedding array<float>, label int, node string, root string, n_links string"


def brute(rows):
    def usable(e, label):
        return label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
    good = [i for i, (_, e, label) in enumerate(rows) if usable(e, label)]
    links = {i: set() for i in range(len(rows))}
    for a in good:
        for b in good:
            (_, x, p), (_, y, q) = rows[a], rows[b]
            if a != b and p == q and len(x) == len(y):
                x, y = np.float32(x).astype(float), np.float32(y).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a].add(b)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            for j in links[queue.pop()] - seen:
                seen.add(j)
                queue.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec, len(links[i]), least, vec == least))
    return sorted(out, key=repr)


def run(spark, rows):
    table = spark.createDataFrame([(*r, "n", "r", "l") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in neardup.near_duplicates(table).collect()), key=repr)


def clustered(seed=0):
    draw = np.random.default_rng(seed)
    rows = [(i, draw.normal(size=16).tolist(), i % 3) for i in range(300)]
    centre = draw.normal(size=16)
    rows += [(1000 + i, (centre + 0.12 * draw.normal(size=16)).tolist(), 1) for i in range(150)]
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(10)]  # exact copies
    rows += [(3000 + i, (np.array(rows[i][1]) * 2 + 0.1).tolist(), rows[i][2]) for i in range(40)]
    return rows


def test_equals_brute_force(spark):
    rows = clustered()
    assert run(spark, rows) == brute(rows)


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    rows = clustered(1)
    assert run(spark, rows) == brute(rows)


def test_unusable_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None),
            (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1),
            (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)]
    assert run(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, [1.0], 1)]) == [(4, 0, 4, True)]


def test_the_audit_sees_missing_links(spark):
    rows = clustered(2)
    table = spark.createDataFrame([(*r, "n", "r", "l") for r in rows], SCHEMA)
    _, raw = neardup.nodes_of(table)
    nodes = raw.select("node", "label", "first", "times", "v").mapInArrow(
        neardup._encode, neardup._NODES)
    apart = nodes.selectExpr("*", "node AS root")
    assert neardup.audited_recall(apart, 0.93) == pytest.approx(0.0)


def test_one_link_between_two_dense_clusters_is_found(spark):
    """All 30 nearest of either end are in its own cluster."""
    angle = np.arccos(0.93) * 0.999
    draw = np.random.default_rng(3)
    rows = []
    for cluster, at in enumerate((0.0, angle)):
        for i in range(30):  # behind the ends, seen from the other cluster
            turn = 0.02 * i * (1 if cluster else -1)
            v = [np.cos(at + turn), np.sin(at + turn), *(1e-4 * draw.normal(size=6))]
            rows.append((100 * cluster + i, [float(x) for x in v], 1))
    rows += [(1000 + i, draw.normal(size=8).tolist(), 1) for i in range(100)]
    expected = brute(rows)
    assert {c for i, _, c, _ in expected if i < 200} == {0}
    assert run(spark, rows) == expected


def test_audit_counts_nodes_and_not_links_only(spark):
    draw = np.random.default_rng(2)

    def near(centre, n):
        rows = centre + draw.normal(size=(n, 32)) * 0.02
        return [r / np.linalg.norm(r) for r in rows]

    big = [(v, 0) for v in near(np.eye(32)[0], 600)]
    pairs = [(v, 1000 + 2 * i + k) for i in range(60)  # no pair is in one component
             for k, v in enumerate(near(draw.normal(size=32) / 32 ** 0.5, 2))]
    rooted = spark.createDataFrame(
        [(i, 1, 32, root, v.astype("<f8").tobytes()) for i, (v, root) in enumerate(big + pairs)],
        "node long, label long, dim int, root long, exact binary")
    assert neardup.audited_recall(rooted, 0.93) == 0.0
    whole = rooted.withColumn("root", F.when(F.col("root") < 1000, 0).otherwise(
        F.floor(F.col("root") / 2)).cast("long"))
    assert neardup.audited_recall(whole, 0.93) == 1.0

from fractions import Fraction

import numpy as np
import pytest

from touchflow.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n string, dim string"


def brute(rows, components=16):
    """Means and covariances as fractions, one length at a time."""
    usable = [(i, [float(c) for c in e]) for i, e in rows
              if e and all(c is not None and np.isfinite(c) for c in e)]
    whole = [(i, tuple(int(np.floor(64 * c)) + 1_000_000 for c in e)) for i, e in usable]
    out = []
    for dim in {len(x) for _, x in whole}:
        own = [(i, x) for i, x in whole if len(x) == dim]
        distinct = sorted({x for _, x in own})
        n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
        centred = [[Fraction(c) - Fraction(s, n) for c, s in zip(x, sums)] for x in distinct]
        matrix = np.array([[float(sum(r[a] * r[b] for r in centred) / n) for b in range(dim)]
                           for a in range(dim)])
        values, vectors = np.linalg.eigh(matrix)
        values, vectors = values[::-1], vectors[:, ::-1]
        for i, x in own:
            deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            z = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums)])
            for k in range(min(components, dim)):
                if values[k] > values[0] * 1e-12 and values[k] > 0:
                    out.append((i, k + 1, n, deviation, z @ vectors[:, k] / np.sqrt(values[k]),
                                values[k] / matrix.trace()))
    return out


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, e, 1, "x", "n", "d") for i, e in rows], SCHEMA)
    return whitening.whiten(table, **options).collect()


def agrees(found, expected):
    def key(r):
        return (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))

    assert len(found) == len(expected)
    got = sorted((tuple(r) for r in found), key=key)
    expected = sorted(expected, key=key)
    signs = {}
    for mine, theirs in zip(got, expected):
        assert mine[:4] == theirs[:4]
        assert mine[5] == pytest.approx(theirs[5], rel=1e-9) and mine[6] < 1e-6
        if abs(theirs[4]) > 1e-6:  # one sign per component of each length
            signs.setdefault((mine[1], mine[2]), []).append(np.sign(mine[4] * theirs[4]))
        assert abs(mine[4]) == pytest.approx(abs(theirs[4]), rel=1e-7, abs=1e-7)
    assert all(len(set(s)) == 1 for s in signs.values())


def test_equals_fractions(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(size=5) * [3, 2, 1, 0.5, 0.2]).tolist()) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(60)]  # copies count once
    agrees(run(spark, rows), brute(rows))


def test_odd_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=3).tolist()) for i in range(20)]
    rows += [(30, None), (31, [1.0, None, 0.0]), (32, [float("nan"), 0.0, 0.0]), (33, []),
             (34, [float("inf"), 0.0, 0.0]), (None, rows[0][1]), (35, [1.0]), (35, [1.0]), (36, [2.5]),
             (37, [0.0, 0.0])]
    agrees(run(spark, rows), brute(rows))
    agrees(run(spark, rows, components=2), brute(rows, 2))


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e12 * (i - 7) ** 2, float(i), -3e13 * i]) for i in range(15)]
    found = run(spark, rows)
    expected = {(r[0], r[1]): r[3] for r in brute(rows)}
    assert found and all(r["deviation"] == expected[r["vec_id"], r["component"]] for r in found)
    with pytest.raises(Exception, match="2\\*\\*50"):
        run(spark, [(1, [1e16]), (2, [0.0])])


def test_polarisation_is_the_covariance():
    draw = np.random.default_rng(3)
    x = draw.integers(-50, 50, (40, 4))
    squares = {(i, j): int((x[:, i] ** 2 if i == j else (x[:, i] + x[:, j]) ** 2).sum())
               for i in range(4) for j in range(i, 4)}
    matrix = whitening.covariance(40, [int(s) for s in x.sum(axis=0)], squares)
    assert np.allclose(matrix, np.cov(x.T, bias=True), rtol=1e-13, atol=1e-13)


def test_without_variance_or_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    line = [(i, [float(i), float(i), 5.0]) for i in range(9)]  # one component only
    agrees(run(spark, line), brute(line))


def test_query(spark):
    found = queries.op11_polarisation_whitening(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes)["deviation"] == "bigint"
    rows = found.collect()
    assert {r["component"] for r in rows} == set(range(1, 17))
    assert max(r["identity_error"] for r in rows) < 1e-8

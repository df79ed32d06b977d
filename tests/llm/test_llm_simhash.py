import random
import re

import numpy as np
import pytest
import xxhash

from touchflow.llm import simhash
from touchflow.llm.components import components

DOCS = "doc_id long, text string, fp string, root string, node string"


def slow(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t\n", "a", "A b", "É ß\x0bQ z\tU", "x y z", "a\x1cb c\x85d e",
                                  "the " * 50, "one two three four five", "İ ſ K k"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow(text)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    text = " ".join(random.Random(0).choices(["a", "b", "cc", "Ddd"], k=200))
    assert simhash.fingerprint(text) == slow(text)


def brute(prints):
    """Smallest position reachable from each by steps of at most three bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def planted(n=300, seed=4):
    draw = random.Random(seed)
    prints = {draw.getrandbits(64) for _ in range(n)}
    centre = draw.getrandbits(64)
    for _ in range(200):  # a dense ball and chains of copies
        prints.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))))
    for start in list(prints)[:30]:
        for _ in range(4):
            start ^= sum(1 << b for b in draw.sample(range(64), 3))
            prints.add(start)
    return sorted(prints)


@pytest.mark.parametrize("block", [4096, 32])
def test_components_of_links_equal_brute_force(spark, block):
    prints = planted()
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(
        simhash.links(nodes, block), "test").collect()}
    expected = brute(prints)
    found = {}
    for i, p in enumerate(signed):
        found.setdefault(roots.get(p, p), set()).add(i)
    groups = {}
    for i, r in enumerate(expected):
        groups.setdefault(r, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("n", [10 ** 3, 10 ** 6, 10 ** 9])
def test_any_plan_reaches_every_pair_within_the_radius(n):
    draw = np.random.default_rng(0)
    bits = draw.integers(0, 2, (500, 64))
    bits[:, 1] = bits[:, 0]  # two correlated bits
    both = (bits.T @ bits).astype(float) * n / 500
    plan = simhash.allocate(both, n)
    assert sum(t + 1 for _, t in plan) > simhash.RADIUS
    assert len({b for part, _ in plan for b in part}) == sum(len(part) for part, _ in plan)
    parts = simhash.correlated_parts(both, n, 4)
    assert any({0, 1} <= set(p) for p in parts)
    for _ in range(200):
        flips = set(draw.choice(64, 3, replace=False).tolist())
        assert any(len(flips & set(part)) <= t for part, t in plan)


def test_unequal_thresholds_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "allocate", lambda both, n: [
        (list(range(0, 22)), 1), (list(range(22, 43)), 0), (list(range(43, 64)), 0)])
    test_components_of_links_equal_brute_force(spark, 4096)


def test_groups_of_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(9, base), (4, base), (7, base + " tail"), (3, None), (2, ""), (8, " \n"), (None, base),
            (11, "alone in here"), (4, base), (None, "other words only")]
    docs = spark.createDataFrame([(*r, "f", "r", "n") for r in rows], DOCS)
    found = sorted(((r["doc_id"], r["fingerprint"], r["component_id"])
                    for r in simhash.groups(docs).collect()), key=repr)
    prints = [slow(t) for _, t in rows]
    roots = brute(prints)
    expected = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        expected.append((doc, f"{prints[i]:016x}", min(ids) if ids else None))
    assert found == sorted(expected, key=repr)

    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted((min(g, key=lambda d: (d is None, d)) for g in _ids(rows, roots)), key=repr)


def _ids(rows, roots):
    groups = {}
    for (doc, _), root in zip(rows, roots):
        groups.setdefault(root, []).append(doc)
    return groups.values()


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.groups(empty).collect() == [] and simhash.one_of_each(empty).collect() == []
    one = spark.createDataFrame([(1, "a b c", "", "", "")], DOCS)
    assert [r["component_id"] for r in simhash.groups(one).collect()] == [1]


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1001), (5, 5)],
                                  "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges, "chain").collect()}
    assert {roots[i] for i in range(401)} == {0} and roots[1001] == roots[1000] == 1000

"""Embedding near-duplicates by NN-descent.

Equal vectors of one label are one node. A first neighbour graph comes from random hyperplane cells
that are compared inside; each round then compares the neighbours of every node, in both
directions, with one another and keeps the nearest for each. Pairs at or above the threshold, verified in
double precision, are links. A node whose list holds nothing but links is saturated and may have
more: its list is enlarged by its component, whose pairs are all counted block by block, and by the
nearest nodes outside of it, which are searched in the same way until no saturated node finds a
link to another component. After each round recall is audited: for a fixed number of nodes all
others of their label are compared, and a linked pair counts as found if both are in one component.
Recall is the worst of the share of all links and of the mean share of a node's links, over nodes drawn
from all and from outside large components. Rounds go on until the target is met; each but the first
adds the nearest nodes in the cells of new hyperplanes to the lists.

Edge cases: vectors that are null, zero, empty or hold null or non-finite components, and those
without a label, are returned without links; vectors of different lengths never link; rows without
an id have no component and are kept; repeated rows are linked copies; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchflow.llm.components import components
from touchflow.session import released, stored

THRESHOLD = 0.93
NEIGHBOURS = 8
#: Hyperplane forests of the first graph, aimed size of a cell, largest cell compared at once.
TREES, CELL, BLOCK = 5, 192, 768
#: Neighbours of one node that are compared with one another at once.
JOIN = 48
#: Nodes of the recall audit, target, and rounds after which less than LEAST is an error.
AUDIT, TARGET, LEAST, ROUNDS = 256, 0.999, 0.9, 8
#: Members of a component that is not large to the audit.
SMALL = 64
SEED = 5
#: Single precision may be off by so much; links are decided in double precision.
SLACK = 1e-4


def _node(salt: int):
    return F.xxhash64(F.lit(salt), "label", "v")


def nodes_of(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as (vec_id, node), node null where unusable; and the nodes with their vectors."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = table.select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                        vector.alias("v"))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(
        "v", lambda x: x != 0)
    good = F.coalesce(usable, F.lit(False))
    salt = 0
    while True:
        keyed = rows.withColumn("node", F.when(good, _node(salt)))
        nodes = stored(keyed.where("node IS NOT NULL").groupBy("node").agg(
            F.min("label").alias("label"), F.min("v").alias("v"), F.min("vec_id").alias("first"),
            F.count(F.lit(1)).alias("times"),
            (F.min(F.struct("label", "v")) != F.max(F.struct("label", "v"))).alias("clash")),
            "neardup-nodes")
        if not nodes.where("clash").limit(1).count():  # two vectors with one hash
            return keyed.select("vec_id", "node"), nodes
        salt += 1


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch["v"].values.to_numpy(zero_copy_only=False)
        offsets = np.asarray(batch["v"].offsets)
        unit, exact = [], []
        for a, b in zip(offsets, offsets[1:]):
            v = values[a:b] / np.abs(values[a:b]).max()  # no overflow in the norm
            v = v / np.linalg.norm(v)
            exact.append(v.astype("<f8").tobytes())
            unit.append(v.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["node"], batch["label"], batch["first"], batch["times"],
             pa.array(np.diff(offsets), pa.int32()), pa.array(unit, pa.binary()),
             pa.array(exact, pa.binary())],
            ["node", "label", "first", "times", "dim", "unit", "exact"])


_NODES = ("node long, label long, first long, times long, dim int, unit binary, exact binary")


def _rows(blobs: list[bytes], kind: str = "<f4") -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


_CELL = ["tree", "code", "label", "dim", "node", "unit", "root", "wanted"]


def _cells(trees: int, seed: int):
    """(tree, code) of each node: signs at as many random hyperplanes as its label needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = batch["dim"].to_numpy(zero_copy_only=False)
            bits = batch["bits"].to_numpy(zero_copy_only=False)
            blobs = batch["unit"].to_pylist()
            for tree in range(trees):
                code = np.zeros(len(dims), np.int64)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    if (tree, dim) not in planes:
                        draw = np.random.default_rng([seed, tree, int(dim)])
                        planes[tree, dim] = draw.normal(size=(dim, 40)).astype(np.float32)
                    signs = _rows([blobs[i] for i in at]) @ planes[tree, dim] > 0
                    used = np.arange(40)[None, :] < bits[at][:, None]
                    code[at] = (signs & used) @ (1 << np.arange(40, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(dims), tree, np.int32)), pa.array(code),
                     *(batch[c] for c in _CELL[2:])], _CELL)

    return run


_FOUND = "node long, nbr long, sim float"


def _found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if parts:
        columns = [np.concatenate(c) for c in zip(*parts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0]), pa.array(columns[1]),
             pa.array(columns[2].astype(np.float32))], ["node", "nbr", "sim"])


def _nearest(k: int):
    """The k nearest members of a cell outside a member's component, for the wanted ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for members in batch["members"]:
                members = members.values
                node = members.field("node").to_numpy(zero_copy_only=False)
                root = members.field("root").to_numpy(zero_copy_only=False)
                rows = _rows(members.field("unit").to_pylist())
                own = np.flatnonzero(members.field("wanted").to_numpy(zero_copy_only=False))
                sims = rows[own] @ rows.T
                sims[root[own, None] == root[None, :]] = -2
                keep = min(k, len(node) - 1)
                best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
                best_sims = np.take_along_axis(sims, best, axis=1)
                a, b = np.nonzero(best_sims > -2)
                parts.append((node[own][a], node[best[a, b]], best_sims[a, b]))
            yield from _found(parts)

    return run


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a node's neighbours, of two components, that improve the list of the first."""
    for batch in batches:
        parts = []
        for members in batch["members"]:
            members = members.values
            node = members.field("node").to_numpy(zero_copy_only=False)
            root = members.field("root").to_numpy(zero_copy_only=False)
            kth = members.field("kth").to_numpy(zero_copy_only=False)
            rows = _rows(members.field("unit").to_pylist())
            sims = rows @ rows.T
            sims[root[:, None] == root[None, :]] = -2
            a, b = np.nonzero(sims > kth[:, None])
            parts.append((node[a], node[b], sims[a, b]))
        yield from _found(parts)


def _lists(found: DataFrame, k: int, label: str) -> DataFrame:
    """(node, best): the k nearest found, first. A node is found a bounded number of times in the
    cells; in a round, pairs that do not improve its list are left out before."""
    best = F.slice(F.sort_array(F.collect_set(F.struct("sim", "nbr")), asc=False), 1, k)
    once = found.groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    return stored(once.groupBy("node").agg(best.alias("best")), label)


def cell_lists(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """Lists of the ``wanted`` nodes from the cells of random hyperplanes, without members of their
    own component ``root``."""
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).select(
        "label", "dim", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CELL)))
        .cast("int").alias("bits"))
    cells = stored(nodes.select(*_CELL[2:]).join(sizes, ["label", "dim"]).mapInArrow(
        _cells(TREES, seed), "tree int, code long, label long, dim int, node long, unit binary, "
        "root long, wanted boolean"), "neardup-cells")
    key = ["tree", "label", "dim", "code"]
    cut = cells.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cut"),
                                  F.bool_or("wanted").alias("any")).where("any").drop("any")
    # Dealt by block: else a large cell would stay in the task that the join put it in.
    blocks = cells.join(cut, key).withColumn("own", F.pmod(
        F.xxhash64("tree", "node"), F.col("cut"))).repartition(*key, "own") \
        .groupBy(*key, "own").agg(F.collect_list(F.struct(
            "node", "unit", "root", "wanted")).alias("members")) \
        .where((F.size("members") > 1) & F.exists("members", lambda m: m["wanted"]))
    lists = _lists(blocks.select("members").mapInArrow(_nearest(k), _FOUND), k, "neardup-lists")
    released(cells)
    return lists


def _pairs(lists: DataFrame) -> DataFrame:
    return lists.select("node", F.explode("best").alias("b")).select("node", "b.nbr", "b.sim")


def next_lists(nodes: DataFrame, lists: DataFrame, k: int,
               around_too: DataFrame | None = None) -> DataFrame:
    """One round: neighbours of neighbours. The members around a node that many point to are dealt
    to several comparisons.

    Lists are those of the ``wanted`` nodes. ``around_too`` are other lists that say who is around
    a node; only nodes with a wanted one around are looked at.
    """
    pairs = _pairs(lists)
    linked = pairs.select("node", "nbr")
    if around_too is not None:
        linked = linked.unionByName(_pairs(around_too).select("node", "nbr"))
    around = linked.select(F.col("node").alias("c"), F.col("nbr").alias("node")).unionByName(
        linked.select(F.col("nbr").alias("c"), "node")).distinct()
    if around_too is not None:
        wanted = nodes.where("wanted").select("node")
        around = around.join(around.join(wanted, "node").select("c").distinct(), "c", "left_semi")
    cut = around.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / JOIN).cast("int").alias("cut"))
    kth = lists.select("node", F.when(
        F.size("best") >= k, F.element_at("best", -1)["sim"]).alias("least"))
    # No similarity improves the list of a node that is not wanted.
    held = nodes.select("node", "unit", "root", "wanted").join(kth, "node", "left").select(
        "node", "unit", "root", F.when(F.col("wanted"), F.coalesce("least", F.lit(-1.0)))
        .otherwise(2.0).cast("float").alias("kth"))
    groups = around.join(cut, "c").withColumn(
        "own", F.pmod(F.xxhash64("c", "node"), F.col("cut"))).join(held, "node") \
        .groupBy("c", "own").agg(
            F.collect_list(F.struct("node", "kth", "unit", "root")).alias("members")) \
        .where((F.size("members") > 1) & F.exists("members", lambda m: m["kth"] < 2))
    found = groups.select("members").mapInArrow(_join, _FOUND)
    return _lists(found.unionByName(pairs), k, "neardup-lists")


def _exact_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["left"].to_pylist(), batch["right"].to_pylist()
            keep = [float(np.frombuffer(a) @ np.frombuffer(b)) >= threshold
                    for a, b in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def links(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of the lists at or above the threshold in double precision."""
    near = _pairs(lists).where(F.col("sim") >= threshold - SLACK).select(
        F.greatest("node", "nbr").alias("a"), F.least("node", "nbr").alias("b")).distinct()
    exact = nodes.select("node", "exact")
    both = near.join(exact.toDF("a", "left"), "a").join(exact.toDF("b", "right"), "b")
    return both.mapInArrow(_exact_pairs(threshold), "a long, b long")


def _audit(sample: list, threshold: float):
    """True links of each sampled node, and how many of them are in the same component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[int, int], list] = {}
        for row in sample:
            groups.setdefault((row["label"], row["dim"]), []).append(row)
        sums = {of: np.zeros((2, len(rows)), np.int64) for of, rows in groups.items()}
        for batch in batches:
            label = batch["label"].to_numpy(zero_copy_only=False)
            dim = batch["dim"].to_numpy(zero_copy_only=False)
            for (of, length), rows in groups.items():
                at = np.flatnonzero((label == of) & (dim == length))
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                sims = _rows([r["exact"] for r in rows], "<f8") @ _rows(
                    part["exact"].to_pylist(), "<f8").T
                node = part["node"].to_numpy(zero_copy_only=False)
                root = part["root"].to_numpy(zero_copy_only=False)
                hit = (sims >= threshold) & (
                    node[None, :] != np.array([r["node"] for r in rows])[:, None])
                sums[of, length][0] += hit.sum(axis=1)
                sums[of, length][1] += (hit & (root[None, :] == np.array(
                    [r["root"] for r in rows])[:, None])).sum(axis=1)
        for of, rows in groups.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["node"] for r in rows], pa.int64()), *map(pa.array, sums[of])],
                ["node", "links", "same"])

    return run


def audited_recall(rooted: DataFrame, threshold: float) -> float:
    """Share of the sampled nodes' links whose ends are in one component; 1 without links.

    The least of three figures: the share of all links, in which nodes with many weigh most; the mean
    share of the nodes that have links; and that mean over nodes drawn outside large components.
    """
    columns = ["node", "label", "dim", "root", "exact"]
    small = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") <= SMALL).select("root")
    drawn = [{r["node"]: r.asDict() for r in table.select(*columns).orderBy(
        F.xxhash64(F.lit(SEED), "node")).limit(AUDIT).collect()}
        for table in (rooted, rooted.join(small, "root", "left_semi"))]
    sample = list({**drawn[0], **drawn[1]}.values())
    if not sample:
        return 1.0
    counts = {r["node"]: (r["links"], r["same"]) for r in rooted.select(*columns).mapInArrow(
        _audit(sample, threshold), "node long, links long, same long").groupBy("node").agg(
        F.sum("links").alias("links"), F.sum("same").alias("same")).where("links > 0").collect()}
    figures = [1.0]
    for nodes in drawn:
        linked = [counts[n] for n in nodes if n in counts]
        if linked:
            figures += [sum(same for _, same in linked) / sum(true for true, _ in linked),
                        sum(same / true for true, same in linked) / len(linked)]
    return min(figures)


def _count(threshold: float):
    """Links of each member of one block with the members of the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts = [], []
            i, j = batch["i"].to_pylist(), batch["j"].to_pylist()
            for row, members in enumerate(batch["members"]):
                members = members.values
                node = members.field("node").to_numpy(zero_copy_only=False)
                times = members.field("times").to_numpy(zero_copy_only=False)
                own = members.field("own").to_numpy(zero_copy_only=False)
                rows = _rows(members.field("exact").to_pylist(), "<f8")
                near = rows @ rows.T >= threshold
                np.fill_diagonal(near, False)
                if i[row] != j[row]:  # pairs inside a block are another row's
                    near &= own[:, None] != own[None, :]
                nodes.append(node)
                counts.append(near @ times)
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(counts))],
                    ["node", "n"])

    return run


def degrees(rooted: DataFrame, threshold: float) -> DataFrame:
    """(node, n): rows linked to each node, all pairs of its component compared."""
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    cut = F.ceil(F.col("size") / BLOCK).cast("int")
    members = rooted.join(sizes, "root").withColumn("cut", cut).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    blocks = members.withColumn("i", F.least("own", "other")).withColumn(
        "j", F.greatest("own", "other")).repartition("root", "i", "j") \
        .groupBy("root", "i", "j").agg(
        F.collect_list(F.struct("node", "times", "own", "exact")).alias("members"))
    return blocks.select("i", "j", "members").mapInArrow(_count(threshold), "node long, n long") \
        .groupBy("node").agg(F.sum("n").alias("n"))


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges, "neardup")
    return stored(nodes.drop("root").join(
        roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
        .drop("linked").withColumn("root", F.coalesce("root", "node")), "neardup-rooted")


def links_beyond(rooted: DataFrame, lists: DataFrame, k: int, threshold: float, seed: int
                 ) -> DataFrame:
    """Links of saturated nodes to other components."""
    full = lists.where((F.size("best") >= k) & (
        F.element_at("best", -1)["sim"] >= threshold - SLACK)).select("node", F.lit(True).alias("full"))
    nodes = stored(rooted.drop("wanted").join(full, "node", "left").withColumn(
        "wanted", F.coalesce("full", F.lit(False))).drop("full"), "neardup-saturated")
    outside = next_lists(nodes, cell_lists(nodes, k, seed), k, lists)
    return stored(links(nodes, outside, threshold), "neardup-beyond")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD,
                    neighbours: int = NEIGHBOURS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows, raw = nodes_of(table)
    nodes = stored(raw.select("node", "label", "first", "times", "v").mapInArrow(_encode, _NODES)
                   .withColumn("root", F.col("node")).withColumn("wanted", F.lit(True)),
                   "neardup-vectors")
    lists, seed = cell_lists(nodes, neighbours, SEED), SEED
    for turn in range(ROUNDS):
        if turn:  # pairs that no cell held together so far
            seed += 1
            before, fresh = lists, cell_lists(nodes, neighbours, seed)
            lists = _lists(_pairs(before).unionByName(_pairs(fresh)), neighbours, "neardup-lists")
            released(before)
            released(fresh)
        before, lists = lists, next_lists(nodes, lists, neighbours)
        released(before)
        edges = stored(links(nodes, lists, threshold), "neardup-links")
        while True:  # each turn joins components, so it ends
            rooted, seed = _rooted(nodes, edges), seed + 1
            more = links_beyond(rooted, lists, neighbours, threshold, seed)
            if not more.limit(1).count():
                break
            edges = stored(edges.unionByName(more), "neardup-links")
        recall = audited_recall(rooted, threshold)
        if recall >= TARGET:
            break
    if recall < LEAST:
        raise RuntimeError(f"recall {recall:.3f} after {ROUNDS} rounds")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    info = rooted.select("node", "root", "times").join(least, "root").join(
        degrees(rooted, threshold), "node", "left").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    return rows.join(info, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        .alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

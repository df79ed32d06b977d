"""SimHash near-duplicates by a generalised pigeonhole search.

A fingerprint has 64 bits, one for each bit of the hashes of a text's word triples that more than
half of them have set. Two fingerprints that differ in at most ``RADIUS`` bits must, for any
partition of the bits and any thresholds whose sums of ``threshold + 1`` exceed the radius, be
within the threshold on some part. Correlated bits are put into the same part, and thresholds are
allocated by dynamic programming on the candidates that each part is expected to yield, both from
the joint counts of bits over all fingerprints. Every candidate is verified on all 64 bits.

Equal fingerprints are one node. A part's bucket yields at most a tree of links, not its pairs; one
with many members is cut into blocks whose pairs are separate rows, so no bucket is bounded and none
is held by one task.

Edge cases: null and texts without words have fingerprint zero and link like any other; null ids
are never a component's id (null if it has no other); repeated rows are in the same component; an
empty table gives no rows; ``groups`` ignores and ``one_of_each`` keeps extra columns.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchflow.llm.components import components
from touchflow.llm.tables import whole_text
from touchflow.session import stored

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42
#: Members of a bucket that are compared in one row.
BLOCK = 4096
#: Relative costs of a probe and of verifying a candidate, and the parts that are tried.
PROBE, VERIFY = 1.0, 0.01
PARTS = range(1, 9)
_CHUNK = 1 << 16


def fingerprint(text: str) -> int:
    """The fingerprint as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, ASCII white space
    if not words:
        return 0
    ones, total = np.zeros(BITS, np.int64), max(1, len(words) - WORDS + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(WORDS)))) if len(words) >= WORDS \
        else iter([b" ".join(words)])
    digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    while chunk := list(map(digest, itertools.islice(shingles, _CHUNK))):
        raw = np.array(chunk, ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64)
        at = batch.schema.names.index("text")
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(prints.view(np.int64))], [*names, "fp"])


def fingerprints(docs: DataFrame, *keys) -> DataFrame:
    """The given columns and ``fp``, the fingerprint as a signed long."""
    ready = docs.select(*keys, whole_text().alias("text"))
    return ready.mapInArrow(_fingerprints, ready.drop("text").schema.add("fp", "long"))


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS))
    for batch in batches:
        bits = _bits(batch["fp"].to_numpy(zero_copy_only=False)).astype(np.float32)
        both += bits.T @ bits
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both[i, j].astype(np.int64))],
        ["i", "j", "both"])


def _bits(prints: np.ndarray) -> np.ndarray:
    """Bit 0 is the highest."""
    raw = prints.astype(">i8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1)


def joint_counts(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set: 64 x 64 sums over all of them."""
    sums = nodes.select("fp").mapInArrow(_joint, "i int, j int, both long") \
        .groupBy("i", "j").agg(F.sum("both").alias("both")).collect()  # 2080 rows
    both = np.zeros((BITS, BITS))
    for row in sums:
        both[row["i"], row["j"]] = both[row["j"], row["i"]] = row["both"]
    return both


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in m parts of nearly equal size, each grown by its most correlated bits."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    close = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        left = sorted(free)
        part = [left[int(np.argmax(close[np.ix_(left, left)].max(axis=1)))]]
        free.remove(part[0])
        while len(part) < size:
            left = sorted(free)
            part.append(left[int(np.argmax(close[np.ix_(left, part)].mean(axis=1)))])
            free.remove(part[-1])
        parts.append(part)
    return parts


def distances(part: list[int], both: np.ndarray, n: int) -> np.ndarray:
    """Chance that two fingerprints differ in 0, 1, .. RADIUS bits of the part.

    Bit by bit, each given its most correlated predecessor.
    """
    p = np.diag(both) / n
    agree = p ** 2 + (1 - p) ** 2
    chance = np.zeros(RADIUS + 1)
    chance[0] = 1.0
    for k, bit in enumerate(part):
        same = agree[bit]
        if k:
            joint = []
            for other in part[:k]:
                x11 = both[bit, other] / n
                x10, x01 = p[bit] - x11, p[other] - x11
                cells = np.array([x11, x10, x01, 1 - x11 - x10 - x01])
                joint.append((cells ** 2).sum() / max(agree[other], 1e-12))
            same = min(1.0, max(joint, key=lambda x: abs(x - agree[bit])))
        chance = chance * same + np.append(0, chance[:-1]) * (1 - same)
    return chance


def allocate(both: np.ndarray, n: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe, of least expected cost."""
    best = None
    for m in PARTS:
        parts = correlated_parts(both, n, m)
        # plan[s]: least cost of parts so far whose sum of threshold + 1 is s
        plan = {0: (0.0, [])}
        for part in parts:
            within = np.cumsum(distances(part, both, n))
            step = {}
            for done, (cost, chosen) in plan.items():
                for threshold in range(-1, RADIUS + 1):
                    more = 0.0
                    if threshold >= 0:
                        values = sum(math.comb(len(part), k) for k in range(threshold + 1))
                        more = PROBE * n * values + VERIFY * n * n / 2 * within[threshold]
                    reached = min(RADIUS + 1, done + threshold + 1)
                    if reached not in step or cost + more < step[reached][0]:
                        step[reached] = (cost + more, [*chosen, threshold])
            plan = step
        cost, chosen = plan[RADIUS + 1]
        if best is None or cost < best[0]:
            best = (cost, [(b, t) for b, t in zip(parts, chosen) if t >= 0])
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _flips(bits: list[int], threshold: int) -> list[int]:
    """Masks that change up to ``threshold`` of the bits, as signed longs."""
    return [_signed(functools.reduce(lambda a, b: a | 1 << (BITS - 1 - b), picked, 0))
            for k in range(threshold + 1) for picked in itertools.combinations(bits, k)]


def _at(number: int, own: F.Column):
    return lambda mask: F.struct(F.lit(number).alias("part"), own.bitwiseXOR(mask).alias("value"))


def probes(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp): each fingerprint at all values within the threshold of each part."""
    options = []
    for number, (bits, threshold) in enumerate(plan):
        keep = _signed(functools.reduce(lambda a, b: a | 1 << (BITS - 1 - b), bits, 0))
        own = F.col("fp").bitwiseAND(F.lit(keep))
        options.append(F.transform(F.array(*map(F.lit, _flips(bits, threshold))),
                                   _at(number, own)))
    return nodes.select("fp", F.explode(F.flatten(F.array(*options))).alias("at")) \
        .select("at.part", "at.value", "fp")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def tree(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all connected members of a bucket: a spanning forest."""
    linked = np.zeros(len(prints), bool)
    for at in range(0, len(prints), 256):
        linked[at:at + 256] = _near(prints[at:at + 256, None], prints[None, :]).sum(axis=1) > 1
    left, edges = prints[linked], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            hit = _near(left, one)
            if hit.any():
                edges += [(int(one), int(x)) for x in left[hit]]
                queue += list(left[hit])
                left = left[~hit]
    return edges


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["members"]
        offsets = np.asarray(lists.offsets)
        flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        sizes, edges = np.diff(offsets), []
        for size in np.unique(sizes):
            starts = offsets[:-1][sizes == size]
            if size <= 32:  # all buckets of this size at once
                for at in range(0, len(starts), 4096):
                    rows = flat[starts[at:at + 4096, None] + np.arange(size)]
                    pairs = _near(rows[:, :, None], rows[:, None, :]).sum(axis=(1, 2))
                    for row in rows[pairs > size]:
                        edges += tree(np.unique(row))
            else:
                for start in starts:
                    edges += tree(np.unique(flat[start:start + size]))
        if edges:
            both = np.array(edges, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) that connect all fingerprints within the radius.

    ``nodes`` (fp) are distinct. A bucket is cut into blocks of hashed members; each pair of its
    blocks is a row of at most about two blocks.
    """
    n = nodes.count()
    if n < 2:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    found = probes(nodes, allocate(joint_counts(nodes), n))
    sizes = found.groupBy("part", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    cut = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int")
    members = found.join(sizes, ["part", "value"]).withColumn("cut", cut).withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1))) \
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")) \
        .groupBy("part", "value", "i", "j") \
        .agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    return members.select("members").mapInArrow(_verify, "a long, b long")


def _grouped(prints: DataFrame) -> DataFrame:
    """(fp, root) for fingerprints with links."""
    nodes = stored(prints.select("fp").distinct(), "simhash-nodes")
    return components(links(nodes), "simhash")


def groups(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of each document.

    Only ids and fingerprints are moved. The smallest id of a fingerprint, then of a component, is
    a partial aggregate, so many copies of one text are one row each.
    """
    prints = stored(fingerprints(docs, F.col("doc_id").cast("long").alias("doc_id")), "simhash")
    roots = _grouped(prints)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(members, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group; other columns settle equal ids.

    A row is named by two 64-bit hashes of all its columns.  The texts are shuffled once, by that
    name, for the join with the rows that stay and for dropping repeats of these.
    """
    name = ["__row", "__more"]
    hashes = [F.xxhash64(*docs.columns).alias(name[0]),
              F.xxhash64(F.lit(SEED), *docs.columns).alias(name[1])]
    prints = stored(fingerprints(docs, F.col("doc_id").alias("__id"), *hashes), "simhash")
    roots = _grouped(prints)
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left")
    best = rooted.groupBy(F.coalesce("root", "fp")).agg(F.min(F.struct(
        F.col("__id").isNull(), "__id", *name)).alias("best")).select(
        *[F.col(f"best.{n}").alias(n) for n in name])
    return docs.select("*", *hashes).join(best, name, "left_semi") \
        .dropDuplicates(name).select(*docs.columns)

"""Sharding by fixed virtual slots.

A record's key is hashed into one of a few thousand slots, for good. Which shard a slot belongs
to stands in a small versioned table: growing or rebalancing writes a new version with some slots
moved and leaves all other records where they are.

Edge cases: null keys share one slot; null texts have size 1 and the checksum 0 of an empty text;
rows that are equal in all used columns get consecutive positions; an empty table gives no rows.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchflow.llm.tables import whole_text
from touchflow.session import stored

SLOTS = 4096
#: Positions are counted in so many parts per shard, whatever the keys are.
PARTS = 4096
#: Numbers that one expansion step writes for a row that occurs many times.
RUN = 65536


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def grown(shard_of: list[int]) -> list[int]:
    """The map with one more shard, which takes an equal share of slots from the others.

    Depends on the old map alone; slots only ever move to the new shard.
    """
    new, owned = max(shard_of) + 1, {}
    for slot, shard in enumerate(shard_of):
        owned.setdefault(shard, []).append(slot)
    result, wanted = list(shard_of), len(shard_of) // (new + 1)
    donors = [(-len(slots), shard) for shard, slots in owned.items()]
    heapq.heapify(donors)
    for _ in range(wanted):
        size, shard = heapq.heappop(donors)
        result[owned[shard].pop()] = new
        heapq.heappush(donors, (size + 1, shard))
    return result


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The map of so many shards, grown one by one from a single shard."""
    if not 1 <= shards <= slots:
        raise ValueError(f"1 to {slots} shards, not {shards}")
    shard_of = [0] * slots
    for _ in range(shards - 1):
        shard_of = grown(shard_of)
    return shard_of


def rebalanced(shard_of: list[int], slot_bytes: dict[int, int], tolerance: float = 0.02,
               ) -> list[int]:
    """The map after moving slots from the fullest to the emptiest shard.

    Stops when the fullest holds at most ``1 + tolerance`` of the mean or no move of one slot makes
    it smaller; a slot larger than a shard's share stays alone in the end.
    """
    result, load, owned = list(shard_of), {}, {}
    for slot, shard in enumerate(shard_of):
        load[shard] = load.get(shard, 0) + slot_bytes.get(slot, 0)
        owned.setdefault(shard, set()).add(slot)
    mean = sum(load.values()) / len(load)
    while True:
        full, empty = max(load, key=load.get), min(load, key=load.get)
        gap = load[full] - load[empty]
        fits = [s for s in owned[full] if 0 < slot_bytes.get(s, 0) < gap]
        if load[full] <= (1 + tolerance) * mean or not fits:
            return result
        slot = min(fits, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
        size = slot_bytes[slot]
        result[slot] = empty
        owned[full].remove(slot)
        owned[empty].add(slot)
        load[full] -= size
        load[empty] += size


def save_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Adds a version; an existing one is never overwritten."""
    spark.createDataFrame(list(enumerate(shard_of)), "slot int, shard int").coalesce(1) \
        .write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def slot_bytes(docs: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of each slot: one partial aggregation, at most ``slots`` rows."""
    return docs.groupBy(slot_of(F.col(key), slots).alias("virtual_slot")).agg(
        F.sum(F.octet_length(whole_text()) + F.lit(1).cast("long")).alias("slot_bytes"),
        F.count(F.lit(1)).alias("slot_rows"))


def assign(docs: DataFrame, shard_map: DataFrame, key: str = "doc_id",
           slots: int = SLOTS) -> DataFrame:
    """All columns of ``docs`` and ``shard``; the map has ``slots`` rows and is broadcast."""
    own = "__virtual_slot"
    return docs.withColumn(own, slot_of(F.col(key), slots)).join(
        F.broadcast(shard_map.select(F.col("slot").alias(own), "shard")), own).drop(own)


def write_shards(docs: DataFrame, shard_map: DataFrame, path: str, key: str = "doc_id",
                 slots: int = SLOTS) -> None:
    """Writes ``path/shard=<n>/``. Tasks are dealt by slot, so that a large shard has many."""
    assign(docs.drop("shard"), shard_map, key, slots) \
        .repartition("shard", slot_of(F.col(key), slots)) \
        .write.partitionBy("shard").mode("overwrite").parquet(path)


def placed(docs: DataFrame, shard_map: DataFrame, grown_map: DataFrame, label: str = "placed",
           slots: int = SLOTS) -> DataFrame:
    """Where each document goes: shard, gapless position there, shard after growth.

    Only the key, size and checksum of a document are moved. Equal rows are counted before the
    shuffle. Positions come from counts per shard and hash part plus the order in that part; the
    parts depend on all columns, so a repeated key is spread over all of them.
    """
    text = whole_text()
    narrow = docs.select(
        F.col("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("times"))
    rows = stored(rows.select(
        "*", slot_of(F.col("doc_id"), slots).alias("virtual_slot"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PARTS)).cast("int")
        .alias("part")), label)
    maps = shard_map.select(F.col("slot").alias("virtual_slot"), "shard").join(
        grown_map.select(F.col("slot").alias("virtual_slot"), F.col("shard").alias("grown_shard")),
        "virtual_slot")
    weights = rows.groupBy("virtual_slot").agg(
        F.sum(F.col("size") * F.col("times")).alias("slot_bytes"))
    maps = maps.join(weights, "virtual_slot", "left")
    rows = rows.join(F.broadcast(maps), "virtual_slot")
    counts = rows.groupBy("shard", "part").agg(F.sum("times").alias("part_rows"))
    before = counts.select("shard", "part", (
        F.sum("part_rows").over(Window.partitionBy("shard").orderBy("part"))
        - F.col("part_rows")).alias("before"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("before") + F.sum("times").over(order) - F.col("times")
    runs = rows.join(before, ["shard", "part"]).withColumn("first", first).withColumn(
        "run", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / RUN))))
    begin = F.col("first") + F.col("run") * RUN
    end = F.least(begin + RUN, F.col("first") + F.col("times")) - 1
    return runs.withColumn("slot", F.explode(F.sequence(begin, end))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
        "virtual_slot", "slot_bytes")

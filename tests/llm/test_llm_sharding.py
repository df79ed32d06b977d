import zlib

import pytest

from touchflow.llm import sharding

DOCS = "doc_id long, text string, shard string, slot string"


def place(spark, docs, shards=8):
    def as_map(shard_of):
        return spark.createDataFrame(list(enumerate(shard_of)), "slot int, shard int")
    current = sharding.even_map(shards)
    return [r.asDict() for r in sharding.placed(
        docs, as_map(current), as_map(sharding.grown(current))).collect()]


def test_every_row_gets_a_gapless_place_and_equal_ids_the_same_shard(spark):
    rows = [(i, f"text {i % 7}", "x", "y") for i in range(300)] + [(5, "other", "x", "y")] * 40 \
        + [(None, None, "x", "y")] * 3 + [(None, "", "x", "y"), (301, "é" * 100_000, "x", "y")]
    found = place(spark, spark.createDataFrame(rows, DOCS))
    assert len(found) == len(rows)
    shards = {}
    for r in found:
        assert 0 <= r["shard"] <= 7 and r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
    assert all(len(places) == 1 for places in by_id.values())
    expected = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                      for d, t, _, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == expected


def test_the_shard_does_not_depend_on_the_other_rows(spark):
    one = place(spark, spark.createDataFrame([(7, "a", "", "")], DOCS))
    many = place(spark, spark.createDataFrame([(i, "a" * i, "", "") for i in range(50)], DOCS))
    assert one[0]["shard"] == next(r["shard"] for r in many if r["doc_id"] == 7)


def test_empty_table(spark):
    assert place(spark, spark.createDataFrame([], DOCS)) == []


@pytest.mark.parametrize("shards", [1, 2, 3, 8, 50])
def test_growth_moves_slots_only_to_the_new_shard_and_keeps_shares_equal(shards):
    before, after = sharding.even_map(shards), sharding.grown(sharding.even_map(shards))
    assert all(b == a or a == shards for b, a in zip(before, after))
    counts = [after.count(s) for s in range(shards + 1)]
    assert max(counts) - min(counts) <= 1


def test_rebalancing_evens_out_hot_slots():
    shard_of = sharding.even_map(4, 64)
    sizes = {s: 100 if shard_of[s] else 500 for s in range(64)}
    after = sharding.rebalanced(shard_of, sizes, tolerance=0.1)
    load = [sum(sizes[s] for s in range(64) if after[s] == k) for k in range(4)]
    assert max(load) <= 1.1 * sum(load) / 4
    assert sharding.rebalanced([0, 1], {0: 1000, 1: 1}) == [0, 1]  # one huge slot stays


def test_maps_are_versioned_and_written_shards_follow_them(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(200)], "doc_id long, text string")
    sharding.save_map(spark, str(tmp_path / "maps"), 1, sharding.even_map(3))
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save_map(spark, str(tmp_path / "maps"), 1, sharding.even_map(2))
    shard_map = sharding.load_map(spark, str(tmp_path / "maps"), 1)
    sharding.write_shards(docs, shard_map, str(tmp_path / "shards"))
    written = {r["doc_id"]: r["shard"] for r in
               spark.read.parquet(str(tmp_path / "shards")).collect()}
    assigned = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, shard_map).collect()}
    assert written == assigned and len(written) == 200
    total = sum(r["slot_bytes"] for r in sharding.slot_bytes(docs).collect())
    assert total == sum(i + 1 for i in range(200))

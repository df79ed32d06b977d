import hashlib
import math

from pyspark.sql import functions as F

from touchflow.llm import mixing

DOCS = "doc_id long, text string, source string, rate string, weight string, parts int"


def poisson(key, rate):
    """Number of copies by direct inversion."""
    parts = max(1, math.ceil(rate / mixing.LARGEST_PART))
    total = 0
    for part in range(parts):
        u = (int(hashlib.md5(f"{key}:{part}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        p = s = math.exp(-rate / parts)
        k = 0
        while s <= u:
            k += 1
            p *= rate / parts / k
            s += p
        total += k
    return total


def test_copies_equal_direct_inversion_and_shares_meet_the_targets(spark):
    rows = [(i, "word " * (1 + i % 5), "big" if i % 3 else "small", "r", "w", 1)
            for i in range(3000)] + [(None, None, None, "r", "w", 1), (None, "", None, "r", "w", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = spark.createDataFrame([("big", 1.0), ("small", 2.0), (None, 0.1), ("none", 5.0)],
                                    "source string, weight double").where("source <> 'none' OR source IS NULL")
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(docs, weights).collect()}
    mixed = mixing.mix(docs, weights)
    assert mixed.columns == docs.columns + ["copies", "copy", "order_key"]
    found = mixed.collect()
    counts = {}
    for r in found:
        counts[r["doc_id"], r["text"]] = counts.get((r["doc_id"], r["text"]), 0) + 1
    for doc, text, source, *_ in rows:
        key = doc if doc is not None else "text " + hashlib.md5((text or "").encode()).hexdigest()
        assert counts.get((doc, text), 0) == poisson(f"{mixing.SEED}:{key}", rates[source])
    size = {}
    for r in found:
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"] or "") + 1
    assert abs(size["small"] / size["big"] - 2.0) < 0.15


def test_large_rates_are_sums_of_parts(spark):
    docs = spark.createDataFrame([(i, "x", "s", "", "", 1) for i in range(40)], DOCS)
    found = mixing.mix(docs, epochs=450.0).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("copies").alias("c")).collect()
    assert all(r["n"] == r["c"] == poisson(f"{mixing.SEED}:{r['doc_id']}", 450.0) for r in found)
    assert abs(sum(r["n"] for r in found) / 40 - 450) < 15


def test_small_sources_are_lifted_by_the_temperature(spark):
    docs = spark.createDataFrame([(i, "x" * 99, "a" if i else "b", "", "", 1) for i in range(100)], DOCS)
    rates = {r["source"]: r for r in mixing.source_rates(docs).collect()}
    assert rates["b"]["rate"] > 1 > rates["a"]["rate"]
    assert math.isclose(sum(r["rate"] * r["source_bytes"] for r in rates.values()), 100 * 100)


def test_empty_table_and_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([], DOCS)
    mixed = mixing.mix(docs)
    assert mixed.collect() == []
    plan = mixed._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_input_columns_named_like_those_of_the_result(spark):
    docs = spark.createDataFrame([(i, "x", "s", i, "k", -1) for i in range(30)],
                                 "doc_id long, text string, source string, copy long, "
                                 "order_key string, copies int")
    found = mixing.mix(docs, epochs=2.0).collect()
    assert found and all(r["input_copy"] == r["doc_id"] and r["input_order_key"] == "k"
                         and r["input_copies"] == -1 and 0 <= r["copy"] < r["copies"] for r in found)

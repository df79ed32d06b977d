"""The pipeline against a step-by-step reference on a small folder of tables."""

import collections
import random
import re

import pytest

import corpus_pipeline
from touchflow.llm import mixing, packing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=240, seed=9):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(3, 8))) for _ in range(3000)]
    rows = []
    for i in range(n):
        text = draw.choices(words, k=draw.randint(30, 200))
        if i % 6 == 0:
            text.insert(3, draw.choice(["vileword", "nastyone"]))
        if i % 10 == 1:
            text.insert(4, "password=" + "".join(draw.choices("0123456789abcdef", k=18)))
        joined = " ".join(text)
        rows.append((i, joined, "en", f"src{i % 3}", len(joined)))
    rows += [(1000 + i, rows[i][1], "en", "src0", rows[i][4]) for i in range(1, 40)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "src1", 0), (2001, "", "en", "src1", 0)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)],
                          "doc_id long, quality int, toxic int") \
        .write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_each_stage(spark, folder):
    rows = documents()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_duplicates", "secrets", "mixing", "packing"]

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    ids = [r["doc_id"] for r in clean.collect()]
    toxic = {d for d, t, *_ in rows if t and ("vileword" in t or "nastyone" in t)}
    assert not toxic & set(ids) and len(ids) == len([r for r in rows if r[0] not in toxic])

    single = stages["simhash_near_duplicates"](spark, clean, folder).collect()
    prints = {}
    for d, t, *_ in sorted((r for r in rows if r[0] not in toxic), key=lambda r: r[0]):
        prints.setdefault(simhash.fingerprint(t or ""), d)
    assert sorted(r["doc_id"] for r in single) == sorted(prints.values())

    table = spark.createDataFrame(single, docs.schema)
    masked = stages["secrets"](spark, table, folder)
    for before, after in zip(*(sorted(x, key=lambda r: r["doc_id"]) for x in (single, masked.collect()))):
        expected = re.sub(r"password=[0-9a-f]{18}", "password=[secret]", before["text"] or "")
        assert (after["text"] or "") == expected

    mix = stages["mixing"](spark, masked, folder)
    assert mix.columns == docs.columns
    counts = collections.Counter(r["doc_id"] for r in mix.collect())
    expected = {r["doc_id"]: r["copies"] for r in mixing.mix(masked).collect()}
    assert counts == expected

    pieces = stages["packing"](spark, mix, folder).collect()
    tokens = sum(packing._encoder(packing.tokenizer_file())(r["text"] or "").__len__() + 1
                 for r in mix.collect())
    assert sum(p["length"] for p in pieces) == tokens


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int") \
        .write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

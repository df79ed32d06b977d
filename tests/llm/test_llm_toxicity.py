import random
import zlib

import numpy as np
import pytest

from touchflow.llm import toxicity

DOCS = "doc_id long, text string, lang string, score string, __x string"


def corpus(n=600, seed=1):
    draw = random.Random(seed)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = draw.choices(words, k=draw.randint(5, 60))
        if toxic:
            text.insert(draw.randrange(len(text)), draw.choice(["vileword", "nastyone", "grimthing"]))
        docs.append((i, " ".join(text), "en", "a", "b"))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus()
    table = spark.createDataFrame(docs, DOCS)
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    return table, given, toxicity.train(table, given)


def test_held_out_rows_are_told_apart_and_train_nothing(spark, trained):
    table, given, model = trained
    found = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    assert len(found) == 600
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r["predicted"] == int(i % 4 == 0) for i, r in found.items() if r["held_out"]]
    assert np.mean(held) > 0.98
    flipped = given.selectExpr(
        "doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 "
        "THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.train(table, flipped) == model


def test_rejecting_keeps_the_columns_and_the_clean_rows(trained):
    table, _, model = trained
    left = toxicity.reject(table, model)
    assert left.columns == table.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert len([i for i in range(600) if i % 4 and i in ids]) == 450
    assert len([i for i in ids if i % 4 == 0]) <= 3


def test_swapping_identity_terms_hardly_changes_the_score():
    draw = random.Random(3)
    names = sorted({"muslim", "christian", "vile", *(f"w{i}" for i in range(40))})
    vocabulary = {n: i for i, n in enumerate(names)}
    own, other, toxic = [], [], []
    for i in range(400):  # one group is named in most of the toxic rows
        bad = i % 2 == 0
        term = "muslim" if bad == (draw.random() < 0.95) else "christian"
        words = {term, *draw.sample([f"w{k}" for k in range(40)], 5)}
        if bad and draw.random() < 0.8:
            words.add("vile")
        own.append(sorted(vocabulary[w] for w in words))
        twin = {toxicity.SWAP.get(w, w) for w in words}
        twin = {"christian" if term == "muslim" else "muslim"} | (twin - set(toxicity.SWAP))
        other.append(sorted(vocabulary[w] for w in twin))
        toxic.append(int(bad))
    gap = {}
    for strength in (0.0, 50.0):
        w, _ = toxicity.fit_weights(own, other, toxic, len(names), counterfactual=strength)
        gap[strength] = abs(w[vocabulary["muslim"]] - w[vocabulary["christian"]])
        assert w[vocabulary["vile"]] > 1
    assert gap[50.0] < 0.1 * gap[0.0]


def test_odd_inputs(spark, trained):
    _, _, model = trained
    rows = [(None, None, None, None, None), (1, "", "", "", ""), (1, "", "", "", ""),
            (2, "vileword " * 50_000, "", "", ""), (3, "VileWord!", "", "", "")]
    found = toxicity.score(spark.createDataFrame(rows, DOCS), model).collect()
    assert len(found) == 5 and found[0]["score"] == found[1]["score"] == found[2]["score"] < 0.5
    assert found[3]["predicted"] == found[4]["predicted"] == 1
    assert toxicity.score(spark.createDataFrame([], DOCS), model).collect() == []


def test_without_both_labels_the_score_is_constant(spark):
    docs = spark.createDataFrame(corpus(50)[0], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none).score("vileword") == pytest.approx(0, abs=1e-9)
    clean = spark.createDataFrame([(i, 0) for i in range(50)] + [(None, 1), (3, None)],
                                  "doc_id long, toxic int")
    assert 0 < toxicity.train(docs, clean).score("vileword") < 0.05


def test_training_rows_are_bounded_and_distinct(spark):
    docs, labels = corpus(400)
    table = spark.createDataFrame(docs + docs, DOCS)
    given = spark.createDataFrame(labels + [(0, 0)], "doc_id long, toxic int")
    rows = toxicity.training_rows(table, given, per_class=30).collect()
    assert sum(r["toxic"] for r in rows) == 30 and len(rows) == 60

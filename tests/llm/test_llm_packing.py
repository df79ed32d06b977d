import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchflow.llm import packing

DOCS = "doc_id long, text string, ids string, length string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_file())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text(
    st.characters(max_codepoint=255), max_size=60) | st.text(" \n\t\x0b\x85\xa0aB1'st²½ª.-", max_size=40))
def test_ids_are_the_tokenizers(text):
    path = packing.tokenizer_file()
    own = Tokenizer.from_file(path) if not hasattr(test_ids_are_the_tokenizers, "own") \
        else test_ids_are_the_tokenizers.own
    test_ids_are_the_tokenizers.own = own
    assert packing._encoder(path)(text) == own.encode(text, add_special_tokens=False).ids


def test_every_pair_of_latin_characters_is_cut_alike(tokenizer):
    encode = packing._encoder(packing.tokenizer_file())
    for a in range(256):
        text = "".join(f"{chr(a)}{chr(b)}x " for b in range(256))
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    text = "a <|endoftext|> b"
    assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 1023), min_size=1, max_size=400))
@settings(max_examples=100, deadline=None)
def test_a_block_has_no_padding_and_no_overlap(sizes):
    pieces = packing.balanced(sizes)
    room = packing.rooms(sum(sizes))
    assert room.sum() == sum(sizes) and all(r & (r - 1) == 0 for r in room)
    used = collections.Counter()
    starts = collections.Counter()
    for doc, start, size, sequence, offset in pieces:
        assert offset == used[sequence] and start == starts[doc] and size > 0
        used[sequence] += size
        starts[doc] += size
    assert [used[i] for i in range(len(room))] == room.tolist()
    assert [starts[i] for i in range(len(sizes))] == sizes


def test_costs_are_balanced():
    draw = random.Random(0)
    sizes = [draw.randint(20, 400) for _ in range(2000)]
    cost = collections.Counter()
    for _, _, size, sequence, _ in packing.balanced(sizes):
        cost[sequence] += size + size * size / 1024
    whole = [cost[i] for i in range(sum(sizes) // 1024)]
    assert np.std(whole) / np.mean(whole) < 0.05


def test_pieces_rebuild_every_document(spark, tokenizer):
    draw = random.Random(1)
    rows = [(i, " ".join(f"w{draw.randint(0, 999)}" for _ in range(draw.randint(0, 1500))), "i", "l")
            for i in range(60)] + [(100, None, "", ""), (101, "", "", ""), (102, "x " * 30_000, "", "")]
    found = packing.pack(spark.createDataFrame(rows, DOCS)).withColumn("crc", F.crc32("ids")).collect()
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        assert len(r["ids"]) == 4 * r["length"] and r["crc"] == zlib.crc32(r["ids"])
        parts[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(parts[doc])
        assert sum((p for _, p, _ in pieces), []) == ids and {n for *_, n in pieces} == {len(ids)}
        assert [s for s, _, _ in pieces] == np.cumsum([0] + [len(p) for _, p, _ in pieces])[:-1].tolist()
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_repeated_rows_null_ids_and_the_empty_table(spark):
    rows = [(1, "same text here", "", "")] * 3 + [(None, "x", "", "")]
    found = packing.pack(spark.createDataFrame(rows, DOCS)).collect()
    total = sum(r["length"] for r in found)
    assert total == 3 * found[0]["doc_tokens"] + 2 or total == sum(
        r["length"] for r in found if r["doc_id"] == 1) + 2
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], DOCS), length=1000)

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, part string"
PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>",
                                   "INST]", "a", "é", "\n", "𝒳", ""]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PIECES), PIECES),
                min_size=1, max_size=6))
def test_turns_survive_the_round_trip(turns):
    rows = chat.assemble(pa.array([1] * len(turns)), pa.array([t[0] for t in turns]),
                         pa.array([t[1] for t in turns]))
    text = rows["formatted"][0].as_py()
    assert chat.turns_of(text) == turns
    loss = [chat.unescaped(text[a:b]) for a, b in
            zip(rows["loss_start"][0].as_py(), rows["loss_end"][0].as_py())]
    assert loss == [t for r, t in turns if r == "assistant"]


def expected(turns):
    groups = {}
    for conv, turn, role, text, *_ in turns:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0], r[1], r[2]))
        said = "".join(t for _, r, t in rows if r == "assistant")
        out[conv] = (len(rows), hashlib.sha256("".join(
            f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest(), len(said),
            hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_bytes", [4 << 20, 40])
def test_digests(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(chat, "PART_BYTES", part_bytes)
    turns = [(c, t, ["user", "assistant", "system"][(c + t) % 3], f"text {c} {t} <s>\\[INST] é" * t,
              "f", "p") for c in range(20) for t in range(c % 7 + 1)]
    turns += [(None, None, None, None, None, None), (None, 1, "assistant", "x", "", ""),
              (50, 1, "user", "b", "", ""), (50, 1, "user", "a", "", ""), (50, 1, "user", "a", "", ""),
              (51, 0, "assistant", "", "", ""), (52, 0, "assistant", "long " * 100_000, "", "")]
    turns += [(99, t, "assistant", "hot", "", "") for t in range(3000)]
    found = chat.digests(chat.format_conversations(spark.createDataFrame(turns, SCHEMA))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
            for r in found} == expected(turns)
    assert len(found) == len(expected(turns))


def test_empty_table(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.format_conversations(turns)).collect() == []

"""Chat formatting by columnar byte assembly.

A turn becomes ``<s>role[INST]text[/INST]</s>`` and a line end. Control strings inside roles and
texts get a backslash after their bracket (and one more where they have some), which reading back
removes again. Formatted bytes are never joined turn by turn: lengths and offsets of all segments
of a batch are computed in numpy, then headers, texts and footers are scattered into one buffer
that becomes the Arrow column.

A conversation's rows stream through one task in turn order, in parts of bounded size, so the
memory needed does not depend on the length of a conversation.

Edge cases: null texts and roles are empty; a null conv_id is one conversation; equal turn numbers
are ordered by role, then text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, SEPARATOR, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>\n"
LOSS_ROLE = "assistant"
#: Bytes of text that are assembled at once; a single longer text is a part by itself.
PART_BYTES = 4 << 20

PART_SCHEMA = ("conv_id bigint, part long, n_turns long, formatted string, "
               "loss_start array<long>, loss_end array<long>")
DIGEST_SCHEMA = ("conv_id bigint, n_turns long, turns_sha256 string, loss_chars long, "
                 "loss_sha256 string, formatted_chars long")

_ESCAPE = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_UNESCAPE = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>\n", re.DOTALL)


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _ESCAPE, r"\1\\\2\3")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text) if "\\" in text else text


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets of each."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def _scatter(out: np.ndarray, to: np.ndarray, pool: np.ndarray, start: np.ndarray,
             size: np.ndarray) -> None:
    """Copies segment i of the pool, ``size[i]`` bytes from ``start[i]``, to ``out[to[i]:]``."""
    if len(size) == 1:
        out[to[0]:to[0] + size[0]] = pool[start[0]:start[0] + size[0]]
        return
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[within + np.repeat(to, size)] = pool[within + np.repeat(start, size)]


def assemble(convs: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row per run of equal ``convs``: number of turns, formatted text and loss spans.

    Spans count code points from the start of the row's text.
    """
    n = len(convs)
    texts = escaped(texts)
    kinds = roles.dictionary_encode()
    code = kinds.indices.to_numpy(zero_copy_only=False)
    names = kinds.dictionary
    header = pc.binary_join_element_wise(BEGIN, escaped(names), SEPARATOR, "")
    footer = pa.array([CLOSE + END] * len(names), pa.string())
    pools = [_bytes_of(header), _bytes_of(texts), _bytes_of(footer)]
    pick = [code, np.arange(n), code]
    size = np.stack([np.diff(offsets)[i] for (_, offsets), i in zip(pools, pick)], axis=1)
    to = (np.cumsum(size) - size.ravel()).reshape(size.shape)
    out = np.empty(int(size.sum()), np.uint8)
    for k, (pool, offsets) in enumerate(pools):
        _scatter(out, to[:, k], pool, offsets[:-1][pick[k]], size[:, k])

    same = pc.equal(convs[1:], convs[:-1]).to_pylist() if n > 1 else []
    null = pc.is_null(convs).to_pylist()
    first = np.array([0] + [i + 1 for i, equal in enumerate(same)
                            if not (equal or null[i] and null[i + 1])])
    last = np.append(first[1:], n)
    chars = np.stack([pc.utf8_length(a).to_numpy(zero_copy_only=False).astype(np.int64)[i]
                      for a, i in zip((header, texts, footer), pick)], axis=1)
    at = (np.cumsum(chars) - chars.ravel()).reshape(chars.shape)
    base = np.repeat(at[first, 0], last - first)
    loss = np.array([r == LOSS_ROLE for r in names.to_pylist()], bool)[code]
    start, stop = (at[:, 1] - base)[loss], (at[:, 1] + chars[:, 1] - base)[loss]
    spans = np.append(np.cumsum(loss) - loss, loss.sum())[np.append(first, n)].astype(np.int32)
    ends = np.append(to[first, 0], len(out)).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(
        len(first), pa.py_buffer(ends.tobytes()), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays(
        [convs.take(pa.array(first)), pa.array(last - first, pa.int64()),
         text.cast(pa.string()), pa.ListArray.from_arrays(spans, pa.array(start, pa.int64())),
         pa.ListArray.from_arrays(spans, pa.array(stop, pa.int64()))],
        ["conv_id", "n_turns", "formatted", "loss_start", "loss_end"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(size):
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + PART_BYTES, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before, part = object(), 0
    for batch in batches:
        for piece in _slices(batch):
            rows = assemble(piece["conv_id"], piece["role"], piece["text"])
            number = []
            for conv in rows["conv_id"].to_pylist():
                part = part + 1 if conv == before else 0
                before = conv
                number.append(part)
            yield pa.RecordBatch.from_arrays(
                [rows[0], pa.array(number, pa.int64()), *rows.columns[1:]],
                ["conv_id", "part", *rows.schema.names[1:]])


def format_conversations(turns: DataFrame) -> DataFrame:
    """Parts of formatted conversations with their loss spans, in order within each task.

    One shuffle by conversation; a part is at most the turns of one Arrow batch.
    """
    ready = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text") \
        .select("conv_id", "role", "text").mapInArrow(_format, PART_SCHEMA)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that were formatted."""
    return [(unescaped(role), unescaped(text)) for role, text in _TURN.findall(formatted)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state = None, None

    def row() -> list:
        turns, all_turns, loss_chars, loss, chars = state
        return [current, turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

    def table(rows: list) -> pa.RecordBatch:
        names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        done = []
        for part in batch.to_pylist():
            if part["part"] == 0:
                if state:
                    done.append(row())
                current, state = part["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = part["formatted"]
            for role, content in turns_of(text):
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode())
            for start, end in zip(part["loss_start"], part["loss_end"]):
                content = unescaped(text[start:end])
                state[2] += len(content)
                state[3].update(content.encode())
            state[4] += len(text)
        if done:
            yield table(done)
    if state:
        yield table([row()])


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation what its formatted parts say when read back; no further shuffle."""
    return parts.mapInArrow(_digests, DIGEST_SCHEMA)

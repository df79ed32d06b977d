"""Cost-balanced packing of tokenised documents into sequences.

A document's tokens, closed by id 0, are cut into whole sequences and a rest. The rests of a block
of documents are packed together: longest first, each goes to the sequence with the lowest
estimated attention cost (linear plus quadratic in the piece's length) that still has room; one
that fits nowhere is cut at the largest room. The room of a block is its number of tokens exactly:
whole sequences and, for what is left, sequences of powers of two, so there is no padding.

Documents are packed in the task that reads them: no text and no token is shuffled, and a task
holds one block. Sequence ids carry the task's number, so they depend on how the input is split.

Edge cases: null and empty texts are the closing id alone; null ids and repeated rows are
documents like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from touchflow.llm.tables import one_thread, whole_text

LENGTH = 1024
#: Sequences that are filled together.
BLOCK = 256
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
END_ID = 0
#: Pieces returned at once, about 4 MB of ids.
PIECES = 1024

SCHEMA = ("doc_id bigint, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _encoder(path: str):
    """A function from text to ids, equal to the tokenizer's own ids without special tokens.

    The vocabulary is a byte-level BPE whose ids are the merge ranks, which tiktoken encodes four
    times faster. It is used for texts of Latin-1 characters, where both libraries' classes of
    letters, digits and spaces agree; every other text and those with an added token go through
    ``tokenizers``.
    """
    one_thread()
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    added = [t["content"] for t in model["added_tokens"]]
    # The alphabet lists the stand-in characters of the 256 bytes: printable ones stand for
    # themselves, the others follow from U+0100 on, both in byte order.
    alphabet = set(pre_tokenizers.ByteLevel.alphabet())
    byte = {c: ord(c) for c in alphabet if ord(c) < 256}
    others = [b for b in range(256) if b not in byte.values()]
    byte |= dict(zip(sorted(alphabet - set(byte)), others))
    ranks = {bytes(byte[c] for c in token): number
             for token, number in model["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding(
        "vocabulary", mergeable_ranks=ranks, special_tokens={},
        pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def encode(text: str) -> list[int]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return own.encode(text, add_special_tokens=False).ids
        if any(token in text for token in added):
            return own.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def rooms(tokens: int, length: int = LENGTH) -> np.ndarray:
    """Sequence lengths that hold so many tokens exactly."""
    whole, rest = divmod(tokens, length)
    powers = [1 << k for k in reversed(range(length.bit_length())) if rest >> k & 1]
    return np.array([length] * whole + powers, np.int64)


def balanced(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, size, sequence, offset) of all pieces of a block.

    Sequences are numbered by their room, longest first.
    """
    room = rooms(sum(sizes), length)
    used, cost = np.zeros_like(room), np.zeros(len(room))
    pieces = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        start = 0
        while start < sizes[i]:
            size, free = sizes[i] - start, room - used
            fits = np.flatnonzero(free >= size)
            if len(fits):
                s = int(fits[np.argmin(cost[fits])])
            else:
                s = int(np.argmax(free))
                size = int(free[s])
            pieces.append((i, start, size, s, int(used[s])))
            used[s] += size
            cost[s] += LINEAR * size + QUADRATIC * size * size
            start += size
    return pieces


def _packer(path: str, length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        pieces: list[tuple] = []
        rests: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*pieces))
            pieces.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                [c.split()[0] for c in SCHEMA.split(", ")])

        def pack() -> None:
            nonlocal sequence, held
            last = 0
            for i, start, size, s, offset in balanced([len(r[2]) for r in rests], length):
                doc, begin, ids, total = rests[i]
                pieces.append((doc, begin + start, size, ids[start:start + size].tobytes(), total,
                               sequence + s, offset))
                last = max(last, s + 1)
            sequence += last
            rests.clear()
            held = 0

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = np.array(encode(text.as_py()) + [END_ID], dtype="<u4")
                total = len(ids)
                whole = total - total % length
                for start in range(0, whole, length):
                    pieces.append((doc, start, length, ids[start:start + length].tobytes(), total,
                                   sequence, 0))
                    sequence += 1
                    if len(pieces) >= PIECES:
                        yield flush()
                if whole < total:
                    rests.append((doc, whole, ids[whole:].copy(), total))
                    held += total - whole
                    if held >= block * length:
                        pack()
                if len(pieces) >= PIECES:
                    yield flush()
        if rests:
            pack()
        if pieces:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH,
         block: int = BLOCK) -> DataFrame:
    """Pieces of all documents with their token ids (unsigned 32-bit, little-endian)."""
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    ready = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return ready.mapInArrow(_packer(tokenizer or tokenizer_file(), length, block), SCHEMA)

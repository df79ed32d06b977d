"""Periodic runs of words: a suffix automaton whose root paths are recoloured at every word.

A run is a longest stretch of consecutive words with smallest period q, at least ``LEAST`` words and
two periods long.  The words of a text are appended to a suffix automaton; the states of the prefixes
are nodes of its tree of suffix links, in which a node's text ends wherever a prefix below it ends.
Access of prefix i, as in a link-cut tree, makes the path from its state to the root one segment of
colour i and returns the segments that this replaces, each with the end p of the latest earlier
occurrence and the length L of its deepest node.  If i - p <= L, the words that end at p and at i are
a square of period i - p, which is primitive as p is the latest, and begins where its run begins.
Extended to the right it is the run.  Every run shows at each of its squares, so none is missed.  The
tree is complete before the first access, so preferred paths lie on heavy paths and are kept there as
stacks of segments; the segments replaced are O(n log n) in total.

Every word of a run is covered by a window of six words that occurs twice inside the run.  Stretches
of a text without such windows hold no run, and the automaton is built for the others only.

A text is one task's work, as its runs may span all of it; memory grows with the repetitive stretch
of a text.  There is no shuffle, and texts are not stored.

Edge cases: null texts and texts without words have no runs and an empty collapsed text; rows are
judged one by one, so null ids and repeated rows are returned as they are; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchflow.llm.tables import whole_text

#: Words of the shortest run, and of a window; a run of at least 12 words has windows of 6.
LEAST = 12
_WINDOW = LEAST // 2
#: Bytes of text whose results are returned at once.
_BYTES = 4 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of all states, and the state of each prefix."""
    link, length, step = [-1], [0], [{}]
    states, last = [], 0
    for code in codes:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        at = last
        while at >= 0 and code not in step[at]:
            step[at][code] = new
            at = link[at]
        if at >= 0:
            to = step[at][code]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                clone = len(link)
                link.append(link[to])
                length.append(length[at] + 1)
                step.append(step[to].copy())
                while at >= 0 and step[at].get(code) == to:
                    step[at][code] = clone
                    at = link[at]
                link[to] = link[new] = clone
        states.append(new)
        last = new
    return link, length, states


class Paths:
    """The tree of suffix links with coloured root paths."""

    def __init__(self, link: list[int], length: list[int]) -> None:
        self.length = length
        n = len(link)
        order = sorted(range(1, n), key=length.__getitem__, reverse=True)  # children first
        size, heavy, most = [1] * n, [-1] * n, [0] * n
        for node in order:
            up = link[node]
            size[up] += size[node]
            if size[node] > most[up]:
                most[up], heavy[up] = size[node], node
        # The heavy path of a node by its first node, and the node above that.
        self.head = head = list(range(n))
        for node in reversed(order):
            up = link[node]
            if heavy[up] == node:
                head[node] = head[up]
        self.link = link
        #: Per path its segments (deepest node, colour), the shallowest last.
        self.segments: dict[int, list[tuple[int, int]]] = {}

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path from ``node`` to the root one colour.

        Returns (colour, length of the deepest node) of each segment replaced, deepest first.
        """
        replaced, length, head, link = [], self.length, self.head, self.link
        while node >= 0:
            top = head[node]
            own, deep, found = self.segments.setdefault(top, []), length[node], []
            while own and length[own[-1][0]] <= deep:
                end, earlier = own.pop()
                found.append((earlier, length[end]))
            if own and (not found or found[-1][1] < deep):  # goes on below, where it stays
                found.append((own[-1][1], deep))
            own.append((node, colour))
            for earlier in reversed(found):
                if not replaced or replaced[-1][0] != earlier[0]:
                    replaced.append(earlier)
            node = link[top]
        return replaced


def runs_of_codes(codes: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    link, length, states = _automaton(codes)
    paths = Paths(link, length)
    found, ends, n = [], {}, len(codes)
    for i, state in enumerate(states):
        for p, same in paths.access(state, i):
            period = i - p
            if period <= same and ends.get(period, -1) < i:
                end = i + 1
                while end < n and codes[end] == codes[end - period]:
                    end += 1
                ends[period] = end - 1
                start = p - same + 1
                if end - start >= least:
                    found.append((start, end - start, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (begin, end) covered by windows that occur more than once.

    Windows are compared by a hash; equal hashes of different windows only make a stretch longer.
    """
    if len(codes) < 2 * _WINDOW:
        return []
    count = len(codes) - _WINDOW + 1
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    windows = np.zeros(count, np.uint64)
    for k in range(_WINDOW):
        windows = windows * np.uint64(0xD6E8FEB86659FD93) + mixed[k:k + count]
    ranked = np.sort(windows)
    repeated = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(repeated):
        return []
    at = np.flatnonzero(np.isin(windows, repeated))
    cuts = np.flatnonzero(np.diff(at) > _WINDOW) + 1
    begins, ends = at[np.append(0, cuts)], at[np.append(cuts, len(at)) - 1] + _WINDOW
    return [(int(a), int(b)) for a, b in zip(begins, ends) if b - a >= LEAST]


def runs_of_words(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start and period."""
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    return [(begin + start, length, period) for begin, end in _stretches(codes)
            for start, length, period in runs_of_codes(codes[begin:end].tolist())]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: of a run its first period stays, unless another run drops it."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    kept = np.cumsum(cover[:-1]) == 0
    return b" ".join([w for w, keep in zip(words, kept.tolist()) if keep])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch["text"].cast(pa.binary())
        parts = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)) // _BYTES
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(text)]])
        for a, b in zip(cuts, cuts[1:]):
            lists, out = [], []
            for value in text[a:b]:
                words = value.as_py().split()  # bytes: ASCII white space
                runs = runs_of_words(words)
                lists.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                out.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][a:b], pa.array([len(v) for v in lists], pa.int64()),
                 pa.array(lists, _RUNS), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n_runs", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, runs, collapsed) of every row.

    ``runs`` are by start, then period; ``collapsed`` is the text's words joined by one space,
    without those that some run contains after its first period.
    """
    ready = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return ready.mapInArrow(_found, f"doc_id bigint, n_runs bigint, runs {RUNS}, collapsed string")

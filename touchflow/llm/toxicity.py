"""Toxicity by a counterfactual-regularised linear classifier.

Features of a text are its lower-case words and the first letters of longer words, present or not.
Those that tell the labels apart are found in one count over the training rows; a logistic
regression on them is fitted in numpy with two penalties: the usual one on the weights, and one on
the change of a row's score when its identity terms are swapped for others of the same group. The
second keeps a group's name from standing for the insults it often appears with, and so keeps
neutral mentions of it clean.

Training uses at most ``PER_CLASS`` rows of each label, the first by a hash of id and text; every
document is scored over its whole text, and no text is shuffled.

Edge cases: null and empty texts get the score of a text without features; null labels and ids
train nothing; a document labelled twice is toxic if any label says so; repeated rows train once
and are scored each; without rows of both labels the score is the smoothed share of toxic ones
(0 without any labels); extra columns are ignored, ``reject`` keeps them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchflow.llm.tables import whole_text
from touchflow.session import stored

#: Bound of the training rows per label.
PER_CLASS = 4000
#: A feature must be in so many training rows and so many standard errors off even odds.
LEAST_ROWS, LEAST_Z = 2, 2.2
#: The most telling features are kept, so many at most.
FEATURES = 50_000
PREFIXES = (4, 5)
#: Penalties on the mean loss: squared weights, squared score changes of swapped rows.
RIDGE, COUNTERFACTUAL = 5e-4, 5.0
STEPS = 250

# Terms that name a group of people; a term is swapped within its line.
IDENTITY = [line.split() for line in (
    "muslim christian jewish hindu buddhist catholic protestant atheist sikh mormon",
    "muslims christians jews hindus buddhists catholics protestants atheists sikhs mormons",
    "islam christianity judaism hinduism buddhism catholicism protestantism atheism",
    "gay lesbian straight bisexual heterosexual homosexual queer transgender trans",
    "black white asian latino hispanic african european arab indigenous",
    "american mexican chinese indian russian turkish german french spanish polish",
    "women men girls boys", "woman man girl boy", "female male", "wife husband", "she he",
    "old young elderly teenage", "blind deaf disabled autistic",
    "muslimisch christlich jüdisch hinduistisch buddhistisch katholisch evangelisch",
    "frauen männer", "frau mann", "schwul lesbisch", "türken deutsche polen araber juden",
    "musulman chrétien juif hindou bouddhiste catholique", "femmes hommes", "femme homme",
    "musulmán cristiano judío hindú budista católico", "mujeres hombres", "mujer hombre")]
SWAP = {term: line[(i + 1) % len(line)] for line in IDENTITY for i, term in enumerate(line)}

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Weights of words (0) and of prefixes by their length."""

    bias: float
    weights: dict[int, dict[str, float]] = field(default_factory=dict)

    def score(self, text: str) -> float:
        words = words_of(text)
        own = self.weights.get(0, {})
        logit = self.bias + sum(map(own.get, own.keys() & words))
        for length in PREFIXES:
            known = self.weights.get(length, {})
            if known:
                logit += sum(map(known.get, known.keys() & {w[:length] for w in words}))
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """Words and marked prefixes; a word no longer than the prefix is its own prefix."""
    return words.union(*({f"{n}^{w[:n]}" for w in words} for n in PREFIXES))


def swapped(words: set[str]) -> set[str] | None:
    """The words after the swap of identity terms, if there are any."""
    if words.isdisjoint(SWAP):
        return None
    return {SWAP.get(w, w) for w in words}


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(toxic, text) of a bounded number of labelled rows that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL") \
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")) \
        .where(~held_out())
    rows = docs.select("doc_id", whole_text().alias("text"))
    keys = rows.select("doc_id", F.xxhash64("text").alias("text_key")).join(known, "doc_id")
    order = [F.xxhash64("doc_id", "text_key"), "doc_id", "text_key"]
    keys = keys.distinct()
    picked = keys.where("toxic >= 1").orderBy(*order).limit(per_class).unionByName(
        keys.where("toxic < 1").orderBy(*order).limit(per_class))
    picked = stored(picked.select("doc_id", "text_key", (F.col("toxic") >= 1).cast("int")
                                  .alias("toxic")), "toxicity-keys")
    # At most 2 * per_class keys.
    return rows.withColumn("text_key", F.xxhash64("text")) \
        .join(F.broadcast(picked), ["doc_id", "text_key"]) \
        .dropDuplicates(["doc_id", "text_key"]).select("toxic", "text")


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = [Counter(), Counter()]
    for batch in batches:
        for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"]):
            counts[toxic].update(features_of(words_of(text.as_py())))
    names = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(names), 10_000):
        part = names[i:i + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array([counts[1][f] for f in part], pa.int64()),
             pa.array([counts[0][f] for f in part], pa.int64())], ["feature", "toxic", "clean"])


def _indexed(vocabulary: dict[str, int]):
    def indices(words: set[str]) -> list[int]:
        return sorted(vocabulary[f] for f in features_of(words) & vocabulary.keys())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = [], []
            for text in batch["text"]:
                words = words_of(text.as_py())
                twin = swapped(words)
                own.append(indices(words))
                other.append(None if twin is None else indices(twin))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"].cast(pa.int32()), pa.array(own, kind), pa.array(other, kind)],
                ["toxic", "own", "other"])

    return run


#: Entries that are added up at once.
_CHUNK = 1 << 20


class _Sparse:
    """Rows of present features as offsets into one index list, never as Python lists."""

    def __init__(self, rows, width: int) -> None:
        if isinstance(rows, pa.ChunkedArray):
            rows = rows.combine_chunks()
        elif not isinstance(rows, pa.Array):
            rows = pa.array(rows, pa.list_(pa.int32()))
        self.width, self.n = width, len(rows)
        self.present = np.asarray(rows.is_valid())
        self.column = rows.flatten().to_numpy(zero_copy_only=False)  # nulls hold nothing
        sizes = np.where(self.present, np.asarray(rows.value_lengths().fill_null(0)), 0)
        self.offsets = np.append(0, np.cumsum(sizes))
        cuts = np.searchsorted(self.offsets, np.arange(0, self.offsets[-1] + 1, _CHUNK), "right") - 1
        self.blocks = np.unique(np.append(cuts, self.n))

    def _blocks(self):
        for a, b in zip(self.blocks, self.blocks[1:]):
            begin = self.offsets[a:b + 1]
            row = np.repeat(np.arange(b - a), np.diff(begin))
            yield a, b, row, self.column[begin[0]:begin[-1]]

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for a, b, row, column in self._blocks():
            out[a:b] = np.bincount(row, weights[column], b - a)
        return out

    def back(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for a, b, row, column in self._blocks():
            out += np.bincount(column, values[a:b][row], self.width)
        return out


def fit_weights(own, other, toxic: list[int], width: int, ridge: float = RIDGE,
                counterfactual: float = COUNTERFACTUAL,
                steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with momentum and per-weight scaling.

    ``own`` and ``other`` are the features of each row and of its twin with swapped identity terms,
    null without one: Arrow arrays of lists or anything that makes one.  The rarer label weighs
    more, by the root of the ratio, as between natural and equal shares.
    """
    y = np.array(toxic, float)
    odds = np.sqrt((len(y) - y.sum()) / y.sum())
    share = np.where(y == 1, odds, 1.0)
    share /= share.sum()
    x, twin = _Sparse(own, width), _Sparse(other, width)
    has_twin, twins = twin.present, int(twin.present.sum())
    w, bias = np.zeros(width + 1), float(np.log(1 / odds))
    w[-1] = bias
    mean, square, rate = np.zeros_like(w), np.zeros_like(w), 0.1
    for step in range(1, steps + 1):
        logit = x.times(w[:-1])
        error = share * (1 / (1 + np.exp(-(logit + w[-1]))) - y)
        if twins:
            change = 2 * counterfactual / twins * np.where(has_twin, logit - twin.times(w[:-1]), 0)
            slope = np.append(x.back(error + change) - twin.back(change) + ridge * w[:-1],
                              error.sum())
        else:
            slope = np.append(x.back(error) + ridge * w[:-1], error.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        w -= rate * (1 - step / (steps + 1)) * (mean / (1 - 0.9 ** step)) / (
            np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
          counterfactual: float = COUNTERFACTUAL) -> Model:
    rows = stored(training_rows(docs, labels, per_class), "toxicity-training")
    totals = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    total, positive = int(totals[0]), int(totals[1])
    if not 0 < positive < total:
        share = (positive + 0.5) / (total + 1) if total else 0.0
        return Model(float(np.log(share / (1 - share))) if total else -500.0)
    counts = rows.mapInArrow(_count, "feature string, toxic long, clean long") \
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (positive + 1.0)) - F.log(b / (total - positive + 1.0))
    z = F.abs(odds) / F.sqrt(1 / a + 1 / b)
    chosen = counts.where(F.col("toxic") + F.col("clean") >= LEAST_ROWS) \
        .withColumn("z", z).where(F.col("z") >= LEAST_Z) \
        .orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect()
    names = sorted({r[0] for r in chosen}
                   | features_of(set(SWAP)) - {f for f in features_of(set(SWAP)) if "^" in f})
    vocabulary = {name: i for i, name in enumerate(names)}
    # At most 2 * per_class rows of small integers, which stay Arrow arrays.
    table = rows.mapInArrow(_indexed(vocabulary), "toxic int, own array<int>, other array<int>") \
        .toArrow()
    weights, bias = fit_weights(table["own"], table["other"], table["toxic"].to_numpy(), len(names),
                                counterfactual=counterfactual)
    model = Model(bias, {0: {}, **{n: {} for n in PREFIXES}})
    for name, weight in zip(names, weights):
        if abs(weight) > 1e-4:
            length, mark, prefix = name.partition("^")
            model.weights[int(length) if mark else 0][prefix if mark else name] = float(weight)
    return model


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text.as_py() or "") for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())],
                [*batch.schema.names, "__score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score and decision of every document."""
    ready = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    scored = ready.mapInArrow(_scorer(model), "doc_id bigint, text string, __score double")
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not toxic; only the texts go to Python."""
    @F.arrow_udf("double")
    def toxic_score(text: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in text], pa.float64())

    return docs.where(toxic_score(whole_text()) < 0.5)

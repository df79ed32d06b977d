"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a mean repetition rate: its target share of the mixture over its share of the
input. A document's number of copies inverts the Poisson distribution of that rate at a uniform
number made from its id and a seed, so a rerun, a retry or another layout gives the same copies.
The copies are exploded and dealt to tasks by a hash, i.e. in global random order.

Edge cases: a null source is a source of its own; a null id is replaced by its text's digest; null
and empty texts weigh their one terminating byte; sources without a given weight get none when
weights are given; repeated rows get equal numbers of copies; an empty table gives no rows. Extra
columns are kept; those named like one of the result's own (``OWN``) are returned as ``input_<name>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchflow.llm.tables import whole_text
from touchflow.session import stored

TEMPERATURE = 0.7
SEED = 20240601
OWN = ("copies", "copy", "order_key")
#: exp(-rate) must not underflow: larger rates are the sum of several Poisson numbers.
LARGEST_PART = 200.0


def uniform(text: Column) -> Column:
    """A number in (0, 1) with 52 random bits, from the digest of a text."""
    return (F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("double") + 0.5) \
        / float(2 ** 52)


def source_rates(docs: DataFrame, weights: DataFrame | None = None,
                 temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """Per source: bytes, target share and mean repetition rate.

    ``weights`` (source, weight) are any non-negative numbers; by default the weight is
    ``bytes ** temperature``, which lifts small sources. The mixture has ``epochs`` times the
    bytes of the input.
    """
    sizes = docs.groupBy("source").agg(
        F.sum(F.octet_length(whole_text()) + F.lit(1).cast("long")).alias("source_bytes"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("source_bytes"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("given")).agg(
            F.sum("weight").alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select(
            "source", "source_bytes", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = stored(sizes, "source-sizes")  # the texts are read once for them
    total = sizes.agg(F.struct(F.sum("source_bytes").alias("bytes"),
                               F.sum("weight").alias("weight"))).scalar()
    share = F.col("weight") / total["weight"]
    return sizes.select(
        "source", "source_bytes", share.alias("share"),
        (share * epochs * total["bytes"] / F.col("source_bytes")).alias("rate"))


def with_distribution(rates: DataFrame) -> DataFrame:
    """Adds ``parts``, into which a large rate is cut, and ``cdf`` of one part.

    The list goes so far that no number of 52 bits lies beyond it.
    """
    return rates.withColumn(
        "parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_PART)).cast("int")) \
        .withColumn("mean", F.col("rate") / F.col("parts")) \
        .withColumn("last", F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int")) \
        .withColumn("cdf", F.expr("""
            aggregate(sequence(1, last),
                named_struct('p', exp(-mean), 's', exp(-mean), 'c', array(exp(-mean))),
                (a, k) -> named_struct('p', a.p * mean / k, 's', a.s + a.p * mean / k,
                                       'c', concat(a.c, array(a.s + a.p * mean / k))),
                a -> a.c)""")) \
        .drop("mean", "last")


def copies(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """All columns of ``docs``, ``copies`` (0 for documents left out) and ``__doc_key``.

    Catalyst broadcasts the rates where they are few; else the join is a shuffle whose hot
    sources adaptive execution splits.
    """
    small = with_distribution(rates).select(
        F.col("source").alias("__source"), F.col("parts").alias("__parts"),
        F.col("cdf").alias("__cdf"))
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(
        F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.encode(whole_text(), "UTF-8")))))
    number = F.aggregate(
        F.sequence(F.lit(0), F.col("__parts") - 1), F.lit(0),
        lambda n, part: n + F.size(F.filter(
            "__cdf", lambda c: c <= uniform(
                F.concat_ws(":", F.col("__doc_key"), part.cast("string"))))))
    return docs.withColumn("__doc_key", key) \
        .join(small, docs["source"].eqNullSafe(F.col("__source"))) \
        .withColumn("copies", number).drop("__source", "__parts", "__cdf")


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE,
        epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixture: ``docs`` with ``copies``, ``copy`` (from 0) and ``order_key``.

    Rows are dealt by ``order_key`` and sorted by it within a task.
    """
    docs = docs.withColumnsRenamed({name: f"input_{name}" for name in OWN if name in docs.columns})
    rates = source_rates(docs, weights, temperature, epochs)
    chosen = copies(docs, rates, seed).where("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))) \
        .withColumn("order_key", F.md5(F.encode(F.concat_ws(
            "/", F.col("__doc_key"), F.col("copy").cast("string")), "UTF-8"))) \
        .drop("__doc_key").repartition("order_key").sortWithinPartitions("order_key")

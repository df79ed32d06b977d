"""From raw documents to packed training sequences.

Each stage takes (spark, documents, folder of the tables) and works on everything its predecessor
kept; all but the last return the columns of documents. Toxic documents go, one document of each
near-duplicate group stays, secrets are masked in the documents that have them, sources are
replicated to their target weights, and the rest is packed.

Edge cases are those of the operators; an empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchflow.llm import mixing, packing, secrets, simhash, toxicity
from touchflow.llm.tables import bounded_batches, table
from touchflow.session import released, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group linked by fingerprints of word triples that differ in at most three bits."""
    bounded_batches(spark)
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: A trained classifier, fingerprints and a tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and reread by the next, then released."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        released(before)
    return STAGES[-1][1](spark, docs, sf_dir)

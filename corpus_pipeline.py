"""From raw documents to token ids: toxicity, near-duplicates, repeated passages, benchmark contamination, BPE.

Each stage gets what its predecessor kept, as a table of the columns of documents, and its decisions take effect:
toxic documents go; one document of each near-duplicate group stays; repeated bytes leave the texts (whole characters
only); contaminated documents go; the last stage returns ids, with digests of ids and of the text they decode to.

Defined cases: null texts are empty ones, null ids ids of their own; rows that repeat are near-duplicates of each
other, and of ties the least id stays; very long texts go through every stage whole; an empty table gives none; columns
beside those of documents go through unchanged, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stateroll.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from stateroll.llm.common import drop_written, shared_dir, table, working_tables, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from labelled rows of the stage's own input."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text."""
    left = suffix_dedup.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", not_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", not_contaminated),
    ("bpe", encoded),
]

#: SQL can express neither the trained scorer nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's working tables and its input go once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with working_tables() as made:
            out = shared_dir(spark)
            docs = written(stage(spark, docs, sf_dir), out)
        for path in [*made, before]:
            if path not in (out, None):
                drop_written(spark, path)
        before = out
    return docs
